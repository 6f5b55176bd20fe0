"""Values that must be these for results to agree; they are data, not logic."""

# Entity classes that a scan reports.
ENTITIES = ("PERSON", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "CRYPTO")
DEFAULT_ENTITY = "DATA"

# Labels put in place of images, and privacy modes.
IMAGE_LABEL = "[ IMMAGINE RIMOSSA ]"
IMAGE_PLACEHOLDER = "[IMAGE_REMOVED]"
MODES = ("anonymize", "pseudonymize")

# Patterns that type a hand-marked value, in the order in which they are tried.
TYPED_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
TYPED_IBAN = r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
TYPED_PHONE = r"\+?\d[\d\s()./-]{6,}\d"
TYPED_CARD = r"\b\d{13,19}\b"

# Limits.
SHORTEST_TERM = 3
SHORTEST_BOX = 5
OCR_TEXT = 20
OCR_NOISE = 0.05
SHORTEST_PASSWORD = 12
KEY_ROUNDS = 600_000
SALT_BYTES = 16

# Words in log lines and their severity, in the order in which they are tried.
SEVERITIES = (("ERRORE", "error"), ("Avviso", "warning"), ("successo", "success"), ("completata", "success"))

# Codes of text recognition languages.
OCR_CODES = {"EN": ("eng",), "IT": ("ita",), "BOTH": ("eng", "ita")}
SCAN_LANGUAGES = {"EN": ("en",), "IT": ("it",), "BOTH": ("en", "it")}
