"""Secret scans by structural confirmation.

Pattern spans (kinds assign, access, hex) are reported as found. Candidates that look like base64 (either alphabet,
on one line, wrapped, or with escaped line ends), hexadecimal (pairs may be parted by colons) or a signed token are
decoded and reported only if their structure holds: nested DER lengths that fill each other in the order of a key
form, down to the key inside a wrapped one; the OpenSSH layout with its key blobs; or a token whose header is JSON
with an algorithm. A candidate's own length field says how far it is read, so what stands before or behind a key on
its line doesn't matter.

Null and empty texts give no spans; every row gives one row, repeated rows too; other columns are left out; an empty
table gives an empty result. Spans of equal start are ordered by kind, then end; equal spans count once. Headers and
footers of armour are found in one pass each and paired, every footer with the last header before it, so long texts
take time in proportion to their length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import column, per_slice

#: Order of the kinds among spans that start at the same place.
KINDS = ("assign", "access", "hex", "der", "openssh", "pem", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:(?:[0-9A-Fa-f]{2}){16,}|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){15,})(?![0-9A-Fa-f])")
LINE_END = r"(?:\\r\\n|\\n|\r?\n[ \t]*)"
#: Base64 characters of either alphabet, on over line ends.
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{LINE_END}[A-Za-z0-9+/_-]++)*+")
#: Places of a run where a sequence (its length in one to three bytes) or the OpenSSH magic may begin.
KEY_START = re.compile(r"(?:^|(?<=[/+_-]))(?:M[A-P][A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjEA)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
HEADER = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
FOOTER = re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
FILL = re.compile(rf"{LINE_END}")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER item at a place, if its length fits."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, least = int.from_bytes(data[at : at + k], "big"), (0x80 if k == 1 else 1 << (8 * (k - 1)))
        if n < least:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill a range exactly."""
    parts = []
    while at < end:
        item = der_item(data, at, end)
        if item is None:
            return None
        parts.append(item)
        at = item[2]
    return parts


def is_der_key(data: bytes) -> bool:
    """A private or public key: one SEQUENCE of everything, its items nested without a gap, in the order of a key form."""
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = der_parts(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags, sizes = [p[0] for p in parts], [p[2] - p[1] for p in parts]

    def algorithm(part: tuple[int, int, int]) -> bool:
        inner = der_parts(data, part[1], part[2])
        return part[0] == 0x30 and bool(inner) and inner[0][0] == 0x06

    def wraps_key(part: tuple[int, int, int]) -> bool:
        """A key form again, or one string or integer, fills the content."""
        inner = der_item(data, part[1], part[2])
        return bool(inner) and inner[2] == part[2] and (inner[0] in (0x02, 0x04) or inner[0] == 0x30 and is_der_key(data[part[1] : part[2]]))

    small = sizes[0] == 1
    # RSA: version, modulus, exponents, two primes of about half its length, and what follows from them
    rsa = len(tags) >= 9 and tags[:9] == [0x02] * 9 and small and sizes[1] >= 32 and all(abs(2 * sizes[i] - sizes[1]) <= 16 for i in (4, 5)) and sizes[3] <= sizes[1] + 1
    # DSA: version, p, q, g and two keys; q and the private key are shorter than p
    dsa = tags == [0x02] * 6 and small and sizes[1] >= 64 and 16 <= sizes[2] <= 65 and sizes[5] <= sizes[2] + 1
    return (
        rsa or dsa
        or (tags[:2] == [0x02, 0x30] and len(tags) > 2 and tags[2] == 0x04 and small and algorithm(parts[1]) and wraps_key(parts[2]))  # wrapped private key
        or (tags[:2] == [0x02, 0x04] and small and 16 <= sizes[1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]))  # elliptic curve
        or (tags == [0x30, 0x03] and algorithm(parts[0]) and sizes[1] >= 17)  # public key
        or (tags == [0x30, 0x04] and algorithm(parts[0]) and sizes[1] >= 16)  # encrypted private key
        or (tags == [0x02, 0x02] and sizes[0] >= 64 and sizes[1] <= 8)  # RSA public, modulus and exponent
    )


def strings_of(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n length-prefixed strings from a place on, and the place behind them."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def openssh_end(data: bytes) -> int | None:
    """Where an OpenSSH key ends: the magic, cipher, key function and its options, the count of keys, a public blob for each, and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or not (head := strings_of(data, len(magic), 3)):
        return None
    at = head[1]
    count = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= count <= 16 or not (blobs := strings_of(data, at + 4, count + 1)):
        return None
    for blob in blobs[0][:-1]:
        name = strings_of(blob, 0, 1)
        if not name or not re.fullmatch(rb"[a-z0-9@.-]{4,64}", name[0][0]):
            return None
    return blobs[1] if len(blobs[0][-1]) >= 8 else None


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "openssh" if openssh_end(data) is not None else None


def keys_in(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of base64 characters. A key is read as far as its own length says."""
    out, end = [], 0
    for m in KEY_START.finditer(run):
        at = m.start()
        if at < end:
            continue
        head = unbase64(run[at : at + 8])
        if head and head[0] == 0x30:
            k = head[1] & 0x7F if head[1] >= 0x80 else 0
            size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
            chars = -(-size * 4 // 3)
            if k > 3 or size < 32 or at + chars > len(run) or head[2 + k : 3 + k] not in (b"\x02", b"\x30"):
                continue
            data = unbase64(run[at : at + -(-chars // 4) * 4]) or unbase64(run[at : at + chars])
            if data and is_der_key(data[:size]):
                out.append(("der", at, at + chars))
                end = at + chars
        elif head and m[0][0] == "b":
            data = unbase64(run[at:] if (len(run) - at) % 4 != 1 else run[at:-1])
            if data and (size := openssh_end(data)) is not None:
                out.append(("openssh", at, min(len(run), at + -(-size * 4 // 3))))
                end = out[-1][2]
    return out


def is_signed_token(head: str, body: str) -> bool:
    for part, needs in ((head, "alg"), (body, None)):
        raw = unbase64(part)
        try:
            found = json.loads(raw) if raw else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or needs and not isinstance(found.get(needs), str):
            return False
    return True


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    for m in HEX_ANY.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0].replace(":", ""))):
            out.append((m.start(), kind, m.end()))
    if "M" in text or "b3Bl" in text:
        for m in BASE64.finditer(text):
            if m.end() - m.start() < 40:
                continue
            fills = [(f.start(), f.end()) for f in FILL.finditer(m[0])]
            run = FILL.sub("", m[0]) if fills else m[0]
            for kind, a, b in keys_in(run):
                for start, stop in fills:  # back to places in the text
                    a += (stop - start) * (start <= a)
                    b += (stop - start) * (start < b)
                while text[m.start() + b : m.start() + b + 1] == "=":
                    b += 1
                out.append((m.start() + a, kind, m.start() + b))
    if "-----BEGIN" in text:
        marks = sorted([(m.start(), m.end(), m[1], True) for m in HEADER.finditer(text)] + [(m.start(), m.end(), m[1], False) for m in FOOTER.finditer(text)])
        last: dict[str, tuple[int, int]] = {}
        for start, end, name, opens in marks:
            if opens:
                last[name] = start, end
            elif header := last.pop(name, None):
                lines = [x.strip() for x in FILL.sub("\n", text[header[1] : start]).split("\n")]
                if key_kind(unbase64("".join("".join(x.split()) for x in lines if ":" not in x))):
                    out.append((header[0], "pem", end))
    if "ew" in text or "ex" in text or "ey" in text or "ez" in text:
        out += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return out


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_assign, n_access, n_hex, base_sha256, spans (array of kind, start, end) and their text form.

    Offsets are code points, ends exclusive.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found", "spans")}
        for t in column(batch, "text").to_pylist():
            base = in_order(base_spans(t)) if t else []
            every = in_order([*base, *confirmed_spans(t)]) if t else []
            kinds = [s[1] for s in base]
            for k in ("assign", "access", "hex"):
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["found"].append([{"kind": k, "start": a, "end": b} for a, k, b in every])
            out["spans"].append(written(every))
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"base_sha256": pa.string(), "spans": pa.string(), "found": span}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["key", *out])

    df = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("key", df.schema["key"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex")),
        T.StructField("base_sha256", T.StringType()), T.StructField("found", SPAN), T.StructField("spans", T.StringType()),
    ])
    return df.mapInArrow(per_slice(rows), schema).withColumnRenamed("key", key)
