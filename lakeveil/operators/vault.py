"""Restore maps: payloads, and their encryption with a password.

The envelope is our own: PBKDF2-HMAC-SHA256 gives a signing and an encryption key; entries are encrypted with AES-CBC
by Spark's own function and signed (encrypt, then HMAC-SHA256 over everything that is read back). The mark is checked before anything is decrypted.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import KEY_ROUNDS, SALT_BYTES, SHORTEST_PASSWORD

FORMAT, VERSION = "lakeveil encrypted restore map", 1
#: Rounds that decrypting accepts, so that a forged envelope can't stall it.
ROUNDS = range(100_000, 5_000_001)


def payloads(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a container: its restore map as JSON. sources: container, source_sha256, output_sha256 (or null)."""
    entry = F.struct("page_no", "placeholder", "original", "entity_type")
    entries = registry.groupBy("container").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    body = F.struct(F.lit("lakeveil restore map").alias("format"), F.lit(VERSION).alias("version"), F.regexp_extract("container", r"([^/\\]*)$", 1).alias("source_name"), "source_sha256", "output_sha256", "entries")
    return sources.join(entries, "container").select("container", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def keys(password: str, salt: bytes, rounds: int) -> tuple[bytes, bytes]:
    if len(password or "") < SHORTEST_PASSWORD:
        raise ValueError(f"a password needs {SHORTEST_PASSWORD} characters at least")
    both = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)
    return both[:16], both[16:]


def cipher(spark: SparkSession, data: bytes, apply) -> bytes:
    return bytes(spark.createDataFrame([(data,)], "data binary").select(apply(F.col("data")).alias("out")).first().out)


def signature(key: bytes, envelope: dict) -> str:
    said = json.dumps({k: v for k, v in envelope.items() if k != "hmac"}, sort_keys=True)
    return hmac.new(key, said.encode(), hashlib.sha256).hexdigest()


def encrypt(spark: SparkSession, payload: dict, password: str) -> bytes:
    salt = os.urandom(SALT_BYTES)
    sign, secret = keys(password, salt, KEY_ROUNDS)
    data = cipher(spark, json.dumps(payload, sort_keys=True).encode(), lambda x: F.aes_encrypt(x, F.lit(secret), F.lit("CBC"), F.lit("PKCS")))
    envelope = {"format": FORMAT, "version": VERSION, "kdf": "PBKDF2-HMAC-SHA256", "iterations": KEY_ROUNDS, "salt": base64.b64encode(salt).decode(), "data": base64.b64encode(data).decode()}
    return json.dumps(envelope | {"hmac": signature(sign, envelope)}, indent=2, sort_keys=True).encode()


def decrypt(spark: SparkSession, data: bytes, password: str) -> dict:
    envelope = json.loads(data)
    if envelope.get("format") != FORMAT or envelope.get("version") != VERSION:
        raise ValueError("not a restore map of this version")
    if envelope.get("iterations") not in ROUNDS:
        raise ValueError("the number of key rounds is out of bounds")
    sign, secret = keys(password, base64.b64decode(envelope["salt"]), envelope["iterations"])
    if not hmac.compare_digest(signature(sign, envelope), str(envelope.get("hmac"))):
        raise ValueError("wrong password, or the map was changed")
    return json.loads(cipher(spark, base64.b64decode(envelope["data"]), lambda x: F.aes_decrypt(x, F.lit(secret), F.lit("CBC"), F.lit("PKCS"))))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)
