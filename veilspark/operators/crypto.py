"""Encryption of a private mapping, on the driver: it is small and must never be spread.

Version 2 is a token of AES-128 in CBC mode with HMAC-SHA256 under a key stretched from a passphrase; version 1 is read only."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import struct
import time
from itertools import count

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA, LEGACY_SCHEMA = "redaction_mapping_encrypted.v2", "redaction_mapping_encrypted.v1"
ROUNDS, LEGACY_ROUNDS = 390_000, 120_000


def _key(passphrase: str, salt: bytes, rounds: int) -> bytes:
    if not passphrase:
        raise ValueError("passphrase is required")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, dklen=32)


def _aes(spark: SparkSession, data: bytes, key: bytes, iv: bytes | None) -> bytes:
    """One block of bytes through Spark's AES; with an IV it encrypts, without one it decrypts IV and data."""
    c, k, mode, pad = F.lit(bytearray(data)), F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS")
    x = F.aes_encrypt(c, k, mode, pad, F.lit(bytearray(iv))) if iv is not None else F.aes_decrypt(c, k, mode, pad)
    return bytes(spark.range(1).select(x.alias("x")).first()["x"])


def encrypt(spark: SparkSession, payload: dict, passphrase: str, rounds: int = ROUNDS) -> dict:
    salt, iv = os.urandom(16), os.urandom(16)
    key = _key(passphrase, salt, rounds)
    head = b"\x80" + struct.pack(">Q", int(time.time())) + _aes(spark, json.dumps(payload, ensure_ascii=False).encode(), key[16:], iv)
    token = base64.urlsafe_b64encode(head + hmac.digest(key[:16], head, "sha256"))
    return {"schema_version": SCHEMA, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "algorithm": "fernet", "kdf": "pbkdf2_hmac_sha256", "rounds": rounds, "salt": base64.b64encode(salt).decode(), "ciphertext": token.decode()}


def decrypt(spark: SparkSession, envelope: dict, passphrase: str) -> dict:
    """The mapping; a wrong passphrase or a changed envelope raises ValueError."""
    schema = str(envelope.get("schema_version", ""))
    if "tag" in envelope:
        return _legacy(envelope, passphrase)
    if envelope.get("algorithm") != "fernet" or schema not in ("", SCHEMA):
        raise ValueError(f"unsupported encrypted mapping: {schema}")
    key = _key(passphrase, base64.b64decode(envelope["salt"]), int(envelope.get("rounds") or ROUNDS))
    token = base64.urlsafe_b64decode(envelope["ciphertext"])
    if len(token) < 57 or token[0] != 0x80 or not hmac.compare_digest(hmac.digest(key[:16], token[:-32], "sha256"), token[-32:]):
        raise ValueError("invalid passphrase or corrupted mapping file")
    return json.loads(_aes(spark, token[9:-32], key[16:], None))


def _legacy(envelope: dict, passphrase: str) -> dict:
    key = _key(passphrase, base64.b64decode(envelope["salt"]), int(envelope.get("rounds") or LEGACY_ROUNDS))
    data = base64.b64decode(envelope["ciphertext"])
    if not hmac.compare_digest(hmac.digest(key, data, "sha256"), base64.b64decode(envelope["tag"])):
        raise ValueError("invalid passphrase or corrupted mapping file")
    stream = b"".join(hmac.digest(key, i.to_bytes(8, "big"), "sha256") for i, _ in zip(count(), range(0, len(data), 32)))
    return json.loads(bytes(a ^ b for a, b in zip(data, stream)))


def write_private(path: str, envelope: dict, plain: str | None = None) -> None:
    """Writes beside the target, for the owner only, and renames, so a reader sees the old file or the new one; then removes the ``plain`` source."""
    temporary = f"{path}.part"
    with os.fdopen(os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(envelope, f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)
    if plain and os.path.realpath(plain) != os.path.realpath(path):
        os.unlink(plain)
