"""Encrypted exchange of tables: rows as JSON under AES-GCM, the data key wrapped by a provider.

A key never stands in a plan: it comes as the only row of a local table, whose contents plans don't print.
"""

from __future__ import annotations

import base64
import secrets
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyProvider(Protocol):
    """Wraps data keys; a cloud key service or a hardware module can stand behind it."""

    def wrap(self, key: bytes) -> bytes: ...

    def unwrap(self, wrapped: bytes) -> bytes: ...


class LocalKeyProvider:
    """A provider with a secret of its own: keys under AES-GCM, each with a fresh nonce, so that wrapped keys tell nothing of each other."""

    def __init__(self, spark: SparkSession, secret: bytes | None = None):
        self.spark, self.secret = spark, secret or secrets.token_bytes(32)

    def _apply(self, data: bytes, function) -> bytes:
        one = self.spark.createDataFrame([(bytearray(data), bytearray(self.secret))], "x binary, k binary")
        return bytes(one.select(function("x", "k", F.lit("GCM")).alias("y")).first()["y"])

    def wrap(self, key: bytes) -> bytes:
        return self._apply(key, F.aes_encrypt)

    def unwrap(self, wrapped: bytes) -> bytes:
        """The key again; a changed one is an error."""
        return self._apply(wrapped, F.aes_decrypt)


class RsaKeyProvider:
    """Keys under RSA-OAEP with SHA-256, by the JVM's own providers. Whoever holds only the public key can wrap and can't unwrap."""

    def __init__(self, spark: SparkSession, public: str | None = None, private: str | None = None, bits: int = 2048):
        self.jvm = spark._jvm
        if public is None and private is None:
            maker = self.jvm.java.security.KeyPairGenerator.getInstance("RSA")
            maker.initialize(bits)
            pair = maker.generateKeyPair()
            public, private = self._pem(pair.getPublic(), "PUBLIC KEY", "X509EncodedKeySpec"), self._pem(pair.getPrivate(), "PRIVATE KEY", "PKCS8EncodedKeySpec")
        self.public, self.private = public, private

    def _pem(self, key, kind: str, spec: str) -> str:
        form = self.jvm.java.lang.Class.forName(f"java.security.spec.{spec}")
        text = base64.b64encode(bytes(self.jvm.java.security.KeyFactory.getInstance("RSA").getKeySpec(key, form).getEncoded())).decode()
        return "\n".join([f"-----BEGIN {kind}-----", *(text[i : i + 64] for i in range(0, len(text), 64)), f"-----END {kind}-----", ""])

    def _apply(self, data: bytes, pem: str | None, private: bool) -> bytes:
        if pem is None:
            raise ValueError(f"this provider holds no {'private' if private else 'public'} key")
        der = base64.b64decode("".join(x for x in pem.splitlines() if "---" not in x))
        spec, keys = self.jvm.java.security.spec, self.jvm.java.security.KeyFactory.getInstance("RSA")
        key = keys.generatePrivate(spec.PKCS8EncodedKeySpec(der)) if private else keys.generatePublic(spec.X509EncodedKeySpec(der))
        mask = self.jvm.java.security.spec.MGF1ParameterSpec("SHA-256")
        padding = self.jvm.javax.crypto.spec.OAEPParameterSpec("SHA-256", "MGF1", mask, self.jvm.javax.crypto.spec.PSource.PSpecified.DEFAULT)
        cipher = self.jvm.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPPadding")
        cipher.init(2 if private else 1, key, padding)
        return bytes(cipher.doFinal(data))

    def wrap(self, key: bytes) -> bytes:
        return self._apply(key, self.public, False)

    def unwrap(self, wrapped: bytes) -> bytes:
        return self._apply(wrapped, self.private, True)


def new_key() -> bytes:
    return secrets.token_bytes(32)


def _keyed(df: DataFrame, key: bytes, name: str) -> DataFrame:
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(bytearray(key),)], f"`{name}` binary")))  # one row


def encrypt_table(df: DataFrame, key: bytes | None = None) -> tuple[DataFrame, bytes]:
    """(``payload`` binary, one row for each row of ``df``; the key, made if none is given). Null fields survive."""
    key = key or new_key()
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return _keyed(df.select(F.encode(row, "UTF-8").alias("row")), key, "with").select(F.aes_encrypt("row", "with", F.lit("GCM")).alias("payload")), key


def decrypt_table(encrypted: DataFrame, key: bytes, schema: str) -> DataFrame:
    """The rows again, under ``schema``; a wrong key or a changed payload is an error."""
    text = F.decode(F.aes_decrypt("payload", "with", F.lit("GCM")), "UTF-8")
    return _keyed(encrypted.select("payload"), key, "with").select(F.from_json(text, schema).alias("r")).select("r.*")
