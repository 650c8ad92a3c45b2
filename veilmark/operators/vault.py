"""The vault: a mapping under a passphrase, kept away from what it maps."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import argon2id
from ..kinds import VaultError

MAGIC = b"VMVAULT1"
MOST = 5_000_000


def write_vault(mapping: DataFrame, path: str, passphrase: str, output: str | None = None) -> None:
    """(kind, canonical, replacement) of a mapping; a vault is one run's entity table, which fits on the driver."""
    if output and os.path.dirname(os.path.abspath(output)) == os.path.dirname(os.path.abspath(path)):
        raise VaultError("the vault must not lie beside the output")
    if mapping.limit(MOST + 1).count() > MOST:
        raise VaultError(f"a vault holds {MOST} entities at most")
    rows = [list(r) for r in mapping.where("replacement is not null").select("kind", "canonical", "replacement").distinct().orderBy("kind", "canonical").collect()]
    salt, nonce = os.urandom(16), os.urandom(12)
    box = mapping.sparkSession.range(1).select(F.aes_encrypt(F.lit(json.dumps(rows).encode()), F.lit(argon2id(passphrase.encode(), salt)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce))).first()[0]
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "wb") as f:
        f.write(MAGIC + salt + bytes(box))


def read_vault(spark: SparkSession, path: str, passphrase: str) -> DataFrame:
    with open(path, "rb") as f:
        data = f.read()
    if data[:8] != MAGIC or len(data) < 52:
        raise VaultError("not a vault")
    key = argon2id(passphrase.encode(), data[8:24])
    text = spark.range(1).select(F.try_aes_decrypt(F.lit(data[24:]), F.lit(key), F.lit("GCM")).cast("string")).first()[0]
    if text is None:
        raise VaultError("the passphrase does not open the vault")
    return spark.createDataFrame([tuple(r) for r in json.loads(text)], "kind string, canonical string, replacement string")
