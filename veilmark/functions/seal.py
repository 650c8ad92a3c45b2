"""Sealed values: tokens that the same key opens.

A token is a prefix and the unpadded URL-safe base64 of nonce, ciphertext and tag of AES-256-GCM;
the nonce is a keyed hash of the value, so equal values give equal tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import Key
from .text import replace_matches

PREFIX = "vm1."
TOKEN = r"vm1\.[A-Za-z0-9_-]{20,}"
AAD = b"veilmark-sealed-value"


def is_token(value: Column) -> Column:
    return value.rlike(f"^{TOKEN}$")


def nonce(value: Column, key: Key) -> Column:
    return F.unhex(F.substring(key.hmac(F.concat(F.lit("veilmark-nonce|"), value)), 1, 24))


def seal(value: Column, key: Key) -> Column:
    """The token of a value; empty values and tokens stay."""
    box = F.aes_encrypt(value.cast("binary"), F.lit(key.raw), F.lit("GCM"), F.lit("DEFAULT"), nonce(value, key), F.lit(AAD))
    text = F.regexp_replace(F.base64(box), r"[\r\n=]", "")
    return F.when((value == "") | is_token(value), value).otherwise(F.concat(F.lit(PREFIX), F.translate(text, "+/", "-_")))


def open_token(token: Column, key: Key) -> Column:
    """The value, or null if the key does not open it."""
    body = F.translate(F.substring(token, len(PREFIX) + 1, 1 << 30), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.try_aes_decrypt(F.try_to_binary(padded, F.lit("base64")), F.lit(key.raw), F.lit("GCM"), F.lit("DEFAULT"), F.lit(AAD)).cast("string")


def open_text(text: Column, key: Key) -> Column:
    """Text with every token opened; an error if one does not open."""
    return replace_matches(text, TOKEN, lambda m: F.coalesce(open_token(m, key), F.raise_error(F.lit("a sealed value does not open with this key"))))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))
