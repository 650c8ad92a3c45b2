"""Keys and tags.

A tag is HMAC-SHA256(key, kind | canonical), composed of built-in digests. The two padded keys
are literals of the plan, so plans and event logs of runs with real keys are as secret as the
key; set spark.sql.redaction.string.regex to REDACT for them.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACT = r"(?i)[0-9a-f]{128}"
FIXED_SALT = b"veilmark-fixed-1"
MEMORY_KIB, PASSES, LANES = 19_456, 2, 1


@dataclass(frozen=True)
class Key:
    raw: bytes

    def __post_init__(self):
        if len(self.raw) != 32:
            raise ValueError("a key has 32 bytes")

    def __repr__(self) -> str:
        return "Key(...)"

    @classmethod
    def random(cls) -> Key:
        return cls(os.urandom(32))

    @classmethod
    def from_passphrase(cls, passphrase: str, archive_id: str | None = None) -> Key:
        """The salt is the start of the archive's id; without one it is fixed, so the key can be derived again."""
        salt = archive_id.encode()[:16] if archive_id else FIXED_SALT
        return cls(argon2id(passphrase.encode(), salt.ljust(16, b"\0")))

    @classmethod
    def from_file(cls, data: bytes) -> Key:
        return cls(data) if len(data) == 32 else cls.from_passphrase(data.decode().strip())

    @property
    def pads(self) -> tuple[str, str]:
        block = self.raw.ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()

    def hmac(self, message: Column) -> Column:
        """64 hex digits."""
        inner, outer = (F.unhex(F.lit(x)) for x in self.pads)
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)

    def tag(self, kind: Column, canonical: Column, attempt: Column | None = None) -> Column:
        parts = [kind, F.lit("|"), canonical]
        if attempt is not None:
            parts.append(F.when(attempt > 0, F.concat(F.lit("|"), attempt.cast("string"))).otherwise(F.lit("")))
        return self.hmac(F.concat(*parts))

    def digest(self, message: bytes) -> bytes:
        return hmac.new(self.raw, message, hashlib.sha256).digest()


# ---- Argon2id (RFC 9106), one lane, on the driver once a job

_MASK = (1 << 64) - 1


def _long_hash(data: bytes, size: int) -> bytes:
    head = struct.pack("<I", size)
    if size <= 64:
        return hashlib.blake2b(head + data, digest_size=size).digest()
    out, block = b"", hashlib.blake2b(head + data).digest()
    while size - len(out) > 64:
        out += block[:32]
        block = hashlib.blake2b(block, digest_size=min(64, size - len(out))).digest()
    return (out + block)[:size]


def _compress(x, y):
    """The permutation of two 1 KiB blocks; rows, then columns, eight at a time."""
    import numpy as np

    low, r32, r24, r16, r63 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(24), np.uint64(16), np.uint64(63)

    def turn(v, n):
        return v >> n | v << (np.uint64(64) - n)

    def mul(a, b):
        return a + b + np.uint64(2) * (a & low) * (b & low)

    def quarter(a, b, c, d):
        a = mul(a, b)
        d = turn(d ^ a, r32)
        c = mul(c, d)
        b = turn(b ^ c, r24)
        a = mul(a, b)
        d = turn(d ^ a, r16)
        c = mul(c, d)
        return a, turn(b ^ c, r63), c, d

    def rounds(v):  # v: 16 lanes of words
        v = list(v)
        for four in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            for i, z in zip(four, quarter(*(v[i] for i in four)), strict=True):
                v[i] = z
        return np.stack(v)

    r = x ^ y
    z = rounds(r.reshape(8, 16).T).T.reshape(8, 8, 2)
    columns = z.transpose(1, 0, 2).reshape(8, 16)
    z = rounds(columns.T).T.reshape(8, 8, 2).transpose(1, 0, 2).reshape(128)
    return z ^ r


def argon2id(password: bytes, salt: bytes, size: int = 32, memory: int = MEMORY_KIB, passes: int = PASSES) -> bytes:
    import numpy as np

    lanes = LANES
    start = hashlib.blake2b(struct.pack("<IIIIII", lanes, size, memory, passes, 0x13, 2) + struct.pack("<I", len(password)) + password + struct.pack("<I", len(salt)) + salt + struct.pack("<II", 0, 0)).digest()
    length = memory // 4 * 4
    quarter = length // 4
    blocks = np.zeros((length, 128), np.uint64)
    for i in range(2):
        blocks[i] = np.frombuffer(_long_hash(start + struct.pack("<II", i, 0), 1024), np.uint64)
    zero = np.zeros(128, np.uint64)
    with np.errstate(over="ignore"):
        for p in range(passes):
            for s in range(4):
                counter, addresses = 0, zero
                for k in range(quarter):
                    j = s * quarter + k
                    if p == 0 and j < 2:
                        continue
                    if p == 0 and s < 2:  # data-independent
                        if k % 128 == 0 or (counter == 0):
                            counter = k // 128 + 1
                            source = zero.copy()
                            source[:7] = (p, 0, s, length, passes, 2, counter)
                            addresses = _compress(zero, _compress(zero, source))
                        word = int(addresses[k % 128])
                    else:
                        word = int(blocks[j - 1][0])
                    area = (j if p == 0 else length - quarter + k) - 1
                    x = word & 0xFFFFFFFF
                    back = area - 1 - (area * (x * x >> 32) >> 32)
                    first = 0 if p == 0 else (s + 1) * quarter % length
                    new = _compress(blocks[j - 1], blocks[(first + back) % length])
                    blocks[j] = new if p == 0 else blocks[j] ^ new
    return _long_hash(blocks[length - 1].tobytes(), size)
