"""Byte-level BPE through a sentencepiece model that is serialised directly from the vocabulary.

Each byte is mapped to one printable character, so each vocabulary entry is a string of such
characters: a NORMAL piece whose id is its rank and whose score is the negative rank. The model
has the identity normaliser, no dummy prefix and no white space handling; sentencepiece's BPE
merges the best-scored adjacent pair first, leftmost on ties, as a rank-based merge does. Each
match of the pattern is encoded by itself. A match that is an entry itself is that entry, as in
tiktoken.

Distinct matches of some texts that are not in the worker's cache are encoded in one call. The
cache has two generations of bounded size; what is found in the older moves to the newer. Texts
whose characters all are in ranges where classes can stand for the properties in the pattern are
split by Python's own engine, which gives the same matches sooner.

Null and empty texts give no ids. Repeated rows give repeated rows; a null doc_id stays null. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, only

CACHE = 150_000  # entries kept in each of two generations
#: Letters up to U+024F; with white space and digits kept to ASCII, classes of these stand for the properties.
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"[\t\n\r -~{_L}\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7]*").fullmatch
_CLASSES = {r"\p{L}": _L, r"\p{N}": "0-9"}

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
FULL = SCHEMA + ", ids array<int>"


def byte_chars() -> list[str]:
    """One printable character for each byte: itself where it is visible Latin-1, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value) & (1 << 64) - 1)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto: pieces (1), trainer_spec (2), normalizer_spec (3)."""
    chars = byte_chars()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in x).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, x in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_field(n, -1) for n in (41, 42, 43)) + _field(24, False)
    normal = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}


class Cache:
    def __init__(self):
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Afterwards all keys but these are in the newer generation."""
        absent = keys - self.new.keys()
        if len(self.new) + len(absent) > CACHE:
            self.old, self.new, absent = self.new, {}, keys
        new, old, out = self.new, self.old, []
        for k in absent:
            if (x := old.get(k)) is None:
                out.append(k)
            else:
                new[k] = x
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.ranks = ranks
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model_proto(ranks))
        chars = byte_chars()
        back = {ord(c): b for b, c in enumerate(chars)}
        #: bytes of each id, by inverse mapping of the piece's characters
        self.pieces = [self.sp.IdToPiece(i).translate(back).encode("latin-1") for i in range(len(ranks))]
        self.names = [str(i) for i in range(len(ranks))]
        self.to_chars = dict(enumerate(chars))
        self.any_text = regex.compile(pattern).findall
        self.plain = re.compile(plain).findall if (plain := plain_pattern(pattern)) else None
        self.cache = Cache()

    def find(self, text: str) -> list[str]:
        return (self.plain if self.plain and _PLAIN(text) else self.any_text)(text)

    def _records(self, tokens: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Of each match: number of ids, the ids as text, the bytes that the ids stand for."""
        missing, names, inner = self.cache.missing(tokens), self.names, []
        new = self.cache.new
        for t in missing:
            if (one := self.ranks.get(t.encode())) is not None:
                new[t] = (1, names[one], self.pieces[one])
            else:
                inner.append(t)
        mapped = [t.encode().decode("latin-1").translate(self.to_chars) for t in inner]
        for t, ids in zip(inner, self.sp.EncodeAsIds(mapped, num_threads=1) if mapped else [], strict=True):
            new[t] = (len(ids), ",".join([names[i] for i in ids]), self.decode(ids))
        return new

    def records(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """The same of each text."""
        found = [self.find(t) for t in texts]
        of = self._records(set().union(*found))
        for f in found:
            rows = [of[t] for t in f]
            yield sum([x[0] for x in rows]), ",".join([x[1] for x in rows]), b"".join([x[2] for x in rows])

    def encode(self, text: str) -> list[int]:
        ids = next(self.records([text]))[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


def plain_pattern(pattern: str) -> str | None:
    """The pattern for plain texts: with classes for the properties; None where it has others."""

    def inside(m: re.Match) -> str:
        body = m[0]
        for k, v in _CLASSES.items():
            body = body.replace(k, v)
        return body

    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    for k, v in _CLASSES.items():
        out = out.replace(k, f"[{v}]")
    return None if re.search(r"\\[pPwWdDbB]|\(\?[^!:]|[+*?}]\+", out) else out


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, full: bool = False) -> DataFrame:
    """A row for each document; full adds the ids. path: a rank file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in blocks(texts):
                part, rows = batch.slice(a, b - a), list(bpe.records(texts[a:b]))
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([n for n, _, _ in rows], pa.int64())}
                out["ids_sha256"] = pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(back).hexdigest() for _, _, back in rows], pa.string())
                if full:
                    out["ids"] = pa.array([[int(i) for i in ids.split(",")] if ids else [] for _, ids, _ in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return only(docs, "doc_id", "text").mapInArrow(run, FULL if full else SCHEMA)
