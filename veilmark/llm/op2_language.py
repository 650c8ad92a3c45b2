"""Language identification with bit-sliced Bloom filters of n-grams.

The table has SLOTS slots of one mask each, a bit for each language (beyond MASK languages there are
several tables): together the bit slices are
one Bloom filter for each language, and one lookup (HASHES slots, combined by AND) returns all
languages that may contain an n-gram. Inserted are the n-grams of a language that make up LEAST
of its n-grams and at least NEAR of the share that any language gives them. A text is scored by
each language's popcount over its n-grams, less what the filter's fill would give by chance:
(count - n * fp) / (1 - fp). The largest wins, ties go to the first language by name; the score
is its part of all languages' corrected counts.

Learned from text and lang of documents whose crc32(doc_id as text) mod 3 is not 1, about FIT of
each language, chosen by a hash of doc_id; everything else sees all documents. Null or letterless
text is `und` with score 0. Where nothing was learned every text is. Null doc_id counts as not
held out and is not learned from. Repeated rows give repeated rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, blocks, mix, only

SIZES = (2, 3)
FIT = 600  # documents of each language to learn from, on average
SLOTS = 1 << 18
HASHES = 2
LEAST = 3e-5
NEAR = 0.3
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of n-grams of letters (a space stands for what lies between words) and bounds of each text's."""
    low = [t.lower() for t in texts]
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in low], out=at[1:])
    code = np.frombuffer(("\n\n".join(low) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate([np.full(1, 32, np.uint32), np.where(_is_letter()[code], code, np.uint32(32))])
    gap = code == 32
    for n in SIZES:
        m = len(code) - n + 1
        h = np.full(m, n, U)
        spaces = np.zeros(m, np.int8)
        for i in range(n):
            h = h * U(0x100000001B3) + code[i : i + m]
            spaces += gap[i : i + m]
        if n > 2:
            spaces[gap[1 : 1 + m]] += 2  # a space inside
        good = np.flatnonzero(spaces < 2)
        yield mix(h[good]), np.searchsorted(good, at)


def _fit_rows(docs: DataFrame) -> DataFrame:
    learn = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 != 1")
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, FIT / n))) for k, n in sizes.items()), F.lit(0.0))
    return learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")


def learn(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """The languages, and the n-gram hashes of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                texts = [t for t, x in zip(batch.column("text").to_pylist(), langs, strict=True) if x == lang]
                for a, b in blocks(texts):
                    grams, n = np.unique(np.concatenate([h for h, _ in ngrams(texts[a:b])]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = _fit_rows(docs).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # at most 1 / LEAST n-grams of a language
    rows = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST * F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas()
    if not len(rows):
        return [], {}
    best = rows.groupby("gram")["share"].transform("max")
    rows = rows[rows["share"] >= NEAR * best]
    grams = {k: np.sort(x["gram"].to_numpy().view(U)) for k, x in rows.groupby("lang")}
    return sorted(grams), grams


class Filters:
    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(langs) <= np.dtype(k).itemsize * 8)
        self.masks = np.zeros(SLOTS, kind)
        for i, lang in enumerate(langs):
            for slot in self._slots(grams[lang]):
                np.bitwise_or.at(self.masks, slot, kind(1 << i))
        fill = np.array([np.count_nonzero(self.masks >> kind(i) & kind(1)) / SLOTS for i in range(len(langs))])
        self.chance = fill**HASHES

    def _slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield (h >> U(i * 20) & U(SLOTS - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Of each n-gram, the languages that may contain it."""
        a, *rest = (self.masks[s] for s in self._slots(h))
        for b in rest:
            a = a & b
        return a

    def counts(self, texts: list[str]) -> np.ndarray:
        """Corrected popcounts, (texts, languages)."""
        found, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, bound in ngrams(texts):
            mask = self(h)
            total += np.diff(bound)
            for i in range(len(self.langs)):
                upto = np.zeros(len(mask) + 1, np.int64)
                np.cumsum(mask >> mask.dtype.type(i) & mask.dtype.type(1), out=upto[1:])
                found[:, i] += np.diff(upto[bound])
        return np.maximum(0, (found - total[:, None] * self.chance) / (1 - self.chance))


MASK = 64  # languages of one table of masks


def all_filters(langs: list[str], grams: dict[str, np.ndarray]) -> list[Filters]:
    """A table for every MASK languages, in order."""
    return [Filters(langs[i : i + MASK], grams) for i in range(0, len(langs), MASK)]


def identify(docs: DataFrame) -> DataFrame:
    docs = only(docs, "doc_id", "lang", "text")
    langs, grams = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = all_filters(langs, grams)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks(texts):
                pred, score, part = ["und"] * (b - a), np.zeros(b - a), batch.slice(a, b - a)
                if filters:
                    c = np.hstack([f.counts(texts[a:b]) for f in filters])
                    best = c.argmax(axis=1)
                    score = c.max(axis=1) / np.maximum(c.sum(axis=1), 1e-9)
                    worded = [any(map(str.isalpha, t)) for t in texts[a:b]]
                    pred = [langs[k] if w else "und" for k, w in zip(best, worded, strict=True)]
                    score = np.where(worded, np.minimum(score, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)
