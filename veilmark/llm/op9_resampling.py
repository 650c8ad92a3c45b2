"""Quality classifier by importance resampling.

Two generative models of hashed byte n-grams (sizes SIZES, BUCKETS buckets): the raw model counts
all documents, the target model the documents labelled of good quality; both are smoothed. A
document's log weight is the sum over its n-grams of log(target / raw), in whole units of 1 / UNIT, so it
is the same in any batch. Neighbouring n-grams are not independent: of more than EVIDENCE n-grams
the mean counts EVIDENCE times. Gumbel noise is added and the k largest are kept: a sample without
replacement in proportion to the weights. k is the number of documents whose log weight reaches a cut: where labelled good
and bad documents are separated best, or SPARE of the good ones lie below if that is lower, less
MARGIN. So whether a document near the cut is kept is drawn by its weight, and good ones are kept. The
k-th largest perturbed weight comes from counts of its 64-bit image, 16 bits a pass; ties at it are kept.

The target model is fitted on at most FIT labelled good documents and the cut on as many bad ones
besides, in the order of a hash of doc_id; the raw model and k count every document. Noise is a
hash of doc_id, text and SEED. Null and empty texts have weight 0. Without labels of both kinds
all documents are kept. Repeated rows get the same noise and are decided alike. Other columns are
not read and stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, binary, blocks, numbered, only, written

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
FIT = 4000
MARGIN = 4.0
SPARE = 0.001
EVIDENCE = 256
UNIT = 1 << 20
SMOOTH = 2.0
SEED = 20240601
SCHEMA = "doc_id bigint, log_weight double, perturbed double, kept boolean"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-grams that start at each byte (one row for each size; -1 where a text ends before), and the texts' bounds."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(b))
    out = np.full((len(SIZES), len(b)), -1, np.int32)
    for k, n in enumerate(SIZES):
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ b[i : i + m]) * np.uint32(0x9E3779B1)
        out[k, :m] = np.where(left[:m] >= n, (h ^ h >> np.uint32(15)) % np.uint32(BUCKETS), -1)
    return out, at


def _counts(docs: DataFrame) -> np.ndarray:
    """Of all n-grams by bucket; one row for each task and bucket with any is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            texts = binary(batch.column("text"))
            for a, b in blocks(texts):
                total += np.bincount(grams(texts[a:b])[0].ravel() + 1, minlength=BUCKETS + 1)
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1:][at])], names=["bucket", "n"])

    rows = only(docs, "text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of the two models, in units, with the raw counts scaled to the target's total and SMOOTH added to both."""
    return np.rint(UNIT * np.log((target + SMOOTH) / (raw * (target.sum() / max(1.0, raw.sum())) + SMOOTH))).astype(np.int64)


def _weights(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """Log weights in units."""
    out = [np.zeros(0, np.int64)]
    padded = np.concatenate([np.zeros(1, np.int64), ratio])
    for a, b in blocks(texts):
        g, at = grams(texts[a:b])
        total, n = np.zeros(g.shape[1] + 1, np.int64), np.zeros(g.shape[1] + 1, np.int64)
        np.cumsum(padded[g + 1].sum(axis=0), out=total[1:])
        np.cumsum((g >= 0).sum(axis=0), out=n[1:])
        w, n = np.diff(total[at]), np.diff(n[at])
        out.append(np.where(n > EVIDENCE, w * EVIDENCE // np.maximum(n, 1), w))
    return np.concatenate(out)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """Log weight that separates best by balanced accuracy (the lowest of equals), or below which SPARE of the good lie, less MARGIN."""
    values = np.unique(np.concatenate([good, bad]))
    good = np.sort(good)
    rate = (len(good) - np.searchsorted(good, values)) / len(good) + np.searchsorted(np.sort(bad), values) / len(bad)
    return float(min(values[int(np.argmax(rate))], good[int(SPARE * len(good))])) - MARGIN


def _kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest (k > 0) of a column of longs ordered as unsigned, by counts of 16 bits a pass."""
    prefix, left = 0, k
    part = keys.select((F.col("key")).alias("x"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(65535))
        if shift < 48:
            part = part.where(F.shiftrightunsigned("x", shift + 16) == F.lit(prefix))
        rows = sorted(((r["d"], r["n"]) for r in part.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 65,536 at most
        for d, n in rows:
            if left <= n:
                prefix = prefix << 16 | d
                break
            left -= n
    return prefix


def _key(w: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Perturbed weights in units, and their image as longs, ordered as unsigned."""
    u = ((noise.view(U) >> U(11)).astype(float) + 0.5) / (1 << 53)
    g = w + np.rint(-UNIT * np.log(-np.log(u))).astype(np.int64)
    return g, g ^ np.int64(-(1 << 63))


def _labelled(labels: DataFrame) -> DataFrame:
    """FIT good and FIT bad ids at most, the first in the order of a hash; a bound on the hash first, so tasks send few rows."""
    known = only(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").distinct().select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    ids = None
    for value in (1, 0):
        share = min(1.0, 1.5 * FIT / max(1, sizes.get(value, 0)))
        part = known.where((F.col("quality") == value) & (F.col("h") <= int(share * 2.0**64) - (1 << 63) - (share == 1.0))).orderBy("h", "doc_id").limit(FIT).select("doc_id", "quality")
        ids = part if ids is None else ids.unionByName(part)
    return ids


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame, int | None]:
    """Log ratios by bucket, the scored documents, and the least key that is kept (unsigned; None: no label decides)."""
    docs = only(docs, "doc_id", "text")
    ids = _labelled(labels)
    ids = F.broadcast(docs.sparkSession.createDataFrame(ids.toPandas(), "doc_id bigint, quality int"))  # 2 * FIT rows at most
    ratio = log_ratio(_counts(docs.join(ids, "doc_id").where("quality > 0")), _counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _weights(binary(batch.column("text")), ratio)
            g, key = _key(w, batch.column("noise").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w / UNIT), pa.array(g / UNIT), pa.array(key)], names=["doc_id", "log_weight", "perturbed", "key"])

    scored = written(docs.select("doc_id", "text", _noise(F.col("doc_id"), F.col("text")).alias("noise")).mapInArrow(run, "doc_id bigint, log_weight double, perturbed double, key bigint"), narrow=True, most=docs.count())
    sample = scored.join(ids, "doc_id").select("quality", "log_weight").toPandas()
    good, bad = (sample.loc[(sample["quality"] > 0) == v, "log_weight"].to_numpy() for v in (True, False))
    if not len(good) or not len(bad):
        return ratio, scored, None
    k = scored.where(F.col("log_weight") >= best_cut(good, bad)).count()
    return ratio, scored, _kth_largest(scored, k)


def _noise(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, text)


def importance(docs: DataFrame, labels: DataFrame) -> DataFrame:
    _, scored, least = _fit(docs, labels)
    flip = 1 << 63  # unsigned order as signed
    kept = F.lit(True) if least is None else F.col("key").bitwiseXOR(F.lit(-flip)) >= F.lit(least - flip)
    return scored.select("doc_id", "log_weight", "perturbed", kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents, all columns: scored again by the same model, so no text is shuffled."""
    ratio, _, least = _fit(docs, labels)
    plain, at = numbered(docs)
    text, noise = plain.columns.index(at["text"]), len(plain.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key = _key(_weights(binary(batch.column(text)), ratio), batch.column(noise).to_numpy())
            yield batch.select(range(noise)).filter(pa.array(key.view(U) >= U(least)))

    doc_id = F.col(at["doc_id"]) if "doc_id" in at else F.lit(None)
    drawn = plain.select("*", _noise(doc_id.cast("bigint"), F.col(at["text"]).cast("string")).alias("noise"))
    return docs if least is None else drawn.mapInArrow(run, plain.schema).toDF(*docs.columns)
