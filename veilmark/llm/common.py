"""What the operators share: tables, shared folders, Arrow batches, vectorised word hashing.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``. Hashing works on a block of
concatenated UTF-8 texts at once: a polynomial hash of any byte range comes from one cumulative
sum, so the cost is a few vector operations per byte and no Python object per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session that lacks it (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or "/tmp/checkpoints")
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


ROW_GROUP = 8 << 20  # bytes that a task holds of what it writes
FILE_ROWS = 100_000  # of a few bytes each, in a file
#: Without its native library Hadoop starts a program (chmod) for each file's permissions, its folder's and its checksum file's, and
#: while one starts it counts with all memory of the executor. The plain local file system has no checksum files; other stores are as they were.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def written(df: DataFrame, narrow: bool = False, most: int | None = None) -> DataFrame:
    """Cuts the lineage: written to the shared folder and read again. narrow: rows are few bytes for each of the input, so
    files are made of many tasks' rows instead of one each. most: bound of the number of rows, which are few bytes each;
    they go to a file for each FILE_ROWS, however many partitions there are."""
    spark = df.sparkSession
    path = shared_dir(spark)
    out = df.hint("rebalance") if narrow else df
    out = out if most is None else out.coalesce(max(1, -(-most // FILE_ROWS)))
    out.write.options(**_PLAIN).option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        n = 1 << max(20, (n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("p", _P), ("q", inverse)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def words(block: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (byte) and 64-bit hash of each word; fold: A-Z count as a-z."""
    b = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edge[::2], edge[1::2]
    p, q = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((_LOWER if fold else _BYTE)[b] * p[: len(b)], out=total[1:])
    h = (total[e] - total[s]) * q[s]
    return s, e, mix(h + (e - s).astype(U) * U(0xC2B2AE3D27D4EB4F))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for each i that has n words; h in one document or a block."""
    if len(h) < n:
        return np.empty(0, U)
    m = len(h) - n + 1
    out = np.full(m, n, U)
    for i in range(n):
        out = out * U(_P) + h[i : i + m]
    return mix(out)


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together; a longer text is a range of its own."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > size:
            yield a, i
            a, n = i, 0
        n += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def split_words(texts: list[bytes], fold: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: index of the first, then bounds (len + 1) of each text's words in the hashes, the hashes, and the words' starts and ends in their text."""
    for a, b in blocks(texts):
        part = texts[a:b]
        at = np.zeros(b - a + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=at[1:])
        s, e, h = words(b"\n".join(part), fold)
        bound = np.searchsorted(s, at)
        own = np.repeat(at[:-1], np.diff(bound))
        yield a, bound, h, s - own, e - own


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


BATCH_ROWS = 1000  # of an Arrow batch at most, for the memory of executors and their Python workers


def small_batches(df: DataFrame) -> None:
    """Texts may be long: fewer of them at a time, in Arrow batches and from Parquet. Set for the session, only downwards."""
    conf = df.sparkSession.conf
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(conf.get(name)) <= BATCH_ROWS:
            conf.set(name, BATCH_ROWS)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by place, and each name's place: names that are equal but for case, or equal, never clash. Of equal ones the first counts."""
    at: dict[str, str] = {}
    for i, name in enumerate(docs.columns):
        at.setdefault(name, f"c{i}")
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), at


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; one that is absent is null. Other columns never reach an operator."""
    small_batches(docs)
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "item_id": "bigint", "quality": "int", "toxic": "int"}
    plain, at = numbered(docs)
    return plain.select(*((F.col(at[n]) if n in at else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names))
