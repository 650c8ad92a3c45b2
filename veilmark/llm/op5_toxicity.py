"""Toxicity by compression distance with two zstandard dictionaries.

The ordinary dictionary is trained by zstandard's trainer on windows of ordinary labelled text. The toxic one has
the same content and before it what is trained on toxic labelled text: the segments that mark it. zstandard's trainer
takes what is frequent, and that is ordinary in toxic text too (README has figures), so these are chosen by contrast.
Segments are whole words with a blank at both ends, and beginnings of words. A segment's
frequency is the number of texts with it, or of distinct pairs of neighbouring words it occurs between if
that is less, so neither copies of a text nor a text that repeats it count twice. It enters if, in
some language, it is FACTOR times as frequent in toxic text as in ordinary text, and chance would put
so much of it there with probability ALPHA at most, over all segments of that language (Bonferroni,
Chernoff bound). A language without ordinary text is held against all of it.

Each window of a text (WINDOW bytes of its lower-case UTF-8 with single spaces between words, half
overlapping) is compressed with both at the first level; where the toxic dictionary saves bytes, also at the
level of an optimal parse. A window under half that size is followed by the last bytes of the ordinary dictionary,
since zstandard stores what is very short. Of a text count the largest saving of the latter and the mean saving of the
former for a window. A logistic curve of both, fitted on labelled texts that the dictionaries have not seen, gives the score;
an ordinary text weighs CLEAN times as much as a toxic one there, each class as a whole.

Learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0: at most FIT_TOXIC toxic
and FIT_CLEAN other documents, in the order of a hash of doc_id; a fifth of them, by a hash of the text, is kept for
the curve. Null and empty texts have no evidence and the lowest score; where no segment was learned every score is 0.
Null doc_id counts as not held out. Repeated rows give repeated rows; repeated labels count once, and a document labelled
both ways counts both ways. Equal texts have equal scores. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

FIT_TOXIC = 1500
FIT_CLEAN = 2500
WINDOW = 128
LEVELS = (6, 19)
ALPHA = 0.05
LEAST = 4
FACTOR = 15
CLEAN = 2
DICT_BYTES = 16_000
TOXIC_BYTES = 8_000
SAMPLES = 30_000  # windows to train the ordinary dictionary on
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
_EDGE = b".,!?%*$#&|\"'();:"
Texts = list[tuple[str, str]]  # with their languages


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def segments(word: bytes) -> set[bytes]:
    w = b" " + word.strip(_EDGE)
    if len(w) < 5:
        return {w + b" "} if len(w) >= 3 else set()
    return {w[:k] for k in range(5, min(len(w), 9) + 1)} | {w + b" "}


def _frequency(texts: Texts, wanted: set[bytes] | None = None) -> tuple[dict[bytes, dict[str, int]], Counter[str]]:
    """Of each segment by language, and the texts of each language."""
    between: dict[bytes, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
    holders: dict[bytes, Counter[str]] = defaultdict(Counter)
    size: Counter[str] = Counter()
    for t, lang in texts:
        words = t.lower().encode().split()
        edge, own = [b"", *words, b""], set()
        for i, w in enumerate(words):
            context = zlib.crc32(edge[i] + b" " + edge[i + 2])
            for x in segments(w):
                if wanted is None or x in wanted:
                    between[x][lang].add(context)
                    own.add(x)
        for x in own:
            holders[x][lang] += 1
        size[lang] += 1
    return {x: {lang: min(len(c), holders[x][lang]) for lang, c in by.items()} for x, by in between.items()}, size


def _chance(k: int, n: int, mean: float) -> float:
    """Logarithm of a bound (Chernoff) on the chance that k or more of n draws hit, where mean are expected to."""
    a, p = k / n, min(1 - 1e-9, mean / n)
    return 0.0 if a <= p else -n * (a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0.0))


def marks(toxic: Texts, clean: Texts) -> list[bytes]:
    """Segments that mark the toxic ones of texts, the most frequent in their language last."""
    seen, n_toxic = _frequency(toxic)
    seen = {x: by for x, by in seen.items() if sum(by.values()) >= LEAST}
    other, n_clean = _frequency(clean, set(seen))
    tests = Counter(lang for by in seen.values() for lang in by)
    chosen = []
    for x, by in seen.items():
        usual = other.get(x, {})
        for lang, k in by.items():
            o, of = (usual.get(lang, 0), n_clean[lang]) if n_clean[lang] else (sum(usual.values()), n_clean.total())
            rate = n_toxic[lang] / max(1, of)
            if k >= max(LEAST, FACTOR * (o + 0.5) * rate) and _chance(k, k + o, (k + o) * rate / (1 + rate)) <= math.log(ALPHA / tests[lang]):
                chosen.append((max(c / n_toxic[at] for at, c in by.items()), x))
                break
    return [x for _, x in sorted(chosen)]


def dictionaries(toxic: Texts, clean: Texts) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary; None if nothing marks the toxic texts."""
    import zstandard as z

    chosen = marks(toxic, clean)
    if not chosen:
        return None
    samples = [t[i : i + WINDOW] for t in (plain(t) for t, _ in clean) for i in range(0, len(t), WINDOW)][:SAMPLES]
    try:
        usual = z.train_dictionary(DICT_BYTES, samples, k=64, d=8, level=LEVELS[-1]).as_bytes()
    except z.ZstdError:  # too little text to train on
        usual = b"".join(samples)[-DICT_BYTES:]
    return usual, b"".join(chosen)[-TOXIC_BYTES:] + usual


class Distance:
    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        self.pairs, self.tail = [], ordinary[-WINDOW // 2 :]
        for level in LEVELS:
            pair = []
            for raw in (ordinary, toxic):
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                pair.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self.pairs.append(pair)

    def __call__(self, text: str) -> tuple[int, float]:
        """Most bytes that the toxic dictionary saves in a window, and the mean for a window."""
        (o1, t1), (o2, t2) = self.pairs
        b, best, total, half = plain(text), 0, 0, WINDOW // 2
        starts = range(0, max(1, len(b) - half), half)
        for i in starts:
            x = b[i : i + WINDOW]
            if len(x) < WINDOW // 2:
                x += self.tail
            saved = len(o1(x)) - len(t1(x))
            total += saved
            if saved > 0:
                best = max(best, len(o2(x)) - len(t2(x)))
        return best, total / len(starts)


def calibrate(toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float, float]:
    """Weights of both savings and a constant: logistic regression by Newton's method."""
    if not len(toxic) or not len(clean):
        return 1.0, 0.0, -3.5
    x = np.column_stack([np.vstack([toxic, clean]), np.ones(len(toxic) + len(clean))])
    y = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
    w = np.repeat([1 / len(toxic), CLEAN / len(clean)], [len(toxic), len(clean)]) * len(y) / 2
    b, ridge = np.zeros(3), 0.01 * np.eye(3)
    for _ in range(60):
        p = 0.5 * (1 + np.tanh(x @ b / 2))
        b = b - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return max(0.0, float(b[0])), max(0.0, float(b[1])), float(b[2])


def _labelled(labels: DataFrame) -> DataFrame:
    """Ids to learn from, the first in the order of a hash; a bound on the hash first, so tasks send few rows."""
    learn = only(labels, "doc_id", "toxic").where("toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0").distinct().withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = None
    for value, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        share = min(1.0, 1.5 * most / max(1, sizes.get(value, 0)))
        part = learn.where((F.col("toxic") == value) & (F.col("h") <= int(share * 2.0**64) - (1 << 63) - (share == 1.0))).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic")
        ids = part if ids is None else ids.unionByName(part)
    return ids


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes] | None, tuple[float, float, float]]:
    rows = only(docs, "doc_id", "text", "lang").where("text is not null").join(F.broadcast(_labelled(labels)), "doc_id").select("doc_id", "toxic", "text", "lang").dropDuplicates().toPandas()
    rows["lang"] = rows["lang"].fillna("")  # null is a language of its own
    rows = rows.sort_values(["doc_id", "text", "lang"])
    apart = rows["text"].map(lambda t: zlib.crc32(t.encode()) % 5 == 1)
    of = lambda toxic, part: list(zip(*(rows.loc[(rows["toxic"] == toxic) & (apart == part), c] for c in ("text", "lang")), strict=True))
    found = dictionaries(of(1, False), of(0, False))
    if found is None:
        return None, (0.0, 0.0, 0.0)
    distance = Distance(*found)
    return found, calibrate(*(np.array([distance(t) for t, _ in of(v, True)]).reshape(-1, 2) for v in (1, 0)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found, (largest, mean, constant) = _fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*found) if found else None
        for batch in batches:
            score = []
            for t in batch.column("text").to_pylist():
                best, usual = distance(t) if distance and t else (0, 0.0)
                x = largest * best + mean * max(0.0, usual) + constant
                score.append(1 / (1 + math.exp(-max(-700.0, x))) if distance else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return only(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)
