"""Secret scan: base patterns and a randomness test battery.

Base spans come from three patterns; each pattern's cost is linear in the text. Further runs of
20 or more token characters are split at an inner '=' (padding stays), and the parts that no base
span overlaps are candidates. A candidate's encoding is the smallest alphabet that holds it. Where
none does, since it mixes '+/' with '-_', its parts between '/', and of those that still mix them
the parts between '-', '_' and '+', are candidates if they have 20 characters; the whole is one too,
in an alphabet of all token characters, and is not reported where a part of it is. So every part of
20 or more between '=' is tested. Three tests are made on a candidate in its encoding:

* chi-squared of its characters against the uniform alphabet;
* runs: the changes between neighbours of upper case, lower case, digits and other characters; in an
  alphabet of one such class, between the halves of the alphabet;
* serial correlation of alphabet positions at lag one.

A candidate that one of them rejects as random (level GATE) gets p-value 1. Else each test's p-value is
the chance that ordinary text of the same length and alphabet comes as close to a random string,
under the frequencies of characters and of pairs of neighbours in the corpus itself (all documents, outside
long tokens; pairs in upper case also count RAISED of the same in lower case);
so length is accounted for. Fisher's method combines the three.

Benjamini-Hochberg at level FDR within each length band decides over the distinct candidates of the whole
corpus: a histogram of -log10(p) in steps of 0.01, rounded down, gives each band's threshold; equal p-values are decided alike.

Null text counts as empty and has no spans. Offsets are code points, end exclusive. Repeated rows
give repeated rows and count once as tests; a null doc_id stays null. Only doc_id and text are read, so other
columns never clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, only, written

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
GATE = 0.0001
RAISED = 0.01
BANDS = (20, 32, 48, 96)
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: encodings from the smallest alphabet to the largest
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "token": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_FIELD = re.compile(r"[^=]+(?:=+\Z)?")
_CUTS = (re.compile(r"[^/]+"), re.compile(r"[A-Za-z0-9=]+"))
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_FOUND = "start:int,end:int,encoding:string,n:int,chi2:double,changes:int,serial:double,gate:boolean,token:bigint"
_RAW = f"doc_id bigint, base array<struct<kind:int,start:int,end:int>>, found array<struct<{_FOUND}>>, cells array<int>, counts array<bigint>"


def _class(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3


def _groups(alphabet: str) -> np.ndarray:
    """Of each character: the class that the runs test looks at."""
    kinds = np.array([_class(c) for c in alphabet])
    return kinds if len(set(kinds)) > 1 else (np.arange(len(alphabet)) >= len(alphabet) / 2).astype(int)


_GROUPS = {k: _groups(v) for k, v in ENCODINGS.items()}
#: chance that neighbours in a random string are of different groups
_CHANGE = {k: 1 - float(np.sum((np.bincount(g) / len(g)) ** 2)) for k, g in _GROUPS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def battery(token: str) -> tuple[str, int, float, int, float, bool, int] | None:
    """Encoding, length, chi-squared, changes of group, serial correlation, whether all three look random, and a hash of the token."""
    body = token.rstrip("=")
    have = set(body)
    encoding = next((k for k, v in _SETS.items() if have <= v), None)
    if encoding is None or len(body) < BANDS[0]:
        return None
    alphabet, n = ENCODINGS[encoding], len(body)
    size = len(alphabet)
    where = {c: i for i, c in enumerate(alphabet)}
    at = np.array([where[c] for c in body])
    seen = np.bincount(at, minlength=size).astype(float)
    chi2 = size / n * float(np.sum(seen**2)) - n
    group = _GROUPS[encoding][at]
    changes = int(np.count_nonzero(group[1:] != group[:-1]))
    d = at - at.mean()
    serial = float(np.dot(d[1:], d[:-1]) / max(1e-9, np.dot(d, d)))
    c0, df = _CHANGE[encoding], size - 1
    z = (
        ((chi2 / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)),  # Wilson and Hilferty; too many of few characters
        abs(changes - (n - 1) * c0) / math.sqrt((n - 1) * c0 * (1 - c0)),
        abs(serial) * math.sqrt(n),
    )
    gate = all(math.erfc(x / math.sqrt(2)) >= GATE for x in z)
    return encoding, n, chi2, changes, serial, gate, int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def _parts(text: str, s: int, e: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """text[s:e], and its parts where it fits only the alphabet of all token characters."""
    body = text[s:e].rstrip("=")
    if len(body) < BANDS[0]:
        return
    yield s, e
    if level < len(_CUTS) and ("+" in body or "/" in body) and ("-" in body or "_" in body):
        for m in _CUTS[level].finditer(text, s, e):
            yield from _parts(text, *m.span(), level + 1)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for run in _TOKEN.finditer(text):
        for m in _FIELD.finditer(text, *run.span()):
            yield from _parts(text, *m.span())


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    base, found = base_spans(text), []
    for s, e in candidates(text):
        if not any(a < e and s < b for _, a, b in base) and (r := battery(text[s:e])):
            found.append((s, e, *r))
    return base, found


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _between(low: float, high: float, mean: float, spread: float) -> float:
    return max(0.0, _normal((high - mean) / spread) - _normal((low - mean) / spread))


class Ordinary:
    """Ordinary text in each encoding, from the corpus's counts of pairs of neighbouring bytes (256 x 256) outside long tokens."""

    def __init__(self, pairs: np.ndarray):
        self.of: dict[str, tuple[np.ndarray, float, float]] = {}
        lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
        raised = np.flatnonzero([chr(b).isascii() and (chr(b).isupper() or chr(b).isdigit()) for b in range(256)])
        pairs = pairs.astype(float)
        like = np.ix_(lower[raised], lower[raised])
        pairs[np.ix_(raised, raised)] += RAISED * pairs[like]  # upper case is rare, and then much like lower case
        one = pairs.sum(axis=1)
        for k, alphabet in ENCODINGS.items():
            at = np.frombuffer(alphabet.encode(), np.uint8)
            q = one[at] + 1e-3
            two = pairs[np.ix_(at, at)] + 1e-3 / len(at)
            two = two / two.sum()
            x, left, right = np.arange(len(at)), two.sum(axis=1), two.sum(axis=0)
            mx, my = left @ x, right @ x
            spread = math.sqrt(max(1e-9, float((left @ (x - mx) ** 2) * (right @ (x - my) ** 2))))
            change = float(two[_GROUPS[k][:, None] != _GROUPS[k][None, :]].sum())
            self.of[k] = q / q.sum(), min(0.99, max(1e-3, change)), float((x - mx) @ two @ (x - my)) / spread

    def p_value(self, encoding: str, n: int, chi2: float, changes: int, serial: float, gate: bool) -> float:
        """Chance that ordinary text comes as close to a random string in all three tests together."""
        if not gate:
            return 1.0
        q, change, rho = self.of[encoding]
        size = len(q)
        excess = size * float(np.sum(q**2)) - 1
        p = [_normal((chi2 - size + 1 - (n - 1) * excess) / math.sqrt(2 * (size - 1) + 4 * n * excess))]
        usual = (n - 1) * _CHANGE[encoding]
        far = abs(changes - usual)
        p.append(_binomial(n - 1, change, math.ceil(usual - far - 1e-9), math.floor(usual + far + 1e-9)))
        p.append(_between(-abs(serial), abs(serial), rho, 1 / math.sqrt(n)))
        x = -sum(math.log(max(1e-300, y)) for y in p)  # half of Fisher's statistic, which has 6 degrees of freedom
        return max(1e-300, math.exp(-x) * (1 + x + x * x / 2))


def _binomial(n: int, p: float, low: int, high: int) -> float:
    """Chance of low to high hits in n draws."""
    low, high = max(0, low), min(n, high)
    if n > 2000:
        return _between(low - 0.5, high + 0.5, n * p, math.sqrt(n * p * (1 - p)))
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    return min(1.0, sum(math.exp(log(k)) for k in range(low, high + 1)))


def _raw(docs: DataFrame) -> DataFrame:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [x.split(":")[0] for x in _FOUND.split(",")]
    of = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
    cand = pa.list_(pa.struct([(x.split(":")[0], of[x.split(":")[1]]) for x in _FOUND.split(",")]))
    kinds = pa.schema([("doc_id", pa.int64()), ("base", span), ("found", cand), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            base, found, texts = [], [], batch.column("text").to_pylist()
            for text in texts:
                b, f = scan(text or "")
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                found.append([dict(zip(names, x, strict=True)) for x in f])
            raw = [_TOKEN.sub("\n", t or "").encode() for t in texts]
            for a, b in blocks(raw):
                x = np.frombuffer(b"\n".join(raw[a:b]), np.uint8)
                counts += np.bincount(x[:-1].astype(np.uint16) << 8 | x[1:], minlength=1 << 16)
            none = [pa.nulls(batch.num_rows, pa.list_(k)) for k in (pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(found, cand), *none], schema=kinds)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, span), pa.nulls(1, cand), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([counts[at].tolist()], pa.list_(pa.int64()))], schema=kinds)

    return only(docs, "doc_id", "text").mapInArrow(run, _RAW)


def step(p: float) -> int:
    return int(-100 * math.log10(p))


def _band(n: F.Column) -> F.Column:
    return sum((F.when(n >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


def find_secrets(docs: DataFrame) -> DataFrame:
    raw = written(_raw(docs))
    cells = raw.where("counts is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).groupBy("c.cells").agg(F.sum("c.counts").alias("n")).collect()  # 65,536 rows at most
    pairs = np.zeros(1 << 16, np.int64)
    for r in cells:
        pairs[r["cells"]] = r["n"]
    pairs = pairs.reshape(256, 256)
    tested = ("encoding", "n", "chi2", "changes", "serial", "gate")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Ordinary(pairs)
        for batch in batches:
            ps = [usual.p_value(*x) for x in zip(*(batch.column(c).to_pylist() for c in tested), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": batch.column("n"), "step": pa.array([step(p) for p in ps], pa.int32())})

    distinct = raw.where("size(found) > 0").select(F.explode("found").alias("f")).select("f.token", *(f"f.{x}" for x in tested)).distinct()
    tests = distinct.select(*tested).mapInArrow(rated, "n int, step int")
    steps = tests.groupBy(_band(F.col("n")).alias("band"), "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("band")
    # the least step whose p-value times the number of tests is within FDR times the number that reach it
    limits = steps.withColumn("of", F.sum("n").over(w)).withColumn("reach", F.sum("n").over(w.orderBy(F.desc("step")))).where(F.pow(F.lit(10.0), -F.col("step") / 100) * F.col("of") <= FDR * F.col("reach"))
    limit = {r["band"]: r["step"] for r in limits.groupBy("band").agg(F.min("step").alias("step")).collect()}  # a row for each band

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Ordinary(pairs)
        for batch in batches:
            rows = []
            for doc_id, base, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "base", "found")), strict=True):
                spans = [(x["start"], x["kind"], x["end"]) for x in base]
                digest = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                least = len(spans)
                for x in reversed(found):  # parts before the whole
                    band = sum(x["n"] >= b for b in BANDS[1:])
                    if band in limit and step(usual.p_value(*(x[c] for c in tested))) >= limit[band] and not any(x["start"] <= s and e <= x["end"] for s, _, e in spans[least:][-1:]):
                        spans.append((x["start"], 3, x["end"]))
                count = [sum(k == i for _, k, _ in spans) for i in range(3)]
                rows.append((doc_id, *count, hashlib.sha256(digest.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return raw.where("counts is null").select("doc_id", "base", "found").mapInArrow(final, SCHEMA)
