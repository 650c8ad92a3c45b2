"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set holds its distinct 5-word shingles (lower-cased A-Z; with fewer words, the whole
sequence as one). Documents link when 100 * intersection >= 80 * union. Shingles are told apart by
64-bit hashes.

1. Equal sets have equal 64-bit signatures and form a class, the node of all that follows. A second
   hash of the set has to agree throughout a class; else signatures are taken anew with another seed.
2. Any order of shingles gives a prefix filter: of two sets that link, the first
   n - ceil(0.8 n) + 1 shingles of each share one. The order puts shingles in many documents last;
   they come from counts of all documents in a table of fixed size, each task's cells above
   chance being summed. Prefixes go to partitions by shingle, packed into arrays.
   A shingle's place in the order bounds what two sets can still share from there on.
3. The classes that share a prefix shingle form tiles by size band (sizes in a ratio of 1.25, so
   links cross one band border at most). Shingles known to be in many documents are dealt to a grid of tiles from the start;
   any shingle that is found in more than TILE classes is split into a grid by that number, so no tile grows with the data.
4. In each tile the PIVOTS classes with the earliest places are paired with all others. These few
   pairs are verified and give first components.
5. Tiles whose classes are not all in one component then give every pair between different
   components. So no pair that could still join two components is left out, and no group is
   expanded into all its pairs: links between classes that other links have joined already are not counted.
6. Verifying: with bitmaps of about BITS bits a shingle, the bits that differ bound the intersection from
   above; pairs that could still link are decided by intersecting the sorted arrays.
7. A component is named after the class with its least doc_id, so no join has a component as its key.

No shingles, no links: null, empty or wordless text is its own component. Null doc_id never is a
component_id unless nothing else is in the component. Repeated rows give repeated rows, in one component.
Ties cannot arise: a component_id is a least value. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, binary, mix, numbered, only, partitions, split_words, windows, written
from .graph import components

N = 5
BITS = 4
TABLE = 1 << 24  # cells of the count of documents by shingle
COUNTED = 60_000  # sets that a task counts before it hands its cells on
SHARE = 0.00005  # of the documents: shingles in more go last
LEAST_HOT = 16
PIVOTS = 12
FLUSH = 400_000  # prefix shingles that a task packs at a time
TILE = 20_000
BLOOM = 1 << 26  # bits at most; beyond a few million wanted sets more of the others are shuffled, too
MOST_HOT = 1 << 20  # cells of frequent shingles that are put last
FLUSH_PAIRS = 200_000
_BAND = np.log(1.25)
_KEYS = pa.list_(pa.int64())


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text and its set as sorted hashes."""
    for a, bound, h, _, _ in split_words(texts, fold=True):
        five = windows(h, N)
        for i in range(len(bound) - 1):
            x, y = int(bound[i]), int(bound[i + 1])
            if y - x >= N:
                yield a + i, np.unique(five[x : y - N + 1])
            else:
                yield a + i, windows(h[x:y], y - x) if y > x else five[:0]


def signature(s: np.ndarray, seed: int = 0) -> int:
    """Of a set as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        x = mix(np.array([np.add.reduce(mix(s ^ U(0xA0761D6478BD642F) + U(seed))) ^ (U(len(s)) * U(0xE7037ED1A0B428DB))], U))
    return int(x.view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """A power of two of bits, at least BITS a shingle."""
    m = 1 << max(6, (BITS * len(s) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(s >> U(3) & U(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(a: bytes, n: int, b: bytes, m: int) -> int:
    """Upper bound of the intersection of sets of n and m shingles, by the bits that differ."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def links(n: int, m: int, common: int) -> bool:
    return 100 * common >= 80 * (n + m - common)


def can_link(n: np.ndarray, v: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can link whose first common one has places v and w in the order.

    A tile applies it to every shingle that two sets share; a pair that links passes at the first.
    """
    return 9 * np.minimum(n - v, m - w) >= 4 * (n + m)


def _describe(docs: DataFrame, seed: int) -> DataFrame:
    """A row (doc_id, row, n, sig, proof, bitmap) for each document, the bitmap once for each class and task; and rows of counts (cell as doc_id, n; sig null)."""
    names = ["doc_id", "row", "n", "sig", "proof", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total, counted, seen = np.zeros(TABLE, np.uint16), 0, 0, set()

        def hand_on() -> pa.RecordBatch:
            at = np.flatnonzero(cells >= max(4, 4 * total / TABLE + 3))
            nulls = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(at), nulls, pa.array(cells[at].astype(np.int32)), nulls, nulls, pa.nulls(len(at), pa.binary())], names=names)

        for batch in batches:
            n, bits = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            sig, proof = np.zeros((2, batch.num_rows), np.int64)
            for i, s in shingle_sets(binary(batch.column("text"))):
                n[i] = len(s)
                if len(s):
                    sig[i], proof[i] = signature(s, seed), signature(s, -1 - seed & 0xFFFFFFFF)
                    at = (s & U(TABLE - 1)).astype(np.int64)
                    cells[at] += 1  # two shingles of a text in one cell count once
                    total, counted = total + len(s), counted + 1
                    if counted == COUNTED:
                        yield hand_on()
                        cells[:], total, counted = 0, 0, 0
                    if sig[i] not in seen:
                        seen.add(int(sig[i]))
                        bits[i] = bitmap(s)
                        if len(seen) > 200_000:
                            seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(sig), pa.array(proof), pa.array(bits, pa.binary())], names=names)
        yield hand_on()

    return only(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id bigint, row bigint, n int, sig bigint, proof bigint, bitmap binary")


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells in more than SHARE of the documents, with their counts; of too many, those above a higher power of two: MOST_HOT at most."""
    least = max(LEAST_HOT, SHARE * described.where("sig is not null").count())
    counts = described.where("sig is null").groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    by_size, kept = {r["k"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}, 0  # 64 rows at most
    for k in sorted(by_size, reverse=True):
        kept += by_size[k]
        if kept > MOST_HOT:
            counts = counts.where(F.col("n") >= 1 << k + 1)
            break
    rows = counts.toPandas()
    return rows["doc_id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefix(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of the set in the common order."""
    length = len(s) + (-4 * len(s)) // 5 + 1
    if not (r := rank[(s & U(TABLE - 1)).astype(np.int64)]).any():
        return s[:length]
    return s[np.lexsort((s, r))[:length]]


def _prefix_blocks(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], parts: int, seed: int) -> DataFrame:
    """Packed prefix shingles by partition: shingle (or tile of one), signature, size, place in the prefix, side of the tile."""
    shared = docs.sparkSession.sparkContext.broadcast((hot[0].astype(np.int32), np.log2(np.maximum(hot[1], 2)).astype(np.uint8)))
    names = ["part", "tokens", "sigs", "ns", "places", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, size_of = shared.value
        rank = np.zeros(TABLE, np.uint8)
        rank[cells] = size_of
        grid = 1 + (1 << np.arange(64, dtype=np.uint64)).astype(np.float64) * 2 // TILE  # sides of a shingle's grid of tiles, by rank
        held, size, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            t, g, n, w, d = (np.concatenate(x) for x in zip(*held, strict=True))
            p = (mix(t) % U(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            columns = [[x[order[cut[i] : cut[i + 1]]].tobytes() for i in full] for x in (t, g, n, w, d)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=names)

        for batch in batches:
            for _, s in shingle_sets(binary(batch.column("text"))):
                if not len(s) or (sig := signature(s, seed)) in seen:
                    continue
                seen.add(sig)
                if len(seen) > 200_000:
                    seen.clear()
                t = prefix(s, rank)
                g = grid[rank[(t & U(TABLE - 1)).astype(np.int64)]].astype(np.int64)
                side, place = np.zeros(len(t), np.uint8), np.arange(len(t), dtype=np.int32)
                if (g > 1).any():
                    more_t, more_p, more_d = [t[g == 1]], [place[g == 1]], [side[g == 1]]
                    for x, y, k in zip(t[g > 1], place[g > 1], g[g > 1].tolist(), strict=True):
                        own = (sig & (1 << 63) - 1) % k
                        other = np.arange(k)
                        low, high = np.minimum(own, other), np.maximum(own, other)
                        more_t.append(mix(x ^ mix((low * k + high + 1).astype(U))))
                        more_p.append(np.full(k, y))
                        more_d.append(np.where(other == own, 0, np.where(own < other, 1, 2)).astype(np.uint8))
                    t, place, side = np.concatenate(more_t), np.concatenate(more_p), np.concatenate(more_d)
                held.append((t, np.full(len(t), sig, np.int64), np.full(len(t), len(s), np.int32), place, side))
                size += len(t)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return only(docs, "text").mapInArrow(run, "part int, tokens binary, sigs binary, ns binary, places binary, sides binary")


def _tiles(blocks: DataFrame) -> DataFrame:
    """Of shingles in several classes: their classes (x shingle, y class, n, place, side), and each band's first class paired with the others (x, y; n null)."""

    def run(table: pa.Table) -> pa.Table:
        t, g, n, w, d = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in (("tokens", U), ("sigs", np.int64), ("ns", np.int32), ("places", np.int32), ("sides", np.uint8)))
        # only shingles that occur again need the full sort
        order = np.argsort(t)
        same = t[order][1:] == t[order][:-1]
        many = np.zeros(len(t), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        t, g, n, w, d = t[many], g[many], n[many], w[many], d[many]
        band = (np.log(n) / _BAND + 1e-9).astype(np.int32)
        order = np.lexsort((g, band, t))
        t, g, n, w, d, band = t[order], g[order], n[order], w[order], d[order], band[order]
        if len(t):
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            t, g, n, w, d, band = t[first], g[first], n[first], w[first], d[first], band[first]
            run_of = np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])) - 1
            several = np.bincount(run_of)[run_of] > 1
            t, g, n, w, d, band = t[several], g[several], n[several], w[several], d[several], band[several]
        a = b = np.empty(0, np.int64)
        if len(t):
            tile = np.cumsum(np.concatenate([[True], (t[1:] != t[:-1]) | (band[1:] != band[:-1])])) - 1
            heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            pairs = np.empty((0, 2), np.int64)
            # shingles of its own come first in a set's order, so an early place is that of a set near the middle of its group
            order, size = np.lexsort((mix(g.view(U)), w, tile)), np.diff(np.append(heads, len(t)))
            for k in range(PIVOTS):
                pivot = order[heads + np.minimum(k, size - 1)]
                next_band = (t[heads[1:]] == t[heads[:-1]]) & (band[heads[1:]] == band[heads[:-1]] + 1)
                i, j = np.concatenate([pivot[tile], pivot[:-1][next_band]]), np.concatenate([np.arange(len(t)), pivot[1:][next_band]])
                near = (i != j) & can_link(n[i], w[i], n[j], w[j])
                a, b = g[i[near]], g[j[near]]
                pairs = np.unique(np.concatenate([pairs, np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)]), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        return pa.table({"x": np.concatenate([t.view(np.int64), a]), "y": np.concatenate([g, b]), "n": pa.concat_arrays([pa.array(n, pa.int32()), pa.nulls(len(a), pa.int32())]), "place": np.concatenate([w, np.zeros(len(a), np.int32)]), "side": np.concatenate([d.astype(np.int32), np.zeros(len(a), np.int32)])})

    return blocks.groupBy("part").applyInArrow(run, "x bigint, y bigint, n int, place int, side int")


def _cross(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of classes in different components within a tile that are near enough in size."""
    known = entries.join(comps, entries["y"] == comps["node"], "left").select("x", "y", "n", "place", "side", F.coalesce("component", "y").alias("c"))
    mixed = known.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("x", F.ceil(F.col("size") / TILE).alias("grid"))
    # more than TILE classes: a grid of tiles; within one, side 1 pairs with side 2 only
    dealt = known.join(mixed, "x").withColumn("own", F.pmod(F.xxhash64("y"), F.col("grid"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grid") - 1)))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), half.alias("half"), "y", "n", "place", "side", "c")
    tiles = dealt.groupBy("x", "i", "j").agg(F.sort_array(F.collect_list(F.struct("y", "n", "c", "side", "half", "place"))).alias("rows"))  # about twice TILE rows at most
    tiles = tiles.select(F.transform("rows", lambda r: F.struct(*(r[k].alias(k) for k in ("y", "n", "c", "side", "half")))).alias("members"), F.transform("rows", lambda r: r["place"]).alias("places"))
    # shingles of one passage mostly are in the same classes: one tile for all of them, with each class's earliest place
    tiles = tiles.groupBy(F.xxhash64("members").alias("h"), F.xxhash64(F.lit(1), "members").alias("k")).agg(F.first("members").alias("members"), F.array_agg(F.struct("places")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def pairs() -> pa.RecordBatch:
            both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            members, places = batch.column("members"), batch.column("places")
            for r in range(batch.num_rows):
                own = members[r].values.flatten()
                y, n, c, side, half = (x.to_numpy() for x in own)
                w = np.min(np.stack([x["places"].values.to_numpy() for x in places[r]]), axis=0)
                order = np.lexsort((y, n))
                y, n, c, side, half, w = (x[order] for x in (y, n, c, side, half, w))
                last = np.searchsorted(n, np.floor(n * 1.25), side="right")
                for i in range(len(n) - 1):
                    j = np.arange(i + 1, last[i])
                    j = j[(c[j] != c[i]) & _across(side[i], side[j]) & _across(half[i], half[j]) & can_link(n[i], w[i], n[j], w[j])]
                    if len(j):
                        out.append(np.stack([np.minimum(y[i], y[j]), np.maximum(y[i], y[j])], axis=1))
                        size += len(j)
                        if size >= FLUSH_PAIRS:
                            yield pairs()
                            out.clear()
                            size = 0
        yield pairs()

    return tiles.select("members", "places").mapInArrow(run, "a bigint, b bigint").distinct()


def _across(a: int, b: np.ndarray) -> np.ndarray:
    """Whether classes of these sides of a grid's tile are to be paired: 0 with 0, 1 with 2."""
    return (a + b == 3) | ((a == 0) & (b == 0))


def _verified(docs: DataFrame, described: DataFrame, pairs: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """Those pairs (a, b) that link. most: bound of their number, if known."""
    maps = described.where("bitmap is not null").groupBy("sig").agg(F.first("bitmap").alias("bitmap"), F.first("n").alias("n"))
    a, b = (maps.select(F.col("sig").alias(s), F.col("bitmap").alias(f"m{s}"), F.col("n").alias(f"n{s}")) for s in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(c).to_pylist() for c in ("ma", "na", "mb", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array([links(na, nb, min(na, nb, most_common(ma, na, mb, nb))) for ma, na, mb, nb in zip(*x, strict=True)], pa.bool_()))

    possible = written(pairs.join(b, "b").join(a, "a").where("5 * least(na, nb) >= 4 * greatest(na, nb)").mapInArrow(bound, "a bigint, b bigint"), most is not None, most)
    sigs = possible.select(F.col("a").alias("sig")).unionByName(possible.select(F.col("b").alias("sig"))).distinct()
    wanted = _wanted_arrays(docs, sigs, seed)
    a, b = (wanted.select(F.col("sig").alias(s), F.col("shingles").alias(f"s{s}")) for s in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([s, t])
                both.sort()
                keep.append(links(len(s), len(t), int(np.count_nonzero(both[1:] == both[:-1]))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(possible.join(b, "b").join(a, "a").mapInArrow(exact, "a bigint, b bigint"), True, possible.count())


def _wanted_arrays(docs: DataFrame, sigs: DataFrame, seed: int) -> DataFrame:
    """(sig, sorted shingles) of the wanted classes; a Bloom filter keeps most other sets out of the shuffle."""
    size = min(BLOOM, 1 << max(16, 16 * sigs.count() - 1).bit_length())

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b for x in batch.column("sig").to_pylist() for b in slots(x, size)], pa.int64())], names=["bit"])

    words = sigs.mapInArrow(bits, "bit bigint").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toPandas()  # BLOOM / 64 rows at most
    table = np.zeros(max(1, size // 64), np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value.view(U), set()
        for batch in batches:
            sig, sets = [], []
            for _, s in shingle_sets(binary(batch.column("text"))):
                if len(s) and (x := signature(s, seed)) not in seen and all(int(words[b >> 6]) >> (b & 63) & 1 for b in slots(x, size)):
                    seen.add(x)
                    sig.append(x)
                    sets.append(s.tobytes())
                    if len(seen) > 200_000:
                        seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(sets, pa.binary())], names=["sig", "shingles"])

    found = only(docs, "text").mapInArrow(run, "sig bigint, shingles binary")
    return written(found.join(sigs, "sig", "left_semi").groupBy("sig").agg(F.first("shingles").alias("shingles")))


def slots(sig: int, size: int) -> list[int]:
    """The bits of a class in a Bloom filter of size bits, a power of two."""
    x = mix(np.array([sig], np.int64).view(U) ^ U(0x8EBC6AF09C88C6E3))
    return [int(x[0]) & size - 1, int(x[0]) >> 32 & size - 1]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Described documents, the classes (sig, none, least) with their least doc_id, the seed whose signatures hold, and the number of documents with words."""
    seed, rows = 0, docs.count()
    while True:
        described = written(_describe(docs, seed), narrow=True, most=4 * rows)  # a row with its bitmap counts as four
        worded = described.where("n > 0 and sig is not null")
        count = worded.count()
        classes = worded.groupBy("sig").agg(F.min("doc_id").alias("least"), (F.min("proof") != F.max("proof")).alias("clash"))
        classes = written(classes, most=count)
        if not classes.where("clash").limit(1).count():
            return described, classes.select("sig", F.col("least").isNull().alias("none"), "least"), seed, count
        seed += 1


def _grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, row, n, sig, component, component_id) of each document; the last two are null without shingles. And the number of documents with words."""
    docs = only(docs, "doc_id", "text")
    described, classes, seed, worded = _classes(docs)
    rows = described.where("sig is not null").select("doc_id", "row", "n", "sig")
    tiles = written(_tiles(_prefix_blocks(docs, _frequent(described), partitions(docs.sparkSession), seed)))
    pairs = tiles.where("n is null").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = _verified(docs, described, pairs.distinct(), seed, pairs.count())
    comps = written(_components(first, classes), most=2 * first.count())
    second = _verified(docs, described, _cross(tiles.where("n is not null"), comps.select("node", "component")), seed)
    comps = _components(first.unionByName(second), classes)
    of = classes.join(comps, classes["sig"] == comps["node"], "left").select(F.col("sig").alias("s"), F.coalesce("component", "sig").alias("component"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    linked = rows.where("n > 0").join(of, F.col("sig") == F.col("s"), "left").drop("s")
    return linked.unionByName(rows.where("n = 0"), allowMissingColumns=True), worded


def _components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component, component_id) of linked classes; the component is the class with the least doc_id (null last, then by signature)."""
    named = lambda k: classes.select(F.col("sig").alias(k), F.struct("none", "least", "sig").alias(f"{k} node"))
    edges = links.join(named("a"), "a").join(named("b"), "b").select(F.col("a node").alias("a"), F.col("b node").alias("b"))
    return components(edges, links.count()).select("node.sig", "component").select(F.col("sig").alias("node"), F.col("component.sig").alias("component"), F.col("component.least").alias("component_id"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs)[0].select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: the least doc_id's (null last), of its texts the one with the least hash.

    Rows without words stay as they are, repeated ones too; of a repeated representative one row stays.
    """
    grouped, worded = _grouped(docs)
    rows = written(grouped.where("n > 0"), narrow=True, most=worded)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b")).select("b.doc_id", "b.row").distinct()
    plain, at = numbered(docs)
    doc_id, text = (F.col(at["doc_id"]) if "doc_id" in at else F.lit(None)).cast("bigint"), F.col(at["text"]).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = plain.where(worded).withColumn("id", doc_id).withColumn("row", F.xxhash64(text))
    found = keyed.join(best, F.col("id").eqNullSafe(best["doc_id"]) & (keyed["row"] == best["row"]), "left_semi")
    if rows.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():  # repeated rows
        found = found.dropDuplicates(["id", "row"])
    return found.drop("id", "row").unionByName(plain.where(~worded)).toDF(*docs.columns)
