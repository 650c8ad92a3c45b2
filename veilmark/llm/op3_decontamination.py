"""Benchmark decontamination with SimHash over item-sized windows.

Words are those of the pipeline's other shingle operators (lower-cased A-Z). An item's features
are its 5-word shingles, or the whole sequence where it has fewer words; a shingle weighs the
number of its word characters, and counts as often as it occurs. A document is covered by windows of exactly
each item's number of words, at every position. Windows and items get 64-bit SimHashes of
their weighted shingles. The index splits them into BLOCKS blocks of 8 bits: of two fingerprints
within RADIUS, at least one block differs in at most RADIUS // BLOCKS bits, so the items that have such a block
hold all of them. Candidates within RADIUS are verified by the exact
weighted Jaccard similarity of their shingle multisets, LEAST or more. Of 1073 changed items of similarity LEAST or more, from
8 to 55 words, none was further than RADIUS (3 % were beyond 13, 1 % beyond 15).

Only windows can pass whose shingles known to the index make up LEAST of their weight, since the
similarity is never above that part; others are not fingerprinted. That loses no result.

The benchmark is the index: its items are sent to all tasks, in blocks of no more than MOST_ITEMS
and MOST_CHARS (a longer item is a block of its own), each searched against all documents. A row for each document and item that it contains, with the best window (the
first of equals). Null and empty texts contain nothing and null or empty items are contained in
nothing. Items with equal ids or texts are items of their own. Repeated documents give repeated
rows; a null doc_id stays null. Repeated items give repeated rows, by item_id (null last). Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import U, binary, mix, numbered, only, small_batches, split_words, windows, written

N = 5
LEAST = 0.8
RADIUS = 20
BLOCKS = 8
MOST_ITEMS = 200_000
MOST_CHARS = 100_000_000
AT_ONCE = 100_000  # pairs of fingerprints that are compared at a time
SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, hamming int, similarity double"


_BITS = np.array([x.bit_count() for x in range(256)], np.uint8)
_built: dict[str, Index] = {}  # of a worker: the index that it used last


def _index(name: str, shared: Broadcast) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(shared.value)
    return _built[name]


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of the runs hashes[s : s + count] for s in starts."""
    at = int(starts.min()) if len(starts) else 0
    h = mix(hashes[at : int(starts.max()) + count] if len(starts) else hashes[:0])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.zeros((len(h) + 1, 64), np.int64)
    np.cumsum((bits.astype(np.int64) * 2 - 1) * weights[at : at + len(h), None], axis=0, out=upto[1:])
    s = starts - at
    return np.packbits(upto[s + count] - upto[s] > 0, axis=1, bitorder="little").view(U).ravel()


class Item:
    def __init__(self, item_id: int | None, words: np.ndarray, lengths: np.ndarray):
        self.item_id, self.n = item_id, len(words)
        self.shingles, self.weights = shingle(words, lengths)
        self.total = int(self.weights.sum())
        self.print = simhash(self.shingles, self.weights, np.zeros(1, np.int64), len(self.shingles))[0]
        self.sorted, self.sorted_weights = by_shingle(self.shingles, self.weights)


def shingle(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each shingle."""
    n = min(N, len(words))
    upto = np.concatenate([[0], np.cumsum(lengths)])
    return windows(words, n), upto[n:] - upto[:-n]


def by_shingle(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles with their summed weights."""
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weights=w, minlength=len(u))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1e-9, float(a[1].sum() + b[1].sum()) - both)


class Index:
    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.by_length: dict[int, list[Item]] = {}
        known = [np.empty(0, U)]
        texts = [t for _, t in items]
        for a, bound, h, s, e in split_words(texts, fold=True):
            for i in range(len(bound) - 1):
                x = slice(bound[i], bound[i + 1])
                if x.stop > x.start:
                    item = Item(items[a + i][0], h[x], (e - s)[x])
                    self.by_length.setdefault(item.n, []).append(item)
                    known.append(item.shingles)
        self.known = np.unique(np.concatenate(known))
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.known & U((1 << 20) - 1)).astype(np.int64)] = True
        #: by length: the items' fingerprints, a byte for each block
        self.prints = {n: np.array([x.print for x in group], U).view(np.uint8).reshape(-1, BLOCKS) for n, group in self.by_length.items()}
        self.short = sorted(n for n in self.by_length if n < N)
        self.long = sorted(n for n in self.by_length if n >= N)

    def is_known(self, h: np.ndarray) -> np.ndarray:
        out = self.hint[(h & U((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        k = np.minimum(np.searchsorted(self.known, h[at]), max(0, len(self.known) - 1))
        out[at] = self.known[k] == h[at] if len(self.known) else False
        return out

    def near(self, n: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of fingerprints and the items of n words: places of those that have a block near enough and are within RADIUS."""
        group = self.prints[n]
        many = max(1, AT_ONCE // len(group))
        for a in range(0, len(prints), many):
            far = _BITS[prints[a : a + many].view(np.uint8).reshape(-1, 1, BLOCKS) ^ group]
            found = (far <= RADIUS // BLOCKS).any(axis=2) & (far.sum(axis=2) <= RADIUS)
            for i, j in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
                yield a + i, j

    def _search(self, n: int, starts: np.ndarray, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[Item, int, int, float]]:
        """Of windows of n words at starts, with the text's shingles: item, start, Hamming distance, similarity."""
        if not len(starts):
            return
        count = n - min(N, n) + 1
        prints = simhash(h, w, starts, count)
        last, own = -1, None
        for i, j in self.near(n, prints):
            item, s = self.by_length[n][j], int(starts[i])
            if i != last:
                last, own = i, by_shingle(h[s : s + count], w[s : s + count])
            if (x := similarity(own, (item.sorted, item.sorted_weights))) >= LEAST:
                yield item, s, (int(prints[i]) ^ int(item.print)).bit_count(), x

    def _windows(self, n: int, h: np.ndarray, w: np.ndarray, known: np.ndarray) -> np.ndarray:
        count = n - min(N, n) + 1
        if len(h) < count:
            return np.empty(0, np.int64)
        upto, good = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * known)])
        return np.flatnonzero(good[count:] - good[:-count] >= LEAST * (upto[count:] - upto[:-count]))

    def matches(self, words: np.ndarray, lengths: np.ndarray, shingles: np.ndarray, known: np.ndarray) -> list[tuple[int | None, int, int, int, float]]:
        """Best match with each item: id, start word, words, Hamming distance, similarity."""
        best: dict[int, tuple] = {}
        tasks = []
        if known.any():
            w = np.convolve(lengths, np.ones(N, np.int64), "valid")
            tasks += [(n, shingles, w, known) for n in self.long]
        for n in self.short:
            if len(words) >= n:
                h = windows(words, n)
                if (k := self.is_known(h)).any():
                    tasks.append((n, h, np.convolve(lengths, np.ones(n, np.int64), "valid"), k))
        for n, h, w, k in tasks:
            for item, s, d, x in self._search(n, self._windows(n, h, w, k), h, w):
                if (old := best.get(id(item))) is None or x > old[4]:
                    best[id(item)] = (item.item_id, s, n, d, x)
        return sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def load_items(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark's items in blocks; one empty block if there are none."""
    block, chars, first = [], 0, True
    for r in only(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        if block and (len(block) >= MOST_ITEMS or chars + len(r["text"]) > MOST_CHARS):
            yield in_order(block)
            block, chars, first = [], 0, False
        block.append((r["item_id"], r["text"].encode()))
        chars += len(r["text"])
    if block or first:
        yield in_order(block)


def in_order(items: list[tuple[int | None, bytes]]) -> list[tuple[int | None, bytes]]:
    return sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (_find(docs, items) for items in load_items(benchmark)))


def _find(docs: DataFrame, items: list[tuple[int | None, bytes]]) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for a, bound, h, s, e in split_words(binary(batch.column("text")), fold=True):
                shingles = windows(h, N)
                known = index.is_known(shingles)
                upto = np.concatenate([[0], np.cumsum(known)])
                for i in range(len(bound) - 1):
                    x, y = int(bound[i]), int(bound[i + 1])
                    last = max(x, y - N + 1)  # shingles that stay in the text
                    if index.short or (last > x and upto[last] > upto[x]):
                        out += [(ids[a + i], *m) for m in index.matches(h[x:y], (e - s)[x:y], shingles[x:last], known[x:last])]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that contain no item."""
    small_batches(docs)
    plain, places = numbered(docs)
    at, out = plain.columns.index(places["text"]), None
    for items in load_items(benchmark):
        # written between blocks: a task holds one block's index
        out = _without(plain if out is None else written(out), items, at)
    return out.toDF(*docs.columns)


def _without(docs: DataFrame, items: list[tuple[int | None, bytes]], at: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, bound, h, s, e in split_words(binary(batch.column(at)), fold=True):
                shingles = windows(h, N)
                known = index.is_known(shingles)
                upto = np.concatenate([[0], np.cumsum(known)])
                for i in range(len(bound) - 1):
                    x, y = int(bound[i]), int(bound[i + 1])
                    last = max(x, y - N + 1)
                    if index.short or (last > x and upto[last] > upto[x]):
                        keep[a + i] = not index.matches(h[x:y], (e - s)[x:y], shingles[x:last], known[x:last])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
