"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against reference blocks that together index all documents with smaller
doc_id. A factor is a run of at least WINDOW words that continues one earlier document; the words
of factors are removed.

1. Indexing. A document's windows of WINDOW words go to reference blocks by their minimizer, the
   least hash of their SEED-word sequences, so neighbouring windows stay together and travel as
   one piece of text, a segment. Equal windows meet in one block. A minimizer that is shared by too
   many windows (as measured on every SAMPLE-th document; this steers the dealing out only, no result) is
   replaced by the hash of the window itself, so no key makes a block large. Before that each task
   parses its own documents against each other: a window that it holds under a smaller doc_id is
   matched there, so a passage of many documents is sent once for each task and chunk.
2. Factors. In a block, hash chains find for each window the earlier texts with the same words. A
   factor starts at the first occurrence under the least doc_id and is extended greedily for as
   long as that reference goes on; words are compared, hashes only propose. Where it ends,
   the parse goes on at the next window that has a reference, so windows across a factor's end are checked.
3. Parsing. A document's factors from all blocks are joined where one continues the other in the same
   reference; from the left, the one that reaches furthest is taken. At its end the parse goes on
   with the first window that is not inside it, also where that begins within the factor just
   ended, so none that has a reference is missed.

Texts are judged as they came in, not as what is left of them. Null text counts as empty. Null
doc_id is smaller than none and has no smaller: nothing is removed there or because of it. Rows
with one doc_id do not remove from each other; they are told apart by their text's crc32. Repeated rows
give repeated rows. Ties between references go to the least doc_id, then to the first place. A long text is
indexed in pieces of PIECE bytes that overlap by a window less a word. Only doc_id and text are read, so
other columns never clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, only, partitions, windows, words

WINDOW = 13
SEED = 3
CHUNK = 400_000  # words that a task parses at a time
PIECE = 1 << 22  # bytes of a text that are parsed at a time
BLOCK = 2_000_000  # bytes of text for each reference block, about
SAMPLE = 64
HOT = 500_000  # windows of a minimizer
MOST_HOT = 1 << 22  # minimizers: the limit grows with the input, so this bounds their list
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
_PACKED = "part int, texts binary, doc binary, row binary, pos binary, factors binary"
#: a document's row, its first window, number of windows, and where they occur earlier
FACTOR = np.dtype([("doc", "<i8"), ("row", "<u4"), ("pos", "<u4"), ("len", "<u4"), ("ref", "<i8"), ("ref_pos", "<u4")])


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: np.dtype | type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def row_key(text: bytes) -> int:
    """Tells rows with one doc_id apart."""
    return zlib.crc32(text)


def pieces(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text with single spaces, of about most bytes, whose windows are the text's, each once; and their first word."""
    at = first = 0
    while len(text) - at > most:
        end = text.find(b" ", at + most)
        back = end
        for _ in range(WINDOW - 1):
            back = text.rfind(b" ", at, back) if back > at else -1
        if end < 0 or back < 0:  # few long words
            if end < 0:
                break
            most *= 2
            continue
        yield text[at:end], first
        first += text.count(b" ", at, back + 1)
        at = back + 1
    yield text[at:], first


class Chunk:
    """Windows of some texts, in order: hash, minimizer and its place, document, row, first word, and first and last byte."""

    def __init__(self, texts: list[bytes], doc: np.ndarray, row: np.ndarray, pos: np.ndarray):
        self.text = b"\n".join(texts)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        s, e, h = words(self.text, fold=False)
        bound = np.searchsorted(s, at)
        count = np.maximum(0, np.diff(bound) - WINDOW + 1)
        own = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        place = bound[own] + step
        self.words, self.place = h, place
        self.h = windows(h, WINDOW)[place]
        self.first, self.end = s[place], e[place + WINDOW - 1] if len(place) else place
        self.doc, self.row, self.pos = doc[own], row[own], (pos[own] + step).astype(np.uint32)
        self.new = step == 0  # the first window of a text

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the least hash of its SEED-word sequences, and the word where that stands."""
        w = WINDOW - SEED + 1
        g = windows(self.words, SEED)
        n = len(g) - w + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, np.int64)
        least, at = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, w):
            better = g[j : n + j] < least
            np.copyto(least, g[j : n + j], where=better)
            at[better] = j
        return least[self.place], at[self.place] + self.place

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether n windows from i and from j have the same words."""
        return self.text[self.first[i] : self.end[i + n - 1]] == self.text[self.first[j] : self.end[j + n - 1]]


def first_equal(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window the index of one with an equal hash under the least doc, the first of these."""
    order = np.argsort(h)
    head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    d = doc[order]
    least = np.minimum.reduceat(d, head)
    at = np.minimum.reduceat(np.where(d == least[group], order, len(h)), head)
    out = np.empty(len(h), np.int64)
    out[order] = at[group]
    return out


def factors(c: Chunk, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur under a smaller doc_id, and the factors they make. head: where a run of neighbouring windows begins."""
    if not len(c.h):
        return np.empty(0, bool), np.empty(0, FACTOR)
    ref = first_equal(c.h, c.doc)
    matched = c.doc[ref] < c.doc
    start = np.flatnonzero(head)
    off = np.arange(len(head)) - np.repeat(start, np.diff(np.append(start, len(head))))
    by_step = np.argsort(off, kind="stable")
    ends = np.cumsum(np.bincount(off))
    for k in range(1, len(ends)):  # a reference that goes on stays the reference
        i = by_step[ends[k - 1] : ends[k]]
        i = i[matched[i] & matched[i - 1]]
        go = ref[i - 1] + 1
        near = np.minimum(go, len(head) - 1)
        on = (go < len(head)) & ~head[near] & (c.h[near] == c.h[i])
        ref[i[on]] = go[on]
    at = np.flatnonzero(matched)
    if not len(at):
        return matched, np.empty(0, FACTOR)
    go_on = np.zeros(len(at), bool)
    go_on[1:] = (at[1:] == at[:-1] + 1) & ~head[at[1:]] & (ref[at[1:]] == ref[at[:-1]] + 1) & ~head[ref[at[1:]]]
    begin = np.flatnonzero(~go_on)
    size = np.diff(np.append(begin, len(at)))
    i, j = at[begin], ref[at[begin]]
    good = np.fromiter((c.same(a, b, n) for a, b, n in zip(i.tolist(), j.tolist(), size.tolist(), strict=True)), bool, len(i))
    if not good.all():
        again = _by_words(c, np.concatenate([np.arange(a, a + n) for a, n in zip(i[~good].tolist(), size[~good].tolist(), strict=True)]))
        for a, b in again:
            matched[a] = b >= 0
        again = [(a, b) for a, b in again if b >= 0]
        i, j, size = (np.concatenate([x[good], np.array(y, np.int64)]) for x, y in ((i, [a for a, _ in again]), (j, [b for _, b in again]), (size, [1] * len(again))))
    out = np.empty(len(i), FACTOR)
    for name, x in (("doc", c.doc[i]), ("row", c.row[i]), ("pos", c.pos[i]), ("len", size), ("ref", c.doc[j]), ("ref_pos", c.pos[j])):
        out[name] = x
    return matched, out


def _by_words(c: Chunk, at: np.ndarray) -> list[tuple[int, int]]:
    """For windows whose hash also belongs to other words: each with the first equal one under the least smaller doc_id, or -1."""
    least: dict[bytes, tuple[int, int]] = {}
    words_of = lambda k: c.text[c.first[k] : c.end[k]]
    for k in np.flatnonzero(np.isin(c.h, c.h[at])).tolist():
        x = (int(c.doc[k]), k)
        if (w := words_of(k)) not in least or x < least[w]:
            least[w] = x
    return [(k, j if d < c.doc[k] else -1) for k in at.tolist() for d, j in [least[words_of(k)]]]


def _destination(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(U)) % U(parts)).astype(np.int64)


def _by_part(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with its places in p, in order."""
    if len(p):
        order = np.argsort(p, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], p[order][1:] != p[order][:-1]]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
            yield int(p[order[a]]), order[a:b]


def _packed(found: np.ndarray, parts: int) -> dict[int, bytes]:
    return {k: found[x].tobytes() for k, x in _by_part(_destination(np.ascontiguousarray(found["doc"]), parts))} if len(found) else {}


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _runs(c: Chunk, keep: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of the kept windows: where one does not continue the one before under the same minimizer."""
    out = np.ones(len(keep), bool)
    out[1:] = (keep[1:] != keep[:-1] + 1) | (word[keep[1:]] != word[keep[:-1]]) | c.new[keep[1:]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held: list[tuple[bytes, int, int, int]] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            plain = b" ".join((text or b"").split())
            for piece, first in pieces(plain, PIECE):
                if (n := piece.count(b" ") + 1) >= WINDOW:
                    held.append((piece, doc_id, row_key(text), first))
                    size += n
                    if size >= CHUNK:
                        yield _chunk(held)
                        held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(held: list[tuple[bytes, int, int, int]]) -> Chunk:
    texts, doc, row, pos = zip(*held, strict=True)
    return Chunk(list(texts), np.array(doc, np.int64), np.array(row, np.uint32), np.array(pos, np.int64))


def hot_minimizers(docs: DataFrame, total: int) -> np.ndarray:
    """Minimizers of more than HOT windows, as every SAMPLE-th document shows; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            key, n = np.unique(c.minimizers()[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    sample = only(docs, "doc_id", "text").where("doc_id is not null and text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    limit = max(HOT, total // 6 // MOST_HOT) // SAMPLE  # a word and a space have 6 bytes, about
    counts = sample.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(U))  # MOST_HOT rows at most


def reference_blocks(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Segments by block, some together and compressed; and the factors that a task found by itself, by destination."""
    kinds = [pa.int32(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for c in _chunks(batches):
            key, word = c.minimizers()
            if len(hot):
                common = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key)
                key[common], word[common] = c.h[common], -1 - common
            matched, found = factors(c, _runs(c, np.arange(len(key)), word))
            done = _packed(found, parts)
            keep = np.flatnonzero(~matched)
            begin = np.flatnonzero(_runs(c, keep, word))
            i, last = keep[begin], keep[np.append(begin[1:], len(keep)) - 1] if len(keep) else keep
            first, end, text, rows = c.first[i].tolist(), c.end[last].tolist(), c.text, []
            for k, x in _by_part((mix(key[i]) % U(parts)).astype(np.int64)):
                own = x.tolist()
                rows.append((k, pack(b"\n".join([text[first[y] : end[y]] for y in own])), planes(c.doc[i[x]]), planes(c.row[i[x]]), planes(c.pos[i[x]]), done.pop(k, None)))
            yield _batch(rows + [(k, None, None, None, None, v) for k, v in done.items()], kinds, names)

    return only(docs, "doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, _PACKED)


def match_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, factors): packed factors by the destination of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        texts, doc, row, pos, found = [], [], [], [], [np.empty(0, FACTOR)]
        for b in batches:
            for t, d, r, p, f in zip(*(b.column(x).to_pylist() for x in ("texts", "doc", "row", "pos", "factors")), strict=True):
                if t is not None:
                    texts += unpack(t).split(b"\n")
                    doc.append(unplaned(d, np.int64))
                    row.append(unplaned(r, np.uint32))
                    pos.append(unplaned(p, np.uint32))
                if f is not None:
                    found.append(np.frombuffer(f, FACTOR))
        if texts:
            c = Chunk(texts, np.concatenate(doc), np.concatenate(row), np.concatenate(pos).astype(np.int64))
            texts.clear()
            found.append(factors(c, c.new)[1])
        packed = _packed(np.concatenate(found), parts)
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], names=["part", "factors"])

    return blocks.groupBy("part").applyInArrow(run, "part int, factors binary")


def parse(found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Factors (first word, words, reference, its first word) of one document, from those of all blocks, greedily from the left."""
    joined: list[list[int]] = []
    rows = [(int(f["ref"]), int(f["ref_pos"]) - int(f["pos"]), int(f["pos"]), int(f["len"])) for f in found]
    for ref, shift, pos, n in sorted(rows):
        if joined and joined[-1][:2] == [ref, shift] and pos <= joined[-1][3]:
            joined[-1][3] = max(joined[-1][3], pos + n)
        else:
            joined.append([ref, shift, pos, pos + n])
    joined.sort(key=lambda x: (x[2], -x[3], x[0], x[1]))
    out, at, best, k = [], 0, None, 0
    while k < len(joined) or best:
        while k < len(joined) and joined[k][2] <= at:
            if best is None or joined[k][3] > best[3]:
                best = joined[k]
            k += 1
        if best is None or best[3] <= at:
            best = None
            if k < len(joined):
                at = joined[k][2]
            continue
        ref, shift, _, end = best
        out.append((at, end - at + WINDOW - 1, ref, at + shift))
        at, best = end, None
    return out


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """Documents by destination, some together, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts, ids = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("doc_id").to_pylist()
            known = np.array([0 if x is None else x for x in ids], np.int64)
            p = np.where(np.array([x is None for x in ids], bool), np.arange(len(ids)) % parts, _destination(known, parts))
            rows = [(k, [ids[i] for i in x], [len(texts[i]) for i in x], pack(b"".join([texts[i] for i in x]))) for k, x in ((k, x.tolist()) for k, x in _by_part(p))]
            yield _batch(rows, [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()], ["part", "ids", "sizes", "packed"])

    return only(docs, "doc_id", "text").mapInArrow(run, "part int, ids array<bigint>, sizes array<bigint>, packed binary")


def deduplicated(docs: DataFrame, full: bool = False) -> DataFrame:
    """A row for each document; full adds the kept text and the factors."""
    total = only(docs, "text").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(docs.sparkSession), -(-total // BLOCK))
    found = match_blocks(reference_blocks(docs, parts, hot_minimizers(docs, total)), parts)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = _texts(docs, parts).withColumn("factors", F.lit(None).cast("binary")).unionByName(found.select("part", none("array<bigint>", "ids"), none("array<bigint>", "sizes"), none("binary", "packed"), "factors"))
    factor = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string(), factor] if full else [])]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        parcels, held = [], [np.empty(0, FACTOR)]
        for b in batches:
            for *x, f in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "packed", "factors")), strict=True):
                if f is None:
                    parcels.append(x)
                else:
                    held.append(np.frombuffer(f, FACTOR))
        f = np.concatenate(held)
        f = f[np.lexsort((f["pos"], f["row"], f["doc"]))]
        where = {}
        if len(f):
            head = np.flatnonzero(np.concatenate([[True], (f["doc"][1:] != f["doc"][:-1]) | (f["row"][1:] != f["row"][:-1])])).tolist()
            where = {(int(f["doc"][a]), int(f["row"][a])): (a, b) for a, b in zip(head, [*head[1:], len(f)], strict=True)}
        for ids, sizes, packed in parcels:
            out, whole, upto = [], unpack(packed) if sum(sizes) else b"", 0
            for doc_id, n in zip(ids, sizes, strict=True):
                text = whole[upto : upto + n]
                upto += n
                own = text.split()
                a, b = where.get((doc_id, row_key(text)), (0, 0)) if doc_id is not None else (0, 0)
                parsed = parse(f[a:b])
                stay, past, removed = [], 0, 0
                for p, k, _, _ in parsed:
                    stay += own[past:p]
                    removed += p + k - max(p, past)
                    past = p + k
                kept = b" ".join(stay + own[past:])
                row = (doc_id, len(own), removed, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode(), [dict(zip(("start", "n_words", "ref_doc_id", "ref_start"), x, strict=True)) for x in parsed]) if full else row)
            yield _batch(out, kinds, names)

    return rows.groupBy("part").applyInArrow(run, SCHEMA + (", kept string, factors array<struct<start:bigint,n_words:bigint,ref_doc_id:bigint,ref_start:bigint>>" if full else ""))


def oracle() -> str:
    grams = ", ".join(f"ws[i + {k}]" for k in range(WINDOW))
    return rf"""
    with w as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select rid, doc_id, i, concat_ws(chr(10), {grams}) as t from w, unnest(range(1, len(ws) - {WINDOW - 2})) as u(i)),
    m as (select rid, i from (select *, min(doc_id) over (partition by t) as least from g) where least < doc_id),
    gone as (select distinct rid, i + k as j from m, unnest(range(0, {WINDOW})) as u(k)),
    p as (select rid, doc_id, j, ws[j] as word from w, unnest(range(1, len(ws) + 1)) as u(j)),
    k as (select p.rid, string_agg(word, ' ' order by p.j) as kept, count(*) as n from p anti join gone on p.rid = gone.rid and p.j = gone.j group by p.rid)
    select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (rid)
    """
