"""Each operator against a plain version, and on nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark.llm import common, op1_pii, op2_language, op3_decontamination, op4_jaccard, op5_toxicity, op6_secrets, op7_quality, op8_substrings, op9_resampling, op10_bpe
from veilmark.llm.graph import components

RNG = random.Random(5)
SYLLABLES = {"en": "the and ing ion er ed ly sh th ou".split(), "de": "sch ein ung ß ü keit der ge".split()}


def prose(n, lang="en", rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = [prose(120, "en" if i % 3 else "de", rng) for i in range(60)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}") for i, t in enumerate(base)]
    near = base[1].split()
    near[60] = "changed"
    license_line = prose(20, "en", rng)
    rows += [(60, base[0], "de", "s0"), (61, " ".join(near), "en", "s0"), (62, base[2] + "\n" + license_line, "en", None), (63, license_line + " " + prose(60, "en", rng), None, "s1")]
    rows += [(64, "*** %%% " * 200, "en", "s1"), (65, "same words " * 90, "en", "s2"), (66, prose(6000, "en", rng), "en", "s2"), (67, "x", "en", "s1"), (68, "x", "en", "s1")]
    rows += [(69, None, "en", "s1"), (70, "", None, None), (71, " \n\t ", "en", "s1"), (72, "12345 !!", "en", "s1"), (None, base[5], "en", "s1"), (0, base[0], "de", "s0"), (73, "日本語 テキスト 😀 " * 3, "en", "s3")]
    return rows


ROWS = corpus()
SCHEMA = "doc_id bigint, text string, lang string, source string"
KIND = ("doc_id", "text")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint")).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i not in (64, 65)), int(i % 7 == 1)) for i in range(66)] + [(None, 1, 1), (64, 0, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    words = ROWS[10][1].split()
    return spark.createDataFrame([(1, " ".join(words[30:60])), (2, " ".join(words[5:8])), (3, None), (4, ""), (None, prose(25)), (1, " ".join(words[30:60]).upper())], "item_id bigint, text string")


OPERATORS = {
    "op1": lambda d, lab, b: op1_pii.find_personal_data(d),
    "op2": lambda d, lab, b: op2_language.identify(d),
    "op3": lambda d, lab, b: op3_decontamination.find_leaks(d, b),
    "op4": lambda d, lab, b: op4_jaccard.jaccard_join(d),
    "op5": lambda d, lab, b: op5_toxicity.score_documents(d, lab),
    "op6": lambda d, lab, b: op6_secrets.find_secrets(d),
    "op7": lambda d, lab, b: op7_quality.quality_rules(d),
    "op8": lambda d, lab, b: op8_substrings.deduplicated(d),
    "op9": lambda d, lab, b: op9_resampling.importance(d, lab),
    "op10": lambda d, lab, b: op10_bpe.encode_documents(d, *tokenizer()),
}


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


TRAINING = op1_pii.EXAMPLES, op1_pii.EPOCHS


@pytest.fixture(scope="module", autouse=True)
def quick_tagger():
    op1_pii.EXAMPLES, op1_pii.EPOCHS = 192, 2


@pytest.mark.parametrize("name", list(OPERATORS))
def test_rows_extra_columns_and_empty_tables(spark, docs, labels, benchmark, name):
    run = OPERATORS[name]
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("sig", "n", "part", "row", "lang_pred", "kept", "h", "noise")))
    got = run(clash, labels.withColumn("text", F.lit("y")), benchmark.withColumn("lang", F.lit("z"))).collect()
    if name != "op3":
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert run(docs.where("false"), labels.where("false"), benchmark.where("false")).count() == 0
    assert run(docs.limit(5), labels.where("false"), benchmark.where("false")).count() == (0 if name == "op3" else 5)


# ---- op1

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    n = lambda x: len(op1_pii.digits(x))
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= n(m[0]) <= 19 and op1_pii.luhn(op1_pii.digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= n(m[0]) <= 15]


def test_base_spans_of_personal_data():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choices("0123456789.+-() @ab%", k=rng.randint(0, 40)))
        assert op1_pii.base_spans(t) == plain_pii(t), t
    began = time.process_time()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 1_000_000, "a@" * 300_000, "a@b" * 200_000, "a" * 1_000_000 + "@" * 100_000):
        op1_pii.base_spans(t)
    assert time.process_time() - began < 8  # linear: each well under a second


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in op1_pii.start_weights(rng).items()}
    x, y = op1_pii.examples(["abc", "Über"], 2, rng)
    x, y = x[:, :10], y[:, :10]
    y[(y % 2 == 0) & (y > 0)] -= 1
    _, grad = op1_pii.loss_and_gradient(x, y, w)
    for k in w:
        at = (x[0, 3], 1) if k == "embed" else tuple(int(rng.integers(s)) for s in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        want = (op1_pii.loss_and_gradient(x, y, up)[0] - op1_pii.loss_and_gradient(x, y, down)[0]) / 2e-5
        assert abs(want - grad[k][at]) < 1e-5, k


def test_tagger_adds_spans_and_keeps_base():
    w = op1_pii.train(["the", "and", "Wort", "élan"])
    texts = ["card 4111-1111-1111-1111 and x@y.org", "call (555) 123-4567 now", "nothing here", ""]
    for t, (base, every) in zip(texts, op1_pii.all_spans(texts, w), strict=True):
        assert base == plain_pii(t) and set(base) <= set(every)
        for k, s, e in set(every) - set(base):
            assert op1_pii.plausible(k, t[s:e])


def test_tagger_finds_every_written_form(monkeypatch):
    """With the training that queries use."""
    monkeypatch.setattr(op1_pii, "EXAMPLES", TRAINING[0])
    monkeypatch.setattr(op1_pii, "EPOCHS", TRAINING[1])
    words = sorted(set(prose(1500).split() + prose(700, "de").split()))
    w, rng, found = op1_pii.train(words), np.random.default_rng(77), defaultdict(list)
    for kind in range(4):
        for _ in range(160):
            form = op1_pii._form(kind, rng, words)
            shape = "spaced" if kind == 0 and " " in form else "plain" if kind == 0 else re.sub("9+", "9" if kind != 2 else "", re.sub("[0-9]", "9", form))[:12]
            before = " ".join(rng.choice(words, 8)) + " "
            (base, every), = op1_pii.all_spans([before + form + str(rng.choice([" ", ", ", "\n"])) + " ".join(rng.choice(words, 8))], w)
            found[kind, shape].append((kind, len(before), len(before) + len(form)) in every)
    assert len(found) >= 9 and all(np.mean(x) >= 0.85 for x in found.values() if len(x) >= 10), {k: (np.mean(x), len(x)) for k, x in found.items()}
    assert np.mean([y for x in found.values() for y in x]) >= 0.96
    clean = [prose(300) + " 2024-01-02 v1.2.3 #123 12:30 page 17" for _ in range(40)]
    assert not any(every for _, every in op1_pii.all_spans(clean, w))


def test_personal_data_rows(spark, docs):
    got = op1_pii.find_personal_data(docs.unionByName(spark.createDataFrame([(900, "a b@c.de 10.0.0.1 +49 (30) 123456, 4111-1111-1111-1111", "en", "s", 1)], docs.schema))).collect()
    rows = Counter()
    for doc_id, t, *_ in [*ROWS, (900, "a b@c.de 10.0.0.1 +49 (30) 123456, 4111-1111-1111-1111")]:
        base = sorted(plain_pii(t or ""))
        rows[doc_id, *(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(",".join(f"{op1_pii.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == rows
    assert next(r for r in got if r["doc_id"] == 900)["n_card"] == 1


def test_reconcile_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(rng.randrange(4), s, s + rng.randint(1, 5), rng.random()) for s in (rng.randrange(15) for _ in range(rng.randint(0, 7)))]
        got = op1_pii.reconcile(spans)
        score = {(k, s, e): x for k, s, e, x in sorted(spans, key=lambda z: z[3])}
        best = 0
        for mask in range(1 << len(score)):
            pick = [z for i, z in enumerate(score) if mask >> i & 1]
            if all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(pick) for b in pick[:i]):
                best = max(best, sum(score[z] for z in pick))
        assert abs(sum(score[z] for z in got) - best) < 1e-9


def test_tagger_keeps_spans_longer_than_a_window(monkeypatch):
    marked = op1_pii.encode("A")[0]

    def decode(codes, w):
        on = codes == marked
        return np.where(on, np.where(np.roll(on, 1, 1) & (np.arange(codes.shape[1]) > 0), 2, 1), 0), on * 1.0

    monkeypatch.setattr(op1_pii, "decode", decode)
    monkeypatch.setattr(op1_pii, "_TRIGGERS", re.compile("AB"))
    for n in (2, 31, 40, 50, 63, 64, 75, 300):
        for at in range(100, 164):
            text = "." * at + "AB" + "A" * (n - 2) + "." * 100
            assert op1_pii.tag_texts([text, text[at:], text[: at + n]], {}) == [[(0, at, at + n)], [(0, 0, n)], [(0, at, at + n)]], (n, at)


# ---- op2


def test_languages(spark, docs):
    got = {r["doc_id"]: r for r in op2_language.identify(docs).collect()}
    assert sum(got[i]["lang_pred"] == ("en" if i % 3 else "de") for i in range(60)) >= 57
    assert got[69]["lang_pred"] == got[70]["lang_pred"] == got[72]["lang_pred"] == "und" and got[70]["score"] == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(73))


def test_bloom_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    grams = {k: rng.integers(0, 1 << 63, 3000).astype(np.uint64) for k in ("a", "b", "c")}
    f = op2_language.Filters(["a", "b", "c"], grams)
    for i, k in enumerate("abc"):
        assert (f(grams[k]) >> np.uint8(i) & np.uint8(1)).all()


def test_more_languages_than_a_mask_holds(monkeypatch):
    rng = random.Random(41)
    own = {f"l{i:02}": [chr(0x4E00 + 40 * i + k) for k in range(12)] for i in range(70)}
    texts = {k: " ".join("".join(rng.choices(v, k=4)) for _ in range(40)) for k, v in own.items()}
    grams = {k: np.unique(np.concatenate([h for h, _ in op2_language.ngrams([t])])) for k, t in texts.items()}
    langs = sorted(grams)
    filters = op2_language.all_filters(langs, grams)
    assert [len(f.langs) for f in filters] == [64, 6]
    counts = np.hstack([f.counts([texts[k] for k in langs]) for f in filters])
    assert counts.shape == (70, 70) and (counts.argmax(axis=1) == np.arange(70)).all()


def test_scores_against_a_plain_count():
    """Popcounts of a text by looking up every n-gram by itself."""
    rng = random.Random(42)
    learned = {k: np.unique(np.concatenate([h for h, _ in op2_language.ngrams([prose(200, k, rng)])])) for k in ("de", "en")}
    f = op2_language.Filters(["de", "en"], learned)
    texts = [prose(rng.randint(0, 30), rng.choice(["de", "en"]), rng) for _ in range(20)] + ["", "1 2", "ß"]
    got = f.counts(texts)
    for t, row in zip(texts, got, strict=True):
        hashes = [x for h, _ in op2_language.ngrams([t]) for x in h]
        found = np.array([[int(f(np.array([x], np.uint64))[0]) >> i & 1 for i in range(2)] for x in hashes]).reshape(-1, 2).sum(axis=0)
        assert np.allclose(row, np.maximum(0, (found - len(hashes) * f.chance) / (1 - f.chance)))


# ---- op3


def test_leaks(docs, benchmark):
    got = {(r["doc_id"], r["item_id"]): r for r in op3_decontamination.find_leaks(docs, benchmark).collect()}
    assert (10, 1) in got and (10, 2) in got and got[10, 1]["similarity"] == 1.0 and got[10, 1]["start_word"] == 30
    norm = lambda t: f" {' '.join((t or '').lower().split())} "
    items = [(r["item_id"], norm(r["text"])) for r in benchmark.collect() if (r["text"] or "").strip()]
    assert {(d, i) for d, t, *_ in ROWS for i, q in items if q in norm(t)} <= set(got)


@pytest.mark.parametrize("bound", ["MOST_ITEMS", "MOST_CHARS"])
def test_leaks_of_a_benchmark_in_blocks(docs, benchmark, bound, monkeypatch):
    found = lambda: Counter(map(tuple, op3_decontamination.find_leaks(docs, benchmark).collect()))
    kept = lambda: Counter(map(tuple, op3_decontamination.without_leaks(docs, benchmark).collect()))
    want = found(), kept()
    monkeypatch.setattr(op3_decontamination, bound, 1)
    assert len(list(op3_decontamination.load_items(benchmark))) > 2
    assert (found(), kept()) == want


def test_index_finds_all_within_radius():
    rng = random.Random(3)
    index = op3_decontamination.Index([(i, prose(12, "en", rng).encode()) for i in range(40)])
    group = index.by_length[12]
    for _ in range(200):
        p = int(rng.choice(group).print)
        for b in rng.sample(range(64), op3_decontamination.RADIUS):
            p ^= 1 << b
        assert {i for i, x in enumerate(group) if (p ^ int(x.print)).bit_count() <= op3_decontamination.RADIUS} == {j for _, j in index.near(12, np.array([p], np.uint64))}


def plain_leaks(rows, items):
    """Every window of every item's size, by weighted shingles."""
    fold = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]

    def bag(w):
        n, out = min(5, len(w)), Counter()
        for i in range(len(w) - n + 1):
            out[tuple(w[i : i + n])] += sum(map(len, w[i : i + n]))
        return out

    found = Counter()
    for doc_id, t, *_ in rows:
        w = fold(t)
        for item_id, text in items:
            q = fold(text)
            best = None
            for s in range(len(w) - len(q) + 1 if q else 0):
                a, b = bag(w[s : s + len(q)]), bag(q)
                both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) and (best is None or both / (sum(a.values()) + sum(b.values()) - both) > best[1] + 1e-12):
                    best = s, both / (sum(a.values()) + sum(b.values()) - both)
            if best:
                found[doc_id, item_id, best[0], len(q), round(best[1], 9)] += 1
    return found


def test_leaks_against_every_window(spark):
    rng = random.Random(33)
    items = [(i, prose(rng.choice([3, 8, 15, 24, 30]), "en", rng)) for i in range(8)] + [(8, "x"), (None, prose(12, "de", rng)), (3, prose(20, "en", rng))]
    rows = []
    for i in range(60):
        w = prose(rng.randint(0, 40), "en", rng).split()
        q = rng.choice(items)[1].split()
        if i % 2 and len(q) > 3:
            for _ in range(rng.randint(0, 2)):
                q[rng.randrange(len(q))] = rng.choice(["x", "changed", q[0]])
        rows.append((i, " ".join(w[:20] + [x.upper() if i % 3 else x for x in q] + w[20:] + (q if i % 5 == 0 else [])), "en", "s"))
    got = op3_decontamination.find_leaks(spark.createDataFrame([*rows, (None, items[0][1], "en", "s"), (99, None, "en", "s")], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = plain_leaks([*rows, (None, items[0][1])], items)
    assert len(want) > 40 and Counter((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in got) == want


# ---- op4


def plain_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def near_copies():
    rng = random.Random(9)
    middle, rows = prose(80, "en", rng).split(), []
    for i in range(120):
        w = list(middle)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    shared = prose(30, "en", rng)
    return rows + [(200 + i, f"{prose(rng.randint(2, 40), 'en', rng)} {shared}", "en", "s") for i in range(60)]


@pytest.mark.parametrize("tile", [20_000, 7])
def test_jaccard_join(spark, docs, tile, monkeypatch):
    monkeypatch.setattr(op4_jaccard, "TILE", tile)
    for rows in (ROWS, near_copies()):
        got = op4_jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert Counter(tuple(r) for r in got.collect()) == plain_components(rows)


def test_bitmap_bound_is_above_the_intersection():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for _ in range(60):
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 900)))) for _ in range(2))
        assert op4_jaccard.most_common(op4_jaccard.bitmap(a), len(a), op4_jaccard.bitmap(b), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: c for x, c in parent.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_intermediate_files(spark, docs, tmp_path, monkeypatch):
    made = []

    def folder(session):
        made.append(tmp_path / str(len(made)))
        return f"file://{made[-1]}"

    monkeypatch.setattr(common, "shared_dir", folder)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("30", "false"), strict=True):
            spark.conf.set(k, v)
        got = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint"), 200).collect()
        assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(201)}
        assert len(made) > 3 and all(len(list(d.glob("part-*"))) == 1 for d in made)  # a file a round, not one a partition
        rounds = len(made)
        assert Counter(tuple(r) for r in op4_jaccard.jaccard_join(spark.createDataFrame(near_copies(), SCHEMA)).collect()) == plain_components(near_copies())
        assert not any(p.name.startswith((".", "_")) for d in made[rounds:] for p in d.iterdir())  # no checksum files, no marks of success
        monkeypatch.setattr(common, "FILE_ROWS", 50)
        rows = common.written(spark.range(0, 200, 1, 30), most=200)
        assert len(list(made[-1].glob("part-*"))) == 4 and sorted(r["id"] for r in rows.collect()) == list(range(200))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---- op5


def test_toxicity(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(300):
        w = prose(60, "en", rng).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblefool", "nastywart"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 4 == 0)))
    got = op5_toxicity.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_marks_of_a_small_language():
    rng = random.Random(12)
    text = lambda lang, *more: (" ".join(rng.sample(w := prose(60, lang, rng).split() + list(more), len(w))), lang)
    toxic = [text("en", *(["grumblefool"] * 2)) for _ in range(1480)] + [text("de", "ekelwicht") for _ in range(20)]
    got = op5_toxicity.marks(toxic, [text("en") for _ in range(300)] + [text("de") for _ in range(100)])
    assert b" grumblefool " in got and b" ekelwicht " in got  # 20 contexts are fewer than 1.5 % of all toxic texts
    again = op5_toxicity.marks(toxic + toxic[:1] * 50 + [("einmal " * 50, "de")] * 20, [text("de") for _ in range(100)])
    assert b" einmal " not in again  # copies and repetitions count once


def test_distance_is_the_difference_of_compressed_lengths():
    import zstandard as z

    rng = random.Random(15)
    ordinary = " ".join(prose(40, "en", rng) for _ in range(20)).encode()
    toxic = b" grumblefool  nastywart " + ordinary
    distance = op5_toxicity.Distance(ordinary, toxic)
    size = lambda raw, x, level: len(z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for text in (prose(60, "en", rng), f"{prose(30, 'en', rng)} Grumblefool {prose(30, 'en', rng)}", "nastywart", "x", f"{'ö' * 300} nastywart grumblefool"):
        b = b" " + b" ".join(text.lower().encode().split()) + b" "
        parts = [x if len(x) >= 64 else x + ordinary[-64:] for x in (b[i : i + 128] for i in range(0, max(1, len(b) - 64), 64))]
        first = [size(ordinary, x, 6) - size(toxic, x, 6) for x in parts]
        best = max([0, *(size(ordinary, x, 19) - size(toxic, x, 19) for x, f in zip(parts, first, strict=True) if f > 0)])
        assert distance(text) == (best, sum(first) / len(parts))
        assert (best > 2) == ("grumblefool" in text.lower() or "nastywart" in text)


# ---- op6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    out = [(0, *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_secrets(spark):
    rng = random.Random(4)
    texts = ["", "".join(rng.choices("0123456789abcdef", k=40)), "TOKEN = 'abcdef' apikey:xyz passwd=123456", "AKIA" + "A" * 16 + "-AKIAB"]
    for _ in range(300):
        texts.append("".join(rng.choices(["token", "=", ": ", "'", "api_key", "AKIA", "ABCDEF0123456789", "0a1b2c3d", "x", " ", "ſecret"], k=rng.randint(1, 14))))
    secret = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48))
    texts += [f"{prose(30)} {secret} {prose(30)}", f"{'the' * 16} {prose(2000)}"]
    for t in texts:
        assert op6_secrets.base_spans(t) == plain_secrets(t), t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in op6_secrets.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{op6_secrets.KINDS[k]}:{s}:{e}" for k, s, e in plain_secrets(t))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    at = texts[-2].index(secret)
    assert got[len(texts) - 2]["spans"] == f"random:{at}:{at + 48}" and got[len(texts) - 1]["spans"] == ""


def test_secrets_joined_to_other_text(spark):
    rng = random.Random(14)
    token = lambda n, more="": "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more, k=n))
    secrets = [token(64, "+/") + "==", token(56), token(60), token(60), "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", k=80))]
    texts = [f"AccountKey={secrets[0]}", f"sig={secrets[1]}", f"my-own_path/{secrets[2]}", f"{secrets[3]}=the-rest+of/it", secrets[4]]
    rows = [(i, f"{prose(40)} {t} {prose(40)}") for i, t in enumerate(texts)] + [(9, prose(2000)), (10, "=".join(["the"] * 40))]
    got = {r["doc_id"]: r["spans"] for r in op6_secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for (i, t), x in zip(rows, secrets, strict=False):
        a, b = t.index(x), t.index(x) + len(x)
        assert any(s.split(":")[0] == "random" and a <= int(s.split(":")[1]) and int(s.split(":")[2]) <= b for s in got[i].split(",") if s), (i, got[i])
    assert got[9] == got[10] == ""


def test_random_spans_against_a_plain_version(spark):
    rng = random.Random(17)
    texts = [prose(200, "en", rng) + " someOrdinaryIdentifierName and_a_longer_snake_case_name 2024-01-02-some-release-notes" for _ in range(120)]
    planted, codes = {}, op6_secrets.ENCODINGS
    for i, (name, n) in enumerate((k, n) for k in ("hex", "HEX", "base36", "base64", "base64url", "base32") for n in (20, 24, 32, 48, 100) for _ in range(4)):
        token = "".join(rng.choices(codes[name].replace("=", ""), k=n))
        if name == "hex" and n >= 24:
            token = token.upper()  # else a base span
        planted[i] = (name, n, token)
        texts[i] += f" {token} {prose(5, 'en', rng)}"
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (500, None), (501, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in op6_secrets.find_secrets(df).collect()}
    # the same by sorting the p-values of distinct tokens
    pairs = np.zeros((256, 256), np.int64)
    for t in texts + [texts[0]]:
        b = re.sub("[A-Za-z0-9+/_=-]{20,}", "\n", t).encode()
        for x, y in zip(b, b[1:], strict=False):
            pairs[x, y] += 1
    usual = op6_secrets.Ordinary(pairs)
    scans = {i: op6_secrets.scan(t) for i, t in enumerate(texts)}
    p_of = {texts[i][f[0] : f[1]]: (f[3], usual.p_value(*f[2:8])) for i, (_, found) in scans.items() for f in found}
    passed = set()
    for low, high in zip(op6_secrets.BANDS, (*op6_secrets.BANDS[1:], 10**9), strict=True):
        own = sorted((-op6_secrets.step(p), t) for t, (n, p) in p_of.items() if low <= n < high)
        k = max([i + 1 for i, (s, _) in enumerate(own) if 10 ** (s / 100) * len(own) <= op6_secrets.FDR * sum(x <= s for x, _ in own)], default=0)
        passed |= {t for s, t in own if k and s <= own[k - 1][0]}
    for i, t in enumerate(texts):
        random_spans = {t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[i].split(",") if x.startswith("random")}
        assert random_spans == {t[f[0] : f[1]] for f in scans[i][1]} & passed
    assert got[500] == got[501] == ""
    found = {k: np.mean([p in passed for name, n, p in planted.values() if (name, n) == k]) for k in {(name, n) for name, n, _ in planted.values()}}
    assert np.mean([x for (_, n), x in found.items() if n >= 24]) >= 0.95 and np.mean([x for (_, n), x in found.items() if n == 20]) >= 0.8, found
    assert not any(x in p for p in passed for x in ("Identifier", "snake", "release"))


# ---- op7


def test_quality_rules(docs):
    got = {r["doc_id"]: r for r in op7_quality.quality_rules(docs).collect()}
    for doc_id, t, *_ in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(60)) and not got[64]["kept"] and not got[65]["kept"]


# ---- op8


def plain_substrings(rows):
    first = {}
    for doc_id, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 12 if doc_id is not None else 0):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, doc_id), doc_id)
    want = Counter()
    for doc_id, t, *_ in rows:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - 12 if doc_id is not None else 0):
            if first[tuple(w[i : i + 13])] < doc_id:
                gone |= set(range(i, i + 13))
        want[doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return want


def common_words():
    """Every text is full of one 3-word sequence, and they share long passages."""
    rng = random.Random(21)
    text = lambda n: [x for _ in range(n) for x in ("to", "be", "or", rng.choice("abcdefgh") * rng.randint(1, 3))]
    shared = [text(12) for _ in range(4)]
    return [(i, "  ".join(text(rng.randint(1, 20)) + rng.choice(shared) + text(5) + rng.choice(shared) + ["\n"]), "en", "s") for i in range(60)]


@pytest.mark.parametrize("change", [{}, {"HOT": 0, "SAMPLE": 1}, {"windows": lambda h, n: op8_windows(h, n) % np.uint64(3 if n == 13 else 7)}, {"BLOCK": 500}])
def test_substrings(spark, docs, change, monkeypatch):
    for k, v in change.items():
        monkeypatch.setattr(op8_substrings, k, v)
    few = [r for r in ROWS if len(r[1] or "") < 5000]
    for rows in (ROWS if "windows" not in change else few, common_words()):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if "windows" in change:  # closures carry functions of modules by name, so a weak hash is tried in this process
            c = op8_substrings._chunk([(b" ".join(t.encode().split()), d, op8_substrings.row_key(t.encode()), 0) for d, t, *_ in rows if d is not None and len((t or "").split()) > 12])
            matched, found = op8_substrings.factors(c, c.new)
            least = {}
            for i in range(len(c.h)):
                w = c.text[c.first[i] : c.end[i]]
                least[w] = min(least.get(w, c.doc[i]), c.doc[i])
            assert matched.tolist() == [bool(least[c.text[a:b]] < d) for a, b, d in zip(c.first, c.end, c.doc, strict=True)] and found["len"].sum() == matched.sum()
            continue
        got = op8_substrings.deduplicated(df, full=True).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_substrings(rows)
        text = {d: (t or "").split() for d, t, *_ in rows}
        for r in got:
            for f in r["factors"]:
                assert f["n_words"] >= 13 and text[r["doc_id"]][f["start"] : f["start"] + f["n_words"]] == text[f["ref_doc_id"]][f["ref_start"] : f["ref_start"] + f["n_words"]]


op8_windows = op8_substrings.windows


def test_pieces_have_each_window_once():
    rng = random.Random(22)
    for _ in range(200):
        w = ["x" * rng.choice([1, 2, 9, 60]) + str(i) for i in range(rng.randint(0, 90))]
        got = [(first + i, tuple(p[i : i + 13])) for piece, first in op8_substrings.pieces(" ".join(w).encode(), rng.choice([20, 100, 400])) for p in [piece.decode().split()] for i in range(len(p) - 12)]
        assert got == [(i, tuple(w[i : i + 13])) for i in range(len(w) - 12)]


def test_parse_takes_the_factor_that_reaches_furthest():
    found = np.array([(9, 0, 0, 5, 1, 10), (9, 0, 0, 3, 2, 0), (9, 0, 3, 6, 2, 3), (9, 0, 9, 1, 3, 0), (9, 0, 20, 2, 1, 0)], op8_substrings.FACTOR)
    assert op8_substrings.parse(found) == [(0, 21, 2, 0), (9, 13, 3, 0), (20, 14, 1, 0)]


# ---- op9


def test_weights_are_the_same_in_any_batch():
    rng = random.Random(31)
    texts = [prose(rng.randint(0, 300), rng.choice(["en", "de"]), rng).encode() for _ in range(120)] + [b"", b"x", b"ab"]
    ratio = op9_resampling.log_ratio(*(np.random.default_rng(k).integers(0, 900, op9_resampling.BUCKETS).astype(float) for k in (1, 2)))
    alone = [int(op9_resampling._weights([t], ratio)[0]) for t in texts]
    assert op9_resampling._weights(texts, ratio).tolist() == alone and alone[-3] == 0
    for t, w in zip(texts[:20], alone, strict=False):  # against a plain sum over n-grams
        total = n = 0
        for k in op9_resampling.SIZES:
            for i in range(len(t) - k + 1):
                total, n = total + int(ratio[op9_resampling.grams([t[i : i + k]])[0][k - 1, 0]]), n + 1
        assert w == (total if n <= op9_resampling.EVIDENCE else total * op9_resampling.EVIDENCE // n)


def test_resampling(spark, docs, labels):
    labels = labels.where("doc_id != 63 and doc_id != 62")  # so that some are unlabelled
    got = op9_resampling.importance(docs, labels).collect()
    kept = Counter(r["doc_id"] for r in got if r["kept"])
    assert set(range(60)) <= set(kept) and not set(kept) & {64, 65}
    quality = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null and doc_id is not null").orderBy("quality").collect()}
    weight = {v: np.array([r["log_weight"] for r in got for x in labels.where("quality is not null").collect() if x["doc_id"] == r["doc_id"] and r["doc_id"] is not None and x["quality"] == v]) for v in (0, 1)}
    assert quality and len(weight[0])
    k = sum(r["log_weight"] >= op9_resampling.best_cut(weight[1], weight[0]) for r in got)
    least = sorted((r["perturbed"] for r in got), reverse=True)[k - 1]
    assert Counter(r["doc_id"] for r in got if r["perturbed"] >= least) == kept
    for r in got:  # each its own noise, a Gumbel variable
        assert -3.1 < r["perturbed"] - r["log_weight"] < 37
    for rows in (docs, docs.repartition(7), docs.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("noise"))):
        stay = op9_resampling.resampled(rows, labels)
        assert stay.schema == rows.schema and Counter(r["doc_id"] for r in stay.collect()) == kept
    twice = op9_resampling.resampled(docs.unionByName(docs), labels)
    assert all(n % 2 == 0 for n in Counter(r["doc_id"] for r in twice.collect()).values())


def test_kth_largest(spark):
    rng = random.Random(2)
    xs = [rng.getrandbits(64) for _ in range(200)] * 2
    keys = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in xs], "key bigint")
    for k in (1, 2, 77, 400):
        assert op9_resampling._kth_largest(keys, k) == sorted(xs, reverse=True)[k - 1]


# ---- op10


def test_byte_bpe_equals_tiktoken(docs):
    import tiktoken

    path, pattern = tokenizer()
    bpe = op10_bpe.load(path, pattern)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "B", " ", "  ", "\n", "é", "ß", "1", "½", "'s", "'", "日", "😀", "​", "\x85", "\x1c", "ſ", "!?"], k=rng.randint(0, 60))) for _ in range(600)]
    for t in texts:
        assert bpe.encode(t) == plain.encode_ordinary(t) and bpe.decode(bpe.encode(t)) == t.encode(), repr(t)
    got = op10_bpe.encode_documents(docs, path, pattern, full=True).collect()
    ids = lambda t: ",".join(map(str, plain.encode_ordinary(t or "")))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == Counter((d, len(plain.encode_ordinary(t or "")), hashlib.sha256(ids(t).encode()).hexdigest()) for d, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ROWS)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in got)


# ---- pipeline


def test_pipeline(spark, docs, labels, benchmark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        after.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    ids = [r["doc_id"] for r in rows.collect()]
    assert ids.count(0) == 1 and 60 not in ids and 61 not in ids and 10 not in ids and 64 not in ids and 20 in ids
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in done) == Counter(ids)


def test_stages_on_empty_tables_absent_labels_and_clashing_names(spark, docs, labels, benchmark):
    names = docs.columns
    none = docs.where("false")
    clash = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("TEXT", "Doc_ID", "row", "id", "noise", "c0"))))
    stages = {
        "quality": lambda d, lab, b: op9_resampling.resampled(d, lab),
        "near_duplicates": lambda d, lab, b: op4_jaccard.representatives(d),
        "decontamination": lambda d, lab, b: op3_decontamination.without_leaks(d, b),
        "personal_data": lambda d, lab, b: op1_pii.redact(d),
    }
    for name, stage in stages.items():
        assert stage(none, labels.where("false"), benchmark.where("false")).collect() == [], name
        got = stage(clash, labels, benchmark)
        assert got.columns == clash.columns, name
        plain = stage(docs, labels, benchmark)
        assert plain.columns == names
        assert Counter(r[0] for r in got.collect()) == Counter(r[0] for r in plain.collect()), name
    assert op9_resampling.resampled(docs, labels.where("false")).count() == docs.count()
    blank = op4_jaccard.representatives(docs.unionByName(docs.where("doc_id in (69, 70, 71, 1)"))).collect()
    assert Counter(r["doc_id"] for r in blank if r["doc_id"] in (69, 70, 71, 1)) == {69: 2, 70: 2, 71: 2, 1: 1}  # wordless rows all stay


def test_very_long_texts(spark):
    rng = random.Random(51)
    long = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=260_000))
    rows = [(1, long), (2, "x" + long[1:]), (3, "a" * 1_500_000), (4, "\n" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(long) > 1_000_000
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_substrings.deduplicated(df).collect()) == plain_substrings(rows)
    assert Counter(tuple(r) for r in op4_jaccard.jaccard_join(df).collect()) == plain_components(rows)
    assert op2_language.identify(df).count() == op6_secrets.find_secrets(df).count() == op7_quality.quality_rules(df).count() == 4
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in op10_bpe.encode_documents(df.where("doc_id != 3"), *tokenizer()).collect()}
    assert decoded == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows if d != 3}
