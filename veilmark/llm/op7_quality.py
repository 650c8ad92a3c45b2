"""Quality rules with adaptive thresholds per language and source.

Base measures of every whole text; documents under 50 words, or with over half their words in
repeated 3-word windows, fail. Of the rest, four integer ratios are counted into a quantile
sketch of fixed bins: its counts add up, so partial sketches merge in any order to the same
sketch. Quartiles come from the sketch of the document's language and source, or of its language,
or of all, whichever is the first with LEAST documents; a ratio beyond its fence, the quartiles
widened by SPREAD times their distance and a slack, fails the document. The fences are joined to
the documents again.

Null text counts as empty (it fails the base rules). Null lang or source is a value like any
other. Repeated rows give repeated rows; a null doc_id stays null. A ratio on its
fence stays; ratios beyond the last bin count as that bin. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, binary, blocks, mix, only, windows, words, written

LEAST = 100
SPREAD = 3
#: ratio: expression, largest bin, slack, whether small values fail too
RATIOS = {
    "word_length": ("10 * word_chars div n_words", 1000, 15, True),
    "symbols": ("1000 * n_symbols div n_words", 5000, 150, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 1000, 150, False),
    "repeats": ("1000 * n_repeat_words div n_words", 1000, 150, False),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def _counts(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_repeat_words of each text of a block."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    block = b"\n".join(texts)
    s, e, h = words(block, fold=False)
    b = np.frombuffer(block, np.uint8)
    bound = np.searchsorted(s, at)

    def per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[np.minimum(cuts, len(flags))])

    first = (b & 0xC0) != 0x80
    total = np.zeros(len(b) + 1, np.int64)
    np.cumsum(first, out=total[1:])
    chars = np.zeros(len(s) + 1, np.int64)
    np.cumsum(total[e] - total[s], out=chars[1:])
    covered = np.zeros(len(s), bool)
    if len(s) >= 3:
        own = np.repeat(np.arange(len(texts)), np.diff(bound))
        whole = np.flatnonzero(own[2:] == own[:-2])
        key = mix(windows(h, 3)[whole] + own[whole].astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at_word = whole[again]
        for k in range(3):
            covered[at_word + k] = True
    return np.stack([np.diff(bound), np.diff(chars[bound]), per_text(_SYMBOL[b], at), per_text(covered, bound)])


def _lines(text: bytes) -> tuple[int, int]:
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column("text"))
            for a, b in blocks(texts):
                n_words, chars, symbols, repeats = _counts(texts[a:b])
                lines = np.array([_lines(t) for t in texts[a:b]], np.int64).reshape(-1, 2)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), *map(pa.array, (n_words, chars, symbols, lines[:, 1], repeats, lines[:, 0]))], names=[x.split()[0] for x in _BASE.split(", ")])

    return only(docs, "doc_id", "lang", "source", "text").mapInArrow(run, _BASE)


def fences(rated: DataFrame) -> DataFrame:
    """(level, lang, source) with the low and high fence of each ratio; only levels with LEAST documents."""
    tall = rated.where("not base_failed").selectExpr("lang", "source", f"stack({len(RATIOS)}, {', '.join(f"'{k}', r_{k}" for k in RATIOS)}) as (ratio, bin)")
    fine = tall.groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n"))
    levels = [fine.select(F.lit(0).alias("level"), "lang", "source", "ratio", "bin", "n")]
    levels += [fine.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "ratio", "bin", "n")]
    levels += [fine.groupBy("ratio", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "ratio", "bin", "n")]
    sketch = levels[0].unionByName(levels[1]).unionByName(levels[2])
    w = Window.partitionBy("level", "lang", "source", "ratio")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("of", F.sum("n").over(w))
    quartiles = (
        ranked.groupBy("level", "lang", "source", "ratio")
        .agg(F.max("of").alias("of"), F.expr("min(bin) filter (where 4 * upto >= of)").alias("q1"), F.expr("min(bin) filter (where 4 * upto >= 3 * of)").alias("q3"))
        .where(F.col("of") >= LEAST)
    )
    slack = F.coalesce(*(F.when(F.col("ratio") == k, F.lit(v[2])) for k, v in RATIOS.items()))
    wide = quartiles.withColumn("low", F.col("q1") - SPREAD * (F.col("q3") - F.col("q1")) - slack).withColumn("high", F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + slack)
    return wide.groupBy("level", "lang", "source").agg(*(F.expr(f"max({side}) filter (where ratio = '{k}')").alias(f"{side}_{k}") for k in RATIOS for side in ("low", "high")))


def quality_rules(docs: DataFrame) -> DataFrame:
    base = written(measures(docs), narrow=True)
    rated = base.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    for k, (how, most, _, _) in RATIOS.items():
        rated = rated.withColumn(f"r_{k}", F.expr(f"if(n_words = 0, 0, least({how}, {most}))" if "n_lines" not in how else f"if(n_lines = 0, 0, least({how}, {most}))"))
    fence = fences(rated)
    sides = [f"{side}_{k}" for k in RATIOS for side in ("low", "high")]
    at = [fence.where(F.col("level") == i).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(F.col(x).alias(f"{x}_{i}") for x in sides)) for i in range(3)]
    joined = rated.join(at[0], F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    joined = joined.join(at[1], F.col("lang").eqNullSafe(F.col("f_lang")), "left").drop("f_lang", "f_source")
    joined = joined.join(F.broadcast(at[2]), F.lit(True), "left")  # one row
    inside = F.lit(True)
    for k, (_, _, _, both) in RATIOS.items():
        low, high = (F.coalesce(*(F.col(f"{side}_{k}_{i}") for i in range(3))) for side in ("low", "high"))
        inside &= F.coalesce(F.col(f"r_{k}") <= high, F.lit(True)) & (F.coalesce(F.col(f"r_{k}") >= low, F.lit(True)) if both else F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _case(side: str, k: str) -> str:
    return f"coalesce(f0.{side}_{k}, f1.{side}_{k}, f2.{side}_{k})"


def oracle() -> str:
    """The same rows in DuckDB."""
    ratio = {k: f"least({how.replace(' div ', ' // ')}, {most})" for k, (how, most, _, _) in RATIOS.items()}
    ratio = {k: f"case when {'n_lines' if 'n_lines' in x else 'n_words'} = 0 then 0 else {x} end" for k, x in ratio.items()}
    slack = " ".join(f"when '{k}' then {v[2]}" for k, v in RATIOS.items())
    tests = " and ".join([f"coalesce(r_{k} <= {_case('high', k)}, true)" for k in RATIOS] + [f"coalesce(r_{k} >= {_case('low', k)}, true)" for k, v in RATIOS.items() if v[3]])
    picks = ", ".join(f"max({side}) filter (where ratio = '{k}') as {side}_{k}" for k in RATIOS for side in ("low", "high"))
    tall = " union all ".join(f"select lang, source, '{k}' as ratio, r_{k} as bin from rated where not base_failed" for k in RATIOS)
    return rf"""
    with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
    w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
    t as (select rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as g from w, unnest(range(1, len(ws) - 1)) as u(i)),
    r as (select rid, i from (select *, count(*) over (partition by rid, g) as c from t) where c > 1),
    rw as (select rid, count(distinct j) as n from (select rid, i + k as j from r, unnest([0, 1, 2]) as u(k)) group by rid),
    l as (select rid, unnest(string_split(text, chr(10))) as line from d),
    ln as (select rid, count(*) as n, count(distinct line) as nd from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
    base as (select d.rid, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(ln.n - ln.nd, 0)::bigint as n_dup_lines,
      coalesce(rw.n, 0)::bigint as n_repeat_words, coalesce(ln.n, 0)::bigint as n_lines
      from d join w using (rid) left join rw using (rid) left join ln using (rid)),
    rated as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"{x} as r_{k}" for k, x in ratio.items())} from base),
    tall as ({tall}),
    sketch as (select grouping(lang, source) as g, lang, source, ratio, bin, count(*) as n from tall group by grouping sets ((lang, source, ratio, bin), (lang, ratio, bin), (ratio, bin))),
    ranked as (select *, sum(n) over (partition by g, lang, source, ratio order by bin) as upto, sum(n) over (partition by g, lang, source, ratio) as tot from sketch),
    q as (select g, lang, source, ratio, max(tot) as tot, min(bin) filter (where 4 * upto >= tot) as q1, min(bin) filter (where 4 * upto >= 3 * tot) as q3 from ranked group by all having max(tot) >= {LEAST}),
    fence as (select *, q1 - {SPREAD} * (q3 - q1) - case ratio {slack} end as low, q3 + {SPREAD} * (q3 - q1) + case ratio {slack} end as high from q),
    f as (select g, lang, source, {picks} from fence group by g, lang, source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {tests} as kept
    from rated left join (select * from f where g = 0) f0 on rated.lang is not distinct from f0.lang and rated.source is not distinct from f0.source
    left join (select * from f where g = 1) f1 on rated.lang is not distinct from f1.lang left join (select * from f where g = 3) f2 on true
    """
