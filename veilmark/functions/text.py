"""Column helpers that the detectors and rewriters are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode classes, and only \n ends a line
FLAGS = "(?U)(?d)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


CHUNK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(sizes: Column) -> Column:
    """For each of an array of integers the sum of those before it.

    By chunks, so the arrays that grow in an aggregate stay short: time is linear up to many thousands.
    """
    total = "struct<at:int,out:array<int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(total)

    def sums(xs: Column, size: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(total))

    def whole(xs: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        chunks = F.transform(firsts, lambda i: sums(F.slice(xs, i * CHUNK + 1, CHUNK), lambda x: x))
        return let(chunks, lambda c: F.flatten(F.zip_with(c, sums(c, lambda x: x["at"])["out"], lambda x, first: F.transform(x["out"], lambda v: v + first))))

    return let(sizes, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, groups: tuple[int, ...] = (), dense: bool = False) -> Column:
    """array<struct<m, start, g1, ...>>: each match, its first character and the wanted groups.

    dense: for texts of many thousands of matches, in time linear in them; a larger expression, which plans of
    many detectors over short texts need not carry.
    """
    p = F.lit(pattern)
    names = ["m", *(f"g{g}" for g in groups)]
    found = [F.regexp_extract_all(text, p, g).alias(n) for n, g in zip(names, (0, *groups), strict=True)]
    gaps = F.split(text, pattern, -1)
    row = lambda x, start: F.struct(x["m"].alias("m"), start.alias("start"), *(x[n].alias(n) for n in names[1:]))

    def placed(x: Column) -> Column:
        own = F.slice(x["gaps"], F.lit(1), F.size(x["m"]))  # the last gap has no match after it
        before = running(F.zip_with(own, x["m"], lambda g, m: F.length(g) + F.length(m)))
        start = F.zip_with(before, own, lambda at, g: at + F.length(g))
        return F.transform(F.arrays_zip(*(x[n].alias(n) for n in names), start.alias("start")), lambda r: row(r, r["start"]))

    if dense:
        return let(F.struct(gaps.alias("gaps"), *found), placed)
    kind = "struct<m:string,start:int" + "".join(f",{n}:string" for n in names[1:]) + ">"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        more = x["m"].isNotNull()
        return F.struct(F.when(more, at + F.length(x["m"])).otherwise(at).alias("at"), F.when(more, F.concat(acc["out"], F.array(row(x, at)))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(*found, gaps.alias("gap")), begin, step, lambda acc: acc["out"])


def replace_matches(text: Column, pattern: str, how: Callable[[Column], Column]) -> Column:
    """text with each match m replaced by how(m)."""
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return F.array_join(F.transform(rows, lambda x: F.concat(x["gap"], F.when(x["m"].isNull(), F.lit("")).otherwise(how(x["m"])))), "")
