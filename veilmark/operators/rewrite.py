"""Text rewriting: coordinates, package lines, surfaces longest first, time stamps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAGS
from ..functions.timeshift import shift_text
from ..plans.policy import Options

PAIRS = "array<struct<surface:string,replacement:string>>"


def longest_first(rows: Column) -> Column:
    """Surfaces by falling length in bytes, then by text."""
    size = lambda x: F.octet_length(x["surface"])
    return F.array_sort(rows, lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).when(a["surface"] < b["surface"], -1).when(a["surface"] > b["surface"], 1).otherwise(0))


def apply_surfaces(text: Column, pairs: Column) -> Column:
    """Each surface that the text holds replaced everywhere, one after the other, so later ones see earlier results."""
    return F.when(text.isNull(), text).otherwise(F.aggregate(F.coalesce(pairs, F.array().cast(PAIRS)), text, lambda acc, p: F.replace(acc, p["surface"], p["replacement"])))


def surface_pairs(surfaces: DataFrame, *keys: str) -> DataFrame:
    """pairs(keys, pairs): a key's surfaces, longest first. A key is an archive or a record, whose surfaces fit in a row."""
    return surfaces.groupBy(*keys).agg(longest_first(F.collect_list(F.struct("surface", "replacement"))).alias("pairs"))


MANY = 64  # surfaces from which on an automaton looks for those that a text holds


def replacer(pairs: list[tuple[str, str]]) -> Callable[[str], str]:
    """A function of a text: itself where it is a surface, else as apply_surfaces does it. pairs: longest first.

    With MANY pairs or more an Aho-Corasick automaton finds all places in one pass; of overlapping ones the
    first surface in the order of pairs is replaced. Where a replacement makes a surface, the surfaces that occur are
    replaced one after the other instead.
    """
    whole = dict(pairs)
    pairs = [(s, r) for s, r in pairs if s != r]
    if len(pairs) < MANY:
        return lambda text: whole[text] if text in whole else in_turn(text, pairs)
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, (s, _) in enumerate(pairs):
        machine.add_word(s, i)
    machine.make_automaton()

    def change(text: str) -> str:
        if text in whole:
            return whole[text]
        found = sorted((i, end + 1 - len(pairs[i][0])) for end, i in machine.iter(text))
        taken, chosen = bytearray(len(text)), []
        for i, at in found:
            end = at + len(pairs[i][0])
            if taken.find(1, at, end) < 0:
                taken[at:end] = b"\x01" * (end - at)
                chosen.append((at, end, i))
        out, upto = [], 0
        for at, end, i in sorted(chosen):
            out += [text[upto:at], pairs[i][1]]
            upto = end
        new = "".join([*out, text[upto:]])
        if found and next(machine.iter(new), None):
            at = -1
            while (at := min((i for _, i in machine.iter(text) if i > at), default=-1)) >= 0:
                text = text.replace(*pairs[at])
            return text
        return new

    return change


def in_turn(text: str, pairs: list[tuple[str, str]]) -> str:
    for s, r in pairs:
        text = text.replace(s, r)
    return text


_in_turn = in_turn  # its name in tests


def finder(names: list[str]) -> Callable[[str], bool]:
    """Whether a text holds one of the names."""
    if len(names) < MANY:
        return lambda text: any(n in text for n in names)
    import ahocorasick

    machine = ahocorasick.Automaton()
    for n in names:
        machine.add_word(n, True)
    machine.make_automaton()
    return lambda text: next(machine.iter(text), None) is not None


# The block of a location service's dump, and the note for a dropped line.
LINE_NOTE = "<log line dropped>"
GPS_BLOCK = r"\{([^,]+),\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+(±[^,}]*)?"


def drop_gps(text: Column) -> Column:
    return F.regexp_replace(text, FLAGS + GPS_BLOCK, "{$1, <redacted>$2")


def drop_package_lines(text: Column, packages: tuple[str, ...]) -> Column:
    """Lines that name a package become a note; a carriage return goes with the line."""
    if not packages:
        return text
    named = "|".join(re.escape(p) for p in packages)
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(named), F.lit(LINE_NOTE)).otherwise(x)), "\n")


def before_surfaces(text: Column, options: Options, gps_dropped: Column | bool = False) -> Column:
    gps = gps_dropped if isinstance(gps_dropped, Column) else F.lit(gps_dropped)
    out = text if options.mode == "encrypt" else F.when(gps, drop_gps(text)).otherwise(text)
    return drop_package_lines(out, options.drop_text_from_packages)


def after_surfaces(text: Column, options: Options) -> Column:
    return text if options.time_shift is None else shift_text(text, options.time_shift, options.time_shift_mode)


def rewrite_text(text: Column, pairs: Column, options: Options, gps_dropped: Column | bool = False) -> Column:
    return after_surfaces(apply_surfaces(before_surfaces(text, options, gps_dropped), pairs), options)
