"""Chunks of text members: service sections, each with its name and first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running

MARKER = r"(?m)(?d)^(?=DUMP OF SERVICE [^:\n]+:)"
_NAME = r"^DUMP OF SERVICE ([^:\n]+):"


def sections(text: Column, preamble: bool = True) -> Column:
    """array<struct<name, start_line, body>>; text before the first marker has no name."""
    def numbered(parts: Column) -> Column:
        lines = running(F.transform(parts, lambda p: F.regexp_count(p, F.lit("\n"))))
        rows = F.zip_with(parts, lines, lambda p, n: F.struct(F.nullif(F.regexp_extract(p, _NAME, 1), F.lit("")).alias("name"), (n + 1).alias("start_line"), p.alias("body")))
        return F.filter(rows, lambda s: s["body"] != "")

    out = let(F.split(text, MARKER, -1), numbered)
    named = lambda s: s["name"].isNotNull()
    return out if preamble else let(out, lambda rows: F.when(F.exists(rows, named), F.filter(rows, named)).otherwise(rows))


def explode_sections(df: DataFrame, text: str = "text", preamble: bool = True) -> DataFrame:
    """A row for each section, with chunk_no, section, start_line and text for the text column."""
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(sections(F.col(text), preamble)).alias("chunk_no", "s"))
    return rows.select(*keep, "chunk_no", F.col("s.name").alias("section"), F.col("s.start_line").alias("start_line"), F.col("s.body").alias(text))


def section_named(text: Column, service: str) -> Column:
    """Body of the first section of a service, up to the next marker or a dashed rule; null without one."""
    found = F.regexp_extract(text, rf"(?s)(?d)DUMP OF SERVICE \Q{service}\E:(.*?)(?=\nDUMP OF SERVICE |\n------|\z)", 1)
    return F.when(text.contains(f"DUMP OF SERVICE {service}:"), found)
