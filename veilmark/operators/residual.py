"""The residual gate: what identifiers are left after rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.pseudonym import has_known_shape
from ..functions.seal import TOKEN
from ..functions.text import spans
from ..kinds import CONFIDENCE, MEDIUM
from ..sources.sections import sections


def residual_hits(text: Column, context: str = "none", dense: bool = False) -> Column:
    """Hits of Medium confidence or more; context 'section' scans each section with its name."""
    if context == "none":
        return detect.residual(detect.Context(text, dense=dense))
    each = F.transform(sections(text), lambda s: detect.scan(detect.Context(s["body"], s["name"])))
    return F.filter(F.flatten(each), lambda h: h["confidence"] >= MEDIUM)


def outside_tokens(hits: Column, text: Column) -> Column:
    """Hits that do not lie inside a sealed token."""
    tokens = spans(text, TOKEN)
    return F.filter(hits, lambda h: ~F.exists(tokens, lambda t: (h["start"] >= t["start"]) & (h["end"] <= t["start"] + F.length(t["m"]))))


def findings(rewritten: DataFrame, mapping: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("archive_id",), context: str = "none", dense: bool = False) -> DataFrame:
    """findings(keys, member, kind, confidence, snippet_len) of rewritten(keys, member, handler, text).

    Not counted: replacements of the run, values with a pseudonym's shape, kinds whose entities are
    kept(keys, kind, canonical), values inside sealed tokens, image identifiers of crash reports.
    """
    text = F.col("text")
    hits = rewritten.select(*keys, "member", "handler", F.explode(outside_tokens(residual_hits(text, context, dense), text)).alias("h")).select(*keys, "member", "handler", "h.kind", "h.value", "h.canonical", "h.confidence")
    hits = hits.where(~has_known_shape(F.col("value")) & ~((F.col("handler") == "ips") & F.col("kind").isin("uuid", "container_uuid")))
    made = mapping.where("replacement is not null").select(*keys, F.explode(F.array("replacement", F.lower("replacement"), F.upper("replacement"))).alias("value")).distinct()
    left = hits.join(made, [*keys, "value"], "left_anti").join(kept.select(*keys, "kind", "canonical").distinct(), [*keys, "kind", "canonical"], "left_anti")
    return left.select(*keys, "member", "kind", F.element_at(F.array(*(F.lit(x) for x in CONFIDENCE)), F.col("confidence") + 1).alias("confidence"), F.length("value").alias("snippet_len"))


def status(found: DataFrame, archives: DataFrame, research: bool, keys: tuple[str, ...] = ("archive_id",)) -> DataFrame:
    """(keys, n_findings, status): clean, or warnings under research, or failed."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n_findings"))
    rows = archives.select(*keys).distinct().join(n, list(keys), "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n_findings") == 0, F.lit("clean")).otherwise(F.lit("warnings" if research else "failed")))
