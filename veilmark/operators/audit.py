"""The report of a run: JSON and Markdown for each archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Options

VERSION = "0.1.0"
LIMITATIONS = (
    "Free text is scanned by patterns; names and places outside known contexts may remain.",
    "Behaviour (times, sequences, installed applications) remains and may identify a person.",
)


def divergences(resolved: DataFrame, options: Options, keys: tuple[str, ...] = ("archive_id",)) -> DataFrame:
    """(keys, declared): what the rewritten archive cannot answer like the original."""
    gps = F.bool_or((F.col("kind") == "gps_coordinate") & (F.col("action") == "drop"))
    fixed = [name for name, on in (("time.shifted", options.time_shift is not None), (f"logarchive.{options.logarchive}", True), ("lines.dropped", bool(options.drop_text_from_packages))) if on]
    made = F.array_compact(F.array(F.when(gps, F.lit("gps.dropped")), F.when(F.bool_or(F.col("action") == "generalize"), F.lit("carrier.generalized")), *(F.lit(x) for x in fixed)))
    return resolved.groupBy(*keys).agg(made.alias("declared"))


def report(archives: DataFrame, summary: DataFrame, dropped: DataFrame, warned: DataFrame, found: DataFrame, state: DataFrame, declared: DataFrame, options: Options) -> DataFrame:
    """audit(archive_id, profile, report_json) of archives(archive_id, kind, n_bytes, out_sha256, out_bytes); all lists sorted."""
    key = "archive_id"

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))).alias(name))

    rows = archives
    for part in (listed(summary, "entities", "kind", "action", "count"), listed(dropped, "members_dropped", "path", "bytes", "reason"), listed(warned, "warnings", "warning"), listed(found, "findings", "kind", "member", "confidence", "snippet_len"), declared, state.select(key, "status")):
        rows = rows.join(part, key, "left")
    body = F.struct(
        F.lit(VERSION).alias("tool_version"),
        F.lit(options.profile).alias("profile"),
        F.struct(F.col(key).alias("sha256"), F.col("n_bytes").alias("bytes"), "kind").alias("input"),
        F.struct(F.col("out_sha256").alias("sha256"), F.col("out_bytes").alias("bytes")).alias("output"),
        "entities", "members_dropped", F.coalesce("declared", F.array().cast("array<string>")).alias("declared_divergences"), "warnings",
        F.struct(F.coalesce("status", F.lit("clean")).alias("status"), "findings").alias("residual_scan"),
        F.array(*(F.lit(x) for x in LIMITATIONS)).alias("limitations"),
    )
    return rows.select(key, F.lit(options.profile).alias("profile"), F.to_json(body, {"pretty": "true"}).alias("report_json"), body.alias("report"))


def markdown(report: Column) -> Column:
    """The same as Markdown."""
    item = lambda rows, f: F.coalesce(F.array_join(F.transform(rows, f), "\n"), F.lit(""))
    return F.concat_ws(
        "\n",
        F.lit("# Pseudonymization report"), F.lit(""),
        F.format_string("- version: %s", report["tool_version"]), F.format_string("- profile: %s", report["profile"]),
        F.format_string("- input: %s (%d bytes)", report["input"]["sha256"], report["input"]["bytes"]),
        F.format_string("- residual scan: %s", report["residual_scan"]["status"]),
        F.lit("\n## Entities\n"), item(report["entities"], lambda e: F.format_string("- %s: %d (%s)", e["kind"], e["count"], e["action"])),
        F.lit("\n## Dropped members\n"), item(report["members_dropped"], lambda m: F.format_string("- %s (%d bytes): %s", m["path"], m["bytes"], m["reason"])),
        F.lit("\n## Warnings\n"), item(report["warnings"], lambda w: F.concat(F.lit("- "), w)),
        F.lit("\n## Limitations\n"), item(report["limitations"], lambda w: F.concat(F.lit("- "), w)),
    )
