"""Events of binary log archives as members of JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("datetime", "message", "subsystem", "category", "process", "pid", "event_type")
LIMIT = 10_000  # events of an archive; fixed value
MEMBER = "system_logs.jsonl"
_decoder: list[Callable[[DataFrame], DataFrame]] = []


def register(decode: Callable[[DataFrame], DataFrame]) -> None:
    """A decoder: binary members (archive_id, kind, member, ordinal, content) to events (archive_id, n, FIELDS)."""
    _decoder[:] = [decode]


def json_lines(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(archive_id, content): an event a line, the first of each archive by n. At most limit events are gathered for one archive."""
    first = events.withColumn("place", F.row_number().over(Window.partitionBy("archive_id").orderBy("n"))).where(F.col("place") <= limit)
    line = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    rows = first.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("rows"))
    return rows.select("archive_id", F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def with_lines(members: DataFrame) -> DataFrame:
    """members and, for archives with a binary log, a text member of its events. Without a registered decoder there are none."""
    if not _decoder:
        return members
    inside = members.where(F.col("member").contains("system_logs.logarchive/"))
    lines = json_lines(_decoder[0](inside))
    heads = inside.groupBy("archive_id").agg(F.first("kind").alias("kind"), F.max("ordinal").alias("ordinal"))
    made = heads.join(lines, "archive_id").select("archive_id", "kind", F.lit(MEMBER).alias("member"), (F.col("ordinal") + 1_000_000).alias("ordinal"), F.col("content").cast("binary").alias("content"))
    return members.unionByName(made)
