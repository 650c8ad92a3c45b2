"""Archives as tables of members, and members packed into archives again.

Members are read and written an archive at a time inside a task; everything else about them is a
column expression.
"""

from __future__ import annotations

import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kinds import UnsupportedArchive

MEMBERS = "archive_id string, member string, ordinal int, content binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archives(archive_id, path, kind, n_bytes, content)."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.sha2("content", 256).alias("archive_id"), "path", archive_kind(F.col("content")).alias("kind"), F.octet_length("content").cast("bigint").alias("n_bytes"), "content")


def archive_kind(content: Column) -> Column:
    """android for zip, apple for gzip and xz, else auto."""
    head = F.hex(F.substring(content, 1, 6))
    return F.when(head.startswith("504B0304"), F.lit("android")).when(head.startswith("1F8B") | (head == "FD377A585A00"), F.lit("apple")).otherwise(F.lit("auto"))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty parts, no leading sysdiagnose folder."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), "^/|/$", "")
    return F.regexp_replace(clean, r"^sysdiagnose[^/]*/", "")


def zip_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info)


def tar_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    elif content[:6] == b"\xfd7zXZ\0":
        content = lzma.decompress(content)
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as t:
        for info in t:
            if info.isfile() and not info.name.rsplit("/", 1)[-1].startswith("._"):
                yield info.name, t.extractfile(info).read()


def members_of(content: bytes, kind: str) -> list[tuple[str, bytes]]:
    tried = {"android": (zip_members,), "apple": (tar_members,)}.get(kind, (zip_members, tar_members))
    for read in tried:
        try:
            return list(read(content))
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError):
            continue
    raise UnsupportedArchive("neither a zip nor a tar archive")


def members(archives: DataFrame) -> DataFrame:
    """members(archive_id, kind, member, ordinal, content) of archives(archive_id, kind, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, k, c in zip(frame["archive_id"], frame["kind"], frame["content"], strict=True):
                rows = [(a, k, m, i, b) for i, (m, b) in enumerate(members_of(bytes(c), k))]
                yield pd.DataFrame(rows, columns=["archive_id", "kind", "member", "ordinal", "content"])

    rows = archives.select("archive_id", "kind", "content").mapInPandas(run, "archive_id string, kind string, member string, ordinal int, content binary")
    return rows.withColumn("member", F.when(F.col("kind") == "android", F.col("member")).otherwise(normal_path(F.col("member"))))


def zip_bytes(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in rows:
            info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def tar_gz_bytes(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as g, tarfile.open(fileobj=g, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(data), 0o644, 0
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def pack_kind(kind: Column, member: Column) -> Column:
    """Aggregate: auto is packed as android if a member looks like a bug report's."""
    looks = F.bool_or(member.contains("dumpstate") | member.endswith("version.txt"))
    return F.when(F.first(kind) != "auto", F.first(kind)).when(looks, F.lit("android")).otherwise(F.lit("apple"))


def repack(rows: DataFrame) -> DataFrame:
    """archives(archive_id, kind, content) of kept members, in their order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        pairs = [(m, bytes(c)) for m, c in zip(frame["member"], frame["content"], strict=True)]
        kind = frame["pack"].iloc[0]
        return pd.DataFrame({"archive_id": [frame["archive_id"].iloc[0]], "kind": [kind], "content": [zip_bytes(pairs) if kind == "android" else tar_gz_bytes(pairs)]})

    how = rows.groupBy("archive_id").agg(pack_kind(F.col("kind"), F.col("member")).alias("pack"))
    return rows.join(how, "archive_id").groupBy("archive_id").applyInPandas(run, "archive_id string, kind string, content binary")


def dumpstate_rank(member: Column, n_bytes: Column) -> Column:
    """1 is the surest name of the main dump; null is none."""
    base = F.substring_index(member, "/", -1)
    dated = base.rlike(r"^dumpstate-.*\.txt$") & ~base.contains("dumpstate_log") & ~base.contains("_debug")
    return (
        F.when(member == "dumpstate.txt", 1)
        .when(base == "dumpstate.txt", 1)
        .when(dated, 2)
        .when(base.contains("dumpstate.txt"), 3)
        .when(base.rlike(r"^bugreport-.*\.txt$"), 4)
        .when(base.endswith(".txt") & (n_bytes > 100_000), F.when(member.contains("/"), 6).otherwise(5))
    )


def pick_dumpstate(rows: DataFrame, archive: str = "archive_id", member: str = "member", n_bytes: str = "n_bytes") -> DataFrame:
    """The main dump of each archive: least rank, then largest, then by name."""
    ranked = rows.withColumn("rank", dumpstate_rank(F.col(member), F.col(n_bytes))).where("rank is not null")
    w = Window.partitionBy(archive).orderBy("rank", F.desc(n_bytes), member)
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
