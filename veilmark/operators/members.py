"""Which members are dropped, and why; which handler reads a member."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Options, Profile


def glob_regex(glob: str) -> str:
    """A glob as a regular expression; * also crosses /."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            i += 2 if glob.startswith("**", i) else 1
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
            continue
        out += "." if c == "?" else re.escape(c) if c not in " -" else c
        i += 1
    return f"^{out}$"


IMAGE = r"\.(png|jpe?g|gif|heic|webp|bmp)$"


def drop_reason(member: Column, profile: Profile, options: Options | None = None) -> Column:
    """Why a member is dropped, or null: images, binary logs, browsing and usage databases, the profile's rules."""
    options = options or Options()
    low, base = F.lower(member), F.substring_index(member, "/", -1)
    rules = [
        (low.rlike(IMAGE), "image; always drop"),
        (member.contains("system_logs.logarchive/"), "logarchive: binary dropped" if options.logarchive == "drop" else "logarchive: replaced by JSON lines"),
    ]
    if profile.name != "research":
        rules.append((low.rlike(r"safari[^/]*\.db$") | low.rlike(r"safari/history\.db"), "browsing history"))
    rules.append((low.endswith("knowledgec.db"), "usage by the minute"))
    for glob, action, reason in profile.member_rules:
        if action == "drop":
            p = glob_regex(glob)
            rules.append((member.rlike(p) | base.rlike(p), reason))
    if options.sqlite == "drop":
        rules.append((low.rlike(r"\.(db|sqlite3?)$"), "database"))
    return F.coalesce(*(F.when(test, F.lit(reason)) for test, reason in rules))


OWN: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, test: Callable[[Column, Column], Column]) -> None:
    """Members (path, content) that pass the test are read by the format registered under name in sources.leaves."""
    OWN[name] = test


def handler(member: Column, content: Column) -> Column:
    """A registered format's name, else plist, sqlite, ips, protobuf, text or null for unknown binaries."""
    return F.coalesce(*(F.when(test(member, content), F.lit(name)) for name, test in OWN.items()), _handler(member, content))


def _handler(member: Column, content: Column) -> Column:
    low = F.lower(member)
    head = F.hex(F.substring(content, 1, 16))
    text = F.is_valid_utf8(content.cast("string"))
    printable = F.substring(content, 1, 8).cast("string").rlike(r"^[\x09\x0A\x0D\x20-\x7E]*$") & (F.octet_length(content) > 0)
    named_text = low.rlike(r"\.(txt|log)$") | low.contains("dumpstate") | low.contains("bugreport")
    return (
        F.when(low.endswith(".plist") | head.startswith("62706C697374"), F.lit("plist"))
        .when(head == "53514C69746520666F726D6174203300", F.lit("sqlite"))
        .when(low.rlike(r"\.(ips|panic)$") | low.contains("tombstone"), F.lit("ips"))
        .when(low.rlike(r"\.(pb|proto)$") | low.contains("proto/"), F.lit("protobuf"))
        .when((named_text | printable) & text, F.lit("text"))
        .when(text, F.lit("text"))
    )


def classify(members: DataFrame, profile: Profile, options: Options, keep_all: bool = False) -> DataFrame:
    """Adds drop, drop_reason and handler; unknown binaries are dropped unless options let them pass."""
    rows = members.withColumn("handler", handler(F.col("member"), F.col("content")))
    reason = F.lit(None).cast("string") if keep_all else drop_reason(F.col("member"), profile, options)
    if not keep_all and options.unknown == "drop":
        reason = F.coalesce(reason, F.when(F.col("handler").isNull(), F.lit("unknown binary")))
    return rows.withColumn("drop_reason", reason).withColumn("drop", F.col("drop_reason").isNotNull())
