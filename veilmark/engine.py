"""Runs: tables and archives, dry runs, restoring and verifying."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import detect, encodings, pseudonym, seal, structural
from .functions.keys import Key
from .kinds import CONFIDENCE, CryptoError, ResidualPiiError
from .operators import audit, entities, logarchive, mapping, members, residual, rewrite
from .plans.policy import Options, describe, effective
from .plans.storage import written
from .sources import archives as containers
from .sources import leaves
from .sources.sections import explode_sections

IPS_KINDS = ("email", "user_name", "container_uuid", "file_path_leaf", "phone_number")


def pseudonymize_column(text: Column, key: Key, options: Options | None = None, section: Column | None = None) -> Column:
    """A text column rewritten row by row, without a shuffle: each row's own hits decide.

    Equal identifiers get equal pseudonyms in all rows, since a tag needs nothing but the key.
    Ordinals and unique pseudonyms need anonymize_table.
    """
    options = options or Options()
    profile = effective(options)
    actions = F.create_map(*(F.lit(x) for k in pseudonym.GENERATORS for x in (k, profile.action(k))))
    changed = tuple(k for k in pseudonym.GENERATORS if profile.action(k) not in ("keep", "shift", "drop"))
    hits = F.filter(encodings.scan_views(text, section, views=options.views), lambda h: (h["confidence"] >= profile.least_confidence) & ~F.try_element_at(actions, h["kind"]).isin("keep", "shift"))

    def pair(h: Column) -> Column:
        tag = key.tag(h["kind"], h["canonical"])
        if options.mode == "encrypt":
            made = seal.seal(h["canonical"], key)
        else:
            made = F.when(F.try_element_at(actions, h["kind"]) == "drop", pseudonym.dropped(h["kind"], h["canonical"], tag)).otherwise(pseudonym.pseudonym(h["kind"], h["canonical"], tag, changed))
        return F.struct(h["value"].alias("surface"), (made if options.writing == "plain" else mapping.encoded_like(h["value"], h["canonical"], made)).alias("replacement"))

    pairs = F.filter(F.array_distinct(F.transform(hits, pair)), lambda p: p["replacement"].isNotNull())
    return rewrite.rewrite_text(text, rewrite.longest_first(pairs), options, profile.action("gps_coordinate") == "drop")


def table_hits(df: DataFrame, id_cols: list[str], text_cols: list[str], structural_cols: list[str] = ()) -> DataFrame:
    """hits(id_cols, field, view, kind, value, canonical, confidence, start, end) of text and keyed columns, in one scan."""
    fields = [*((c, _free_hits(c)) for c in text_cols), *((c, _keyed_hits(c)) for c in structural_cols)]
    every = F.concat(*(F.transform(hits, lambda h, c=c: F.struct(F.lit(c).alias("field"), h.alias("h"))) for c, hits in fields))
    return df.select(*id_cols, F.explode(every).alias("x")).select(*id_cols, "x.field", "x.h.*")


@dataclass
class TableRun:
    rewritten: DataFrame
    entities: DataFrame
    mapping: DataFrame
    findings: DataFrame


def _fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def anonymize_table(df: DataFrame, id_cols: list[str], text_cols: list[str], structural_cols: list[str] = (), key: Key | None = None, options: Options | None = None) -> TableRun:
    """Rewrites columns of a table with one mapping for all rows; an error if identifiers are left (not under research).

    Rows are numbered and written once with their hits. Only hits are shuffled to form entities; rows
    with hits then meet the surfaces of their own hits by number, rows without stay where they are. So no list of all
    surfaces is built or broadcast, and ids that are null or repeated do no harm; id_cols only order first places.
    """
    options, key = options or Options(), key or Key.random()
    profile = effective(options)
    row, found_in = _fresh(df, "row"), _fresh(df, "hits")
    fields = [*((c, _free_hits(c, options.views)) for c in text_cols), *((c, _keyed_hits(c)) for c in structural_cols)]
    every = F.concat(*(F.transform(hits, lambda h, c=c: F.struct(F.lit(c).alias("field"), h.alias("h"))) for c, hits in fields))
    rows = written(df.withColumn(row, F.monotonically_increasing_id()).withColumn(found_in, every))
    has = F.coalesce(F.size(found_in) > 0, F.lit(False))
    hits = rows.where(has).select(row, *(F.col(c).alias(f"id {i}") for i, c in enumerate(id_cols)), F.explode(found_in).alias("x")).select(row, *(f"id {i}" for i in range(len(id_cols))), "x.field", "x.h.*")
    found = written(entities.resolve(entities.roll_up(hits, order=(*(f"id {i}" for i in range(len(id_cols))), "field", "start")), profile, options))
    made = written(mapping.replacements(found, key, options))
    own = hits.select(F.col(row).alias("of"), "kind", "canonical", "value").distinct().join(made.select("kind", "canonical", "replacement").where("replacement is not null"), ["kind", "canonical"])
    like = F.col("replacement") if options.writing == "plain" else mapping.encoded_like(F.col("value"), F.col("canonical"), F.col("replacement"))
    own = own.select("of", F.col("value").alias("surface"), like.alias("replacement"))
    pairs = rewrite.surface_pairs(own.groupBy("of", "surface").agg(F.min("replacement").alias("replacement")), "of").withColumnRenamed("pairs", "own pairs")
    joined = rows.where(has).join(pairs, F.col(row) == F.col("of"), "left").unionByName(rows.where(~has), allowMissingColumns=True)
    gps = profile.action("gps_coordinate") == "drop"
    changed = {*text_cols, *structural_cols}
    out = written(joined.select(*(rewrite.rewrite_text(F.col(f"`{c}`"), F.col("own pairs"), options, gps).alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns), has.alias(found_in)))
    # a text without any hit has none after rewriting
    left = written(_table_findings(out.where(F.col(found_in)), [c for c, _ in fields], made, found, options))
    n = left.count()
    if n and profile.name != "research":
        raise ResidualPiiError(f"{n} identifiers are left in the table")
    return TableRun(out.drop(found_in), found, made, left)


def _free_hits(c: str, views: str = "all") -> Column:
    return encodings.scan_views(F.col(f"`{c}`"), views=views)


def _keyed_hits(c: str) -> Column:
    hits = structural.value_hits(F.col(f"`{c}`"), F.lit(c))
    return F.transform(hits, lambda h: F.struct(F.lit("structural").alias("view"), *(h[k].alias(k) for k in ("kind", "value", "canonical", "confidence", "start", "end"))))


def _table_findings(df: DataFrame, fields: list[str], made: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """The residual gate over a table's rewritten columns; a column is a member."""
    named = lambda x: x.withColumn("archive_id", F.lit("table"))
    parts = [df.select(F.lit("table").alias("archive_id"), F.lit(c).alias("member"), F.lit("text").alias("handler"), F.col(f"`{c}`").alias("text")) for c in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kept = found.where("action = 'keep'").select("kind", "canonical")
    return residual.findings(rows, named(made.select("kind", "canonical", "replacement")), named(kept), context=options.residual_context).drop("archive_id")


# ---- archives

LEAVES = "archive_id string, member string, ordinal int, handler string, chunk_no int, key_path string, text string"


def chunks(rows: DataFrame, options: Options) -> DataFrame:
    """chunks(archive_id, member, ordinal, handler, section, start_line, key_path, chunk_no, text) of kept members."""
    text = rows.where(F.col("handler").isin("text", "ips")).select("archive_id", "member", "ordinal", "handler", F.col("content").cast("string").alias("text"))
    plain = explode_sections(text.where("handler = 'text'"), preamble=options.preamble)
    ips = text.where("handler = 'ips'").select("archive_id", "member", "ordinal", "handler", F.lit(0).alias("chunk_no"), F.lit("ips").alias("section"), F.lit(1).alias("start_line"), "text")

    formats = dict(leaves.VALUES)  # registered ones, too, travel with the task

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, m, o, h, c in frame.itertuples(index=False):
                values = list(formats[h](bytes(c)))
                yield pd.DataFrame([(a, m, o, h, i, k, v) for i, (k, v) in enumerate(values)], columns=["archive_id", "member", "ordinal", "handler", "chunk_no", "key_path", "text"])

    inner = rows.where(F.col("handler").isin(*formats)).select("archive_id", "member", "ordinal", "handler", "content").mapInPandas(walk, LEAVES)
    inner = inner.withColumn("section", F.when(F.col("handler") == "protobuf", F.lit("protobuf"))).withColumn("start_line", F.lit(None).cast("int")).withColumn("key_path", F.when(F.col("handler") != "protobuf", F.col("key_path")))
    return plain.unionByName(ips).withColumn("key_path", F.lit(None).cast("string")).unionByName(inner)


def archive_hits(parts: DataFrame, views: str = "all") -> DataFrame:
    keys = ("archive_id", "member", "ordinal", "handler", "section", "start_line", "key_path", "chunk_no")
    free = parts.where("key_path is null").select(*keys, F.explode(encodings.scan_views(F.col("text"), F.col("section"), dense=True, views=views)).alias("h"))
    keyed = F.transform(structural.value_hits(F.col("text"), F.col("key_path")), lambda h: F.struct(F.lit("structural").alias("view"), *(h[k].alias(k) for k in ("kind", "value", "canonical", "confidence", "start", "end"))))
    tied = parts.where("key_path is not null").select(*keys, F.explode(keyed).alias("h"))
    out = free.unionByName(tied).select(*keys, "h.*")
    return out.where((F.col("handler") != "ips") | F.col("kind").isin(*IPS_KINDS))


#: bytes of an archive's members that one task rewrites, about
SHARE = 32_000_000


def rewrite_members(rows: DataFrame, surfaces: DataFrame, options: Options, gps_dropped: bool = False, hidden: DataFrame | None = None) -> DataFrame:
    """Members(archive_id, member, handler, content, …) with their content rewritten.

    surfaces(archive_id, surface, replacement), hidden(archive_id, surface): values that memory dumps must not hold besides.
    The members of an archive are dealt out in shares, and its surfaces come once to each share, longest first and before the
    members. So they are made ready once for many members, not joined to each.
    """
    columns = rows.columns
    text = F.col("handler") == "text"
    sizes = rows.groupBy("archive_id").agg((F.floor(F.sum(F.octet_length("content")) / SHARE) + 1).cast("int").alias("shares"))
    large = F.broadcast(sizes.where("shares > 1"))  # a row for each SHARE of the input at most
    shares = F.coalesce("shares", F.lit(1))
    content = F.col("content").cast("string")
    before = F.when(text, rewrite.before_surfaces(content, options, gps_dropped).cast("binary")).otherwise(F.col("content"))
    known = rows.where(F.col("handler").isNotNull()).withColumn("content", before).join(large, "archive_id", "left")
    known = known.select("archive_id", F.pmod(F.xxhash64("member"), shares).cast("int").alias("share"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("replacement"), *(c for c in columns if c != "archive_id"))
    given = surfaces.select("archive_id", "surface", "replacement")
    if hidden is not None:
        given = given.unionByName(hidden.select("archive_id", "surface", F.lit(None).cast("string").alias("replacement")))
    empty = {"boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0)}  # no nulls, which pandas would turn into floats
    given = given.join(large, "archive_id", "left").select("archive_id", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("place"), "surface", "replacement", *(empty.get(t, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes if c != "archive_id"))
    every = known.unionByName(given).repartition("archive_id", "share")
    every = every.sortWithinPartitions("archive_id", "share", "place", F.desc(F.octet_length("surface")), "surface")

    formats = dict(leaves.REWRITES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, table, names, change, holds = None, [], [], None, None
        for frame in frames:
            out = []
            for a, n, place, surface, made, h, c in zip(*(frame[x] for x in ("archive_id", "share", "place", "surface", "replacement", "handler", "content")), strict=True):
                if share != (a, n):
                    share, table, names, change, holds = (a, n), [], [], None, None
                if not place:
                    names.append(surface)
                    if made is not None:
                        table.append((surface, made))
                    continue
                change = change or rewrite.replacer(table)
                if h == "text":
                    old = bytes(c).decode()
                    new = (change(old) if len(table) >= rewrite.MANY else rewrite.in_turn(old, table)).encode()
                elif h == "ips":
                    holds = holds or rewrite.finder(names)
                    new = leaves.ips_rewritten(bytes(c).decode(), change, holds).encode()
                else:
                    new = formats[h](bytes(c), change) if h in formats else c
                out.append(new)
            if out:
                yield frame.loc[frame["place"] == 1, columns].assign(content=out)

    done = every.mapInPandas(run, rows.select(*columns).schema)
    after = F.when(text, rewrite.after_surfaces(F.col("content").cast("string"), options).cast("binary")).otherwise(F.col("content"))
    return done.withColumn("content", after).unionByName(rows.where(F.col("handler").isNull()))


@dataclass
class ArchiveRun:
    archives: DataFrame
    entities: DataFrame
    mapping: DataFrame
    findings: DataFrame
    status: DataFrame
    report: DataFrame


def _discover(archives: DataFrame, options: Options, keep_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, hits and resolved entities."""
    profile = effective(options)
    inside = containers.members(archives)
    if options.logarchive == "jsonl":
        inside = logarchive.with_lines(inside)
    rows = written(members.classify(inside, profile, options, keep_all))
    hits = written(archive_hits(chunks(rows.where("not drop"), options), options.views))
    found = entities.roll_up(hits, ("archive_id",), ("ordinal", "member", "chunk_no", "start", "section", "start_line", "key_path"))
    return rows, hits, written(entities.resolve(found, profile, options))


def anonymize_archives(archives: DataFrame, key: Key, options: Options | None = None) -> ArchiveRun:
    """All archives of archives(archive_id, kind, n_bytes, content); raises before anything is returned if identifiers are left.

    An archive is the unit of mapping; its members are rewritten apart and meet again only to be packed.
    """
    options = options or Options()
    profile = effective(options)
    rows, _, found = _discover(archives, options)
    made = written(mapping.replacements(found, key, options, ("archive_id",)))
    hidden = made.select("archive_id", F.col("canonical").alias("surface")).where("surface != ''")
    new = written(rewrite_members(rows.where("not drop"), mapping.surfaces(made, ("archive_id",), options.writing), options, profile.action("gps_coordinate") == "drop", hidden))
    spared = found.where("action = 'keep'")
    left = written(left_over(new, made, spared, options))
    state = residual.status(left, archives, profile.name == "research")
    failed = state.where("status = 'failed'").agg(F.count("*"), F.sum("n_findings")).first()
    if failed[0]:
        raise ResidualPiiError(f"{failed[1]} identifiers are left in {failed[0]} archives; nothing was written")
    packed = written(containers.repack(new.select("archive_id", "kind", "member", "ordinal", "content")))
    sizes = archives.select("archive_id", "kind", "n_bytes").join(packed.select("archive_id", F.sha2("content", 256).alias("out_sha256"), F.octet_length("content").alias("out_bytes")), "archive_id", "left")
    dropped = rows.where("drop").select("archive_id", F.col("member").alias("path"), F.octet_length("content").alias("bytes"), F.col("drop_reason").alias("reason"))
    told = audit.report(sizes, entities.summary(found, "archive_id"), dropped, entities.warnings(found, "archive_id"), left, state, audit.divergences(found, options), options)
    return ArchiveRun(packed, found, made, left, state, told)


def left_over(rows: DataFrame, made: DataFrame, kept: DataFrame, options: Options) -> DataFrame:
    """Findings in rewritten members, binary formats scanned as the texts they hold."""
    parts = chunks(rows, options) if options.residual_context == "section" else chunks(rows, options).withColumn("section", F.lit(None).cast("string"))
    return residual.findings(parts.select("archive_id", "member", "handler", "text"), made, kept, context=options.residual_context, dense=True)


def explain_archives(archives: DataFrame, options: Options | None = None) -> DataFrame:
    """(archive_id, line): policy, members kept or dropped with reasons, entities with their actions. Nothing is mapped."""
    options = options or Options()
    rows, _, found = _discover(archives, options)
    policy = archives.select("archive_id", F.lit(0).alias("o"), F.lit(describe(options)).alias("line"))
    member = rows.select("archive_id", F.lit(1).alias("o"), F.concat(F.when(F.col("drop"), F.lit("DROP ")).otherwise(F.lit("KEEP ")), "member", F.coalesce(F.concat(F.lit(" ("), "drop_reason", F.lit(")")), F.lit(""))).alias("line"))
    level = F.element_at(F.array(*(F.lit(x) for x in CONFIDENCE)), F.col("confidence") + 1)
    entity = found.select("archive_id", F.lit(2).alias("o"), F.format_string("%s x%d -> %s (%s)", "kind", "occurrences", "action", level).alias("line"))
    return policy.unionByName(member).unionByName(entity).orderBy("archive_id", "o", "line").select("archive_id", "line")


def verify_archives(archives: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings in archives as they are; nothing is rewritten."""
    options = options or Options()
    rows = members.classify(containers.members(archives), effective(options), options, keep_all=True)
    none = archives.sparkSession.createDataFrame([], "archive_id string, kind string, canonical string, replacement string")
    return left_over(rows, none, none, options)


def restore_archives(archives: DataFrame, key: Key) -> DataFrame:
    """archives(archive_id, kind, content, n_opened) with every sealed token opened; an error if one does not open."""
    rows = members.classify(containers.members(archives), effective(Options()), Options(), keep_all=True)
    parts = written(chunks(rows, Options()).select("archive_id", F.explode(F.regexp_extract_all("text", F.lit(seal.TOKEN), 0)).alias("token")))
    opened = written(parts.groupBy("archive_id", "token").agg(F.count("*").alias("n")).withColumn("value", seal.open_token(F.col("token"), key)))
    bad = opened.where("value is null").limit(1).count()
    if bad:
        raise CryptoError("a sealed value does not open with this key")
    tokens = opened.select("archive_id", F.col("token").alias("surface"), F.col("value").alias("replacement"))
    new = rewrite_members(rows, tokens, Options(mode="encrypt"))
    packed = written(containers.repack(new.select("archive_id", "kind", "member", "ordinal", "content")))
    counts = opened.groupBy("archive_id").agg(F.sum("n").alias("n_opened"))
    return packed.join(counts, "archive_id", "left").withColumn("n_opened", F.coalesce("n_opened", F.lit(0)))


def restore_column(text: Column, key: Key) -> Column:
    return seal.open_text(text, key)


def detect_column(text: Column, section: Column | None = None) -> Column:
    return detect.scan(detect.Context(text, section))
