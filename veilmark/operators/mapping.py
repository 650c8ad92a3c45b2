"""Entities to replacements, and the surfaces under which they stand in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pseudonym, seal
from ..functions.encodings import url_encoded
from ..functions.keys import Key
from ..functions.text import ascii_lower, ascii_upper
from ..kinds import ORDER
from ..plans.policy import Options
from ..plans.storage import written

#: kinds with ordinals, and the label whose counter they share
ORDINAL = {"email": "email", "ssid": "ssid", "user_name": "user", "person_name": "user"}


def kind_order(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ORDER.items() for x in p)), kind), F.lit(len(ORDER)))


def ordinals(entities: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("first_seen",)) -> DataFrame:
    """Adds ordinal_name: user-n@example.invalid, SSID-n, User-n by first place; one counter for each label."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for p in ORDINAL.items() for x in p)), F.col("kind"))
    w = Window.partitionBy(*keys, "label").orderBy(*order, "canonical", kind_order(F.col("kind")))
    rows = entities.withColumn("label", label)
    n = F.row_number().over(w).cast("string")
    name = F.when(F.col("label") == "email", F.concat(F.lit("user-"), n, F.lit("@example.invalid"))).when(F.col("label") == "ssid", F.concat(F.lit("SSID-"), n)).when(F.col("label") == "user", F.concat(F.lit("User-"), n))
    # only the numbered kinds are sorted; they are few among many
    return rows.where("label is not null").withColumn("ordinal_name", name).drop("label").unionByName(rows.where("label is null").withColumn("ordinal_name", F.lit(None).cast("string")).drop("label"))


#: kinds whose pseudonym is the same for all, or the value itself
CONSTANT = ("gps_coordinate", "cell_id", "ipv4_private", "timestamp", "carrier")
FIRST_TRIES, MOST_TRIES = 16, 4096


def collisions(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds collision: how many entities of the kind have the same candidate and come before."""
    w = Window.partitionBy(*keys, "kind", "candidate").orderBy("canonical")
    return candidates.withColumn("collision", F.row_number().over(w) - 1)


def _made(key: Key, attempt: Column | None = None, wide: bool = False) -> Column:
    make = pseudonym.wider if wide else pseudonym.pseudonym
    return make(F.col("kind"), F.col("canonical"), key.tag(F.col("kind"), F.col("canonical"), attempt))


def extended(candidates: DataFrame, key: Key, keys: tuple[str, ...] = (), widen: bool = False) -> DataFrame:
    """candidates(keys, kind, canonical, candidate) made unique within keys and kind.

    The first by canonical keeps a candidate. The others try the tags that follow, several at a time and more each
    round, and take the first that is free; one that two of them want goes to the first by canonical. An
    error tells that a kind's pseudonyms are used up; with widen those left after the first round get theirs from larger ranges.
    """
    by = [*keys, "kind"]
    ranked = written(collisions(candidates.select(*by, "canonical", "candidate").distinct(), keys))  # an entity may come in several rows
    done, left = ranked.where("collision = 0").drop("collision"), ranked.where("collision > 0").select(*by, "canonical")
    first, tries = 1, FIRST_TRIES
    while left.limit(1).count():
        if tries > MOST_TRIES:
            short = left.first()
            raise ValueError(f"no pseudonym of kind {short['kind']} is free for all its entities")
        wanted = left.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1)))).withColumn("candidate", _made(key, F.col("attempt"), widen and first > 1))
        free = wanted.join(done.select(*by, "candidate"), [*by, "candidate"], "left_anti")
        pick = free.groupBy(*by, "canonical").agg(F.min(F.struct("attempt", "candidate"))["candidate"].alias("candidate"))
        won = written(collisions(pick, keys).where("collision = 0").drop("collision"))
        left = written(left.join(won.select(*by, "canonical"), [*by, "canonical"], "left_anti"))
        done = done.unionByName(won)
        first, tries = first + tries, tries * 2
    return done


def replacements(resolved: DataFrame, key: Key, options: Options | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """mapping(keys, kind, canonical, surface_forms, replacement, action) of entities that are not kept."""
    options = options or Options()
    rows = resolved.where(~F.col("action").isin("keep"))
    kind, canonical = F.col("kind"), F.col("canonical")
    if options.mode == "encrypt":
        return rows.where("action != 'shift'").withColumn("replacement", seal.seal(canonical, key))
    if options.ordinal:
        rows = ordinals(rows, keys)
    rows = rows.withColumn("tag", key.tag(kind, canonical))
    made = pseudonym.pseudonym(kind, canonical, F.col("tag"))
    if options.split_domain_tag:
        own = key.tag(F.lit("domain_name"), F.substring_index(canonical, "@", -1))
        made = F.when(kind == "email", pseudonym.email(canonical, F.col("tag"), own)).otherwise(made)
    rows = rows.withColumn("candidate", made)
    # constants are not compared: all their entities would meet in one task
    varies = (F.col("action") == "pseudo") & ~kind.isin(*CONSTANT)
    if options.on_collision == "error":
        clash = written(collisions(rows.where(varies).select(*keys, "kind", "canonical", "candidate").distinct(), keys)).where("collision > 0").first()
        if clash:
            raise ValueError(f"two entities of kind {clash['kind']} have one pseudonym")
        unique = F.col("candidate")
    else:
        fixed = extended(rows.where(varies), key, keys, options.on_collision == "widen").withColumnRenamed("candidate", "fixed")
        rows = rows.join(fixed, [*keys, "kind", "canonical"], "left")
        unique = F.coalesce("fixed", "candidate")
    if options.ordinal:
        unique = F.coalesce("ordinal_name", unique)
    replaced = (
        F.when(F.col("action") == "drop", pseudonym.dropped(kind, canonical, F.col("tag")))
        .when((F.col("action") == "generalize") & (kind == "carrier"), pseudonym.generalized_carrier(canonical))
        .when(F.col("action") == "shift", F.lit(None).cast("string"))
        .otherwise(unique)
    )
    return rows.withColumn("replacement", replaced).drop("tag", "candidate", "fixed", "ordinal_name")


def encoded_like(surface: Column, canonical: Column, replacement: Column) -> Column:
    """The replacement in the writing of the surface: percent-encoded, upper or lower case."""
    varies = ascii_lower(surface) == ascii_lower(canonical)
    cased = F.when(surface == ascii_upper(surface), ascii_upper(replacement)).otherwise(ascii_lower(replacement))
    return F.when(surface == canonical, replacement).when(varies, cased).when(surface.contains("%"), url_encoded(replacement)).otherwise(replacement)


def surfaces(mapping: DataFrame, keys: tuple[str, ...] = (), writing: str = "surface") -> DataFrame:
    """surfaces(keys, kind, surface, replacement, surface_octets), one for each surface."""
    rows = mapping.where("replacement is not null").select(*keys, "kind", "canonical", "replacement", F.explode("surface_forms").alias("surface")).where("surface != ''")
    made = rows if writing == "plain" else rows.withColumn("replacement", encoded_like(F.col("surface"), F.col("canonical"), F.col("replacement")))
    first = F.min(F.struct(kind_order(F.col("kind")).alias("o"), "canonical", "replacement", "kind"))
    return made.groupBy(*keys, "surface").agg(first.alias("f")).select(*keys, F.col("f.kind").alias("kind"), "surface", F.col("f.replacement").alias("replacement"), F.octet_length("surface").alias("surface_octets"))
