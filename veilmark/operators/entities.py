"""Hits rolled up to entities, and the action each entity gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import KINDS
from ..plans.policy import Options, Profile, allowlist

# Packages of the systems themselves.
PACKAGE_PREFIXES = ("com.android.", "com.google.android.", "android.", "com.anon.pkg")


def roll_up(hits: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """entities(keys, kind, canonical, surface_forms, occurrences, first_seen, confidence) of hits(…, kind, canonical, value, confidence).

    order: columns that say which hit came first; first_seen is their struct. Surface forms are distinct, in that order. Counts,
    maxima and first places are partial aggregates; forms are reduced to one for each value first.
    """
    at = F.struct(*(F.col(c) for c in order)) if order else F.struct(F.col("value").alias("value"))
    forms = hits.groupBy(*keys, "kind", "canonical", "value").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min(at).alias("at"))
    rows = forms.groupBy(*keys, "kind", "canonical").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("forms"), F.sum("n").alias("occurrences"), F.max("confidence").alias("confidence"), F.min("at").alias("first_seen"))
    return rows.withColumn("surface_forms", F.transform("forms", lambda x: x["value"])).drop("forms")


def policy_table(df: DataFrame, profile: Profile) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, profile.action(k)) for k in KINDS], "kind string, action string")


def allowed_domain(canonical: Column, domains: tuple[str, ...] | None = None) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in (domains or allowlist("domains")))
    return canonical.rlike(rf"(^|\.)({names})$")


def allowed_package(canonical: Column) -> Column:
    starts = "|".join(p.replace(".", r"\.") for p in PACKAGE_PREFIXES)
    return canonical.isin(*allowlist("packages")) | canonical.rlike(f"^({starts})")


def resolve(entities: DataFrame, profile: Profile, options: Options | None = None) -> DataFrame:
    """Adds action; low tells that the action was lost to too little confidence."""
    options = options or Options()
    rows = entities.join(F.broadcast(policy_table(entities, profile)), "kind", "left")  # a row for each kind
    low = F.col("confidence") < profile.least_confidence
    action = F.coalesce("action", F.lit("pseudo"))
    host = F.when(F.col("kind") == "email", F.substring_index("canonical", "@", -1)).otherwise(F.col("canonical"))
    spared = (F.col("kind").isin("domain_name")) & allowed_domain(host)
    if options.pseudo_third_party_packages:
        spared |= (F.col("kind") == "package_name") & allowed_package(F.col("canonical"))
    final = F.when(low, F.lit("keep")).when((action == "pseudo") & spared, F.lit("keep")).otherwise(action)
    return rows.withColumn("low", low & (action != "keep")).withColumn("action", final)


def summary(resolved: DataFrame, *keys: str) -> DataFrame:
    return resolved.groupBy(*keys, "kind", "action").agg(F.sum("occurrences").alias("count"))


def warnings(resolved: DataFrame, *keys: str) -> DataFrame:
    """A line for each entity that was kept for too little confidence; the value itself is not told."""
    line = F.format_string("%s kept: confidence below the profile's, %d occurrences", F.col("kind"), F.col("occurrences"))
    return resolved.where("low").select(*keys, line.alias("warning"))
