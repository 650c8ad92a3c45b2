"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("s"), F.col("v").alias("t")).unionByName(e.select(F.col("v").alias("s"), F.col("u").alias("t")))
    least = both.groupBy("s").agg(F.min("t").alias("m")).select("s", F.least("s", "m").alias("m"))
    return both.where("t > s").join(least, "s").select(F.col("t").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    turned = rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return turned.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of the nodes that have edges (a, b), of any type with an order; component is its least node.

    Each round is written to the shared folder; only a count and a checksum reach the driver.
    A node's edges are reduced by partial minima, never gathered. most: bound of the number of edges, if known; a
    round never has more edges than the one before, so its files follow their number.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, most=most), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, e = now, written(_small(_large(e)), most=now[0])
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
