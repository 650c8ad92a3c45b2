"""Rewriting as a stream, and a registry of entities kept as state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import pseudonymize_column
from ..functions import encodings
from ..functions.keys import Key
from ..plans.policy import Options
from ..plans.storage import shared_path


def rewritten(rows: DataFrame, text: str, key: Key, options: Options | None = None) -> DataFrame:
    """A stream's text column rewritten; no state, since a tag needs nothing but the key."""
    return rows.withColumn(text, pseudonymize_column(F.col(text), key, options))


def entity_counts(rows: DataFrame, text: str, at: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Entities of a stream by event-time window; state older than the watermark is dropped."""
    hits = rows.withWatermark(at, late).select(at, F.explode(encodings.scan_views(F.col(text))).alias("h"))
    return hits.groupBy(F.window(at, window).alias("w"), F.col("h.kind").alias("kind"), F.col("h.canonical").alias("canonical")).agg(F.count("*").alias("occurrences"), F.max("h.confidence").alias("confidence")).select("w.start", "w.end", "kind", "canonical", "occurrences", "confidence")


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table. A stream source is a folder: a single file is read by its name in it."""
    now = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    single = now.inputFiles()[0].rstrip("/").endswith(f"/{name}")
    return spark.readStream.schema(now.schema).option("pathGlobFilter", name).parquet(folder) if single else spark.readStream.schema(now.schema).parquet(path)


def _finished(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All that a stream has now, in append mode; the result as a table."""
    out = shared_path(spark)
    run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def rewrite_stream(spark: SparkSession, path: str, id_col: str, text: str, key: Key, options: Options | None = None) -> DataFrame:
    """All rows there now, rewritten by a stream that ends when it has read them."""
    return _finished(spark, rewritten(_source(spark, path).select(id_col, text), text, key, options))


def registry_stream(spark: SparkSession, path: str, text: Column, at: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Entities by window of all rows there now; windows that end after the last watermark are still open and not among them."""
    return _finished(spark, entity_counts(_source(spark, path).select(F.col(at).cast("timestamp").alias(at), text.alias("text")), "text", at, late, window))
