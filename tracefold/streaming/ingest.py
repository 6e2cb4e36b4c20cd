"""Continuous ingest of new events: runs and their outcomes as they close.

Files of events become runs by session window with a watermark, so state is bounded by open sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of events under ``path``."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def closed_runs(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """One row for each session of a user, once the watermark has passed it: steps, errors, last value."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("value") >= 100).alias("n_errors"), F.max_by("value", "ts").alias("last"))
        .select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).alias("run_id"), F.col("user_id").cast("string").alias("task_id"), "n_steps", "n_errors", F.when(F.col("last") >= 10, F.col("last") < 60).alias("success"))
    )


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, however often a source repeats them within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
