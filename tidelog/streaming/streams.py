"""Streaming plans; each takes a streaming DataFrame with ts, user_id, event_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "10 minutes"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, its timestamps fit for watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    rows = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def tumbling(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    counted = rows.withWatermark("ts", DELAY).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.unix_millis("window.start").alias("window_ms"), "n")


def sliding(rows: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    counted = rows.withWatermark("ts", DELAY).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.unix_millis("window.start").alias("window_ms"), "n")


def sessions(rows: DataFrame, gap: str = "10 minutes") -> DataFrame:
    counted = rows.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicates(keys)


def commit_state(rows: DataFrame) -> DataFrame:
    """How many events each timeline has: its last offset, kept as state."""
    return rows.groupBy(F.col("user_id").alias("timeline_id")).agg(F.count("*").alias("lra"))


def interval_join(left: DataFrame, right: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Pairs of one user's events, the right one at most so long after the left one."""
    a = left.withWatermark("ts", DELAY).select(F.col("user_id").alias("user_a"), F.col("ts").alias("ts_a"), F.col("event_id").alias("event_a"))
    b = right.withWatermark("ts", DELAY).select(F.col("user_id").alias("user_b"), F.col("ts").alias("ts_b"), F.col("event_id").alias("event_b"))
    return a.join(b, F.expr(f"user_a = user_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL {within}")).select("event_a", "event_b")
