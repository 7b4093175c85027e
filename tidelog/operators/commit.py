"""What is committed: watermarks over replicas, acknowledged batches, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The watermark of a timeline that no replica has answered for.
NOTHING = -1


def commit_watermark(replicas: DataFrame, timelines: DataFrame | None = None) -> DataFrame:
    """The least watermark over all replicas (timeline_id, u, lra); of timelines (timeline_id) without any, -1."""
    least = replicas.groupBy("timeline_id").agg(F.min("lra").alias("watermark"))
    if timelines is None:
        return least
    return timelines.select("timeline_id").join(least, "timeline_id", "left").withColumn("watermark", F.coalesce("watermark", F.lit(NOTHING).cast("bigint")))


def running_lra(applied: DataFrame, order: str) -> DataFrame:
    """Each applied event with the greatest offset its timeline has had by then."""
    return applied.withColumn("lra", F.max("off").over(W.partitionBy("timeline_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def acknowledged(log: DataFrame, replicas: DataFrame, batch: int = 256) -> DataFrame:
    """Batches of the log that are complete: their last offset is at most the watermark."""
    batches = log.groupBy("timeline_id", F.floor((F.col("off") - 1) / batch).alias("batch")).agg(F.max("off").alias("max_off"), F.count("*").alias("n"))
    return batches.join(commit_watermark(replicas), "timeline_id").where("max_off <= watermark")


def recovery(replicas: DataFrame) -> DataFrame:
    """Least and greatest watermark that fenced units answer, and whether the next write truncates."""
    both = replicas.groupBy("timeline_id").agg(F.coalesce(F.min("lra"), F.lit(0)).alias("lra"), F.coalesce(F.max("lra"), F.lit(0)).alias("max_lra"))
    return both.withColumn("truncates", F.col("lra") != F.col("max_lra"))


def contiguous_ack(acks: DataFrame, quorum: int) -> DataFrame:
    """Per timeline the last offset of the unbroken run from 1 that quorum units (timeline_id, off, u) hold; 0 if there is none."""
    held = acks.groupBy("timeline_id", "off").agg(F.count_distinct("u").alias("n")).where(F.col("n") >= quorum)
    island = F.col("off") - F.row_number().over(W.partitionBy("timeline_id").orderBy("off"))
    run = held.withColumn("island", island).where("island = 0").groupBy("timeline_id").agg(F.max("off").alias("lra"))
    every = acks.select("timeline_id").distinct()
    return every.join(run, "timeline_id", "left").select("timeline_id", F.coalesce("lra", F.lit(0)).cast("bigint").alias("lra"))
