"""What a log keeps: ages, sizes, latest values, transactions, indexes, derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def by_age(log: DataFrame, max_age_ms: int) -> DataFrame:
    """Events at most so much older than the newest of their timeline."""
    newest = log.groupBy("timeline_id").agg(F.max("ts_ms").alias("_newest"))
    return log.join(newest, "timeline_id").where(F.col("ts_ms") >= F.col("_newest") - max_age_ms).drop("_newest")


def by_bytes(log: DataFrame, max_bytes: int) -> DataFrame:
    """The newest events of each timeline whose payloads together fit."""
    held = running(log, ["timeline_id"], -F.col("off"), F.octet_length("payload").cast("bigint"), "_bytes")
    return held.where(F.col("_bytes") <= max_bytes).drop("_bytes")


def latest_per_key(log: DataFrame) -> DataFrame:
    """The last payload of each key; an aggregate, so keys are combined before the shuffle."""
    return log.groupBy("timeline_id", "k").agg(F.max("off").alias("off"), F.max_by("payload", "off").alias("payload"))


def committed(log: DataFrame, markers: DataFrame) -> DataFrame:
    """Events outside transactions and those of transactions that have a marker (txn_id)."""
    inside = log.where("txn_id IS NOT NULL").join(markers.select("txn_id"), "txn_id", "left_semi")
    return log.where("txn_id IS NULL").unionByName(inside)


def secondary_index(log: DataFrame) -> DataFrame:
    """Rows (timeline_id, k, off), clustered by key and ascending in each partition: no row grows with a key's events."""
    return log.select("timeline_id", "k", "off").repartition("timeline_id", "k").sortWithinPartitions("timeline_id", "k", "off")


def refreshed(state: DataFrame, delta: DataFrame) -> DataFrame:
    """A table of sums (k, n, total) brought up to date with new events (k, value)."""
    new = delta.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return state.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,6)").alias("total"))
