"""Appending to a log: offsets, truncation, upserts, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running


def next_offset(log: DataFrame, origin: int = 0) -> DataFrame:
    """Per timeline, the offset that the next event gets."""
    return log.groupBy("timeline_id").agg(F.coalesce(F.max("off") + 1, F.lit(origin)).cast("bigint").alias("next_off"))


def assign_offsets(arrivals: DataFrame, bases: DataFrame, order: str) -> DataFrame:
    """Arrivals numbered in their order after each timeline's base (timeline_id, lra), or from 1 without one."""
    placed = running(arrivals, ["timeline_id"], F.col(order), F.lit(1).cast("bigint"), "off")
    return placed.join(bases.select("timeline_id", "lra"), "timeline_id", "left").withColumn("off", F.coalesce("lra", F.lit(0)) + F.col("off")).drop("lra")


def micro_batches(arrivals: DataFrame, most: int = 256, linger_ms: int = 5) -> DataFrame:
    """Flushes (timeline_id, window_ms, flush, n, first_off, last_off): what came within linger_ms together, most events at a time."""
    window = (F.floor(F.col("ts_ms") / linger_ms) * linger_ms).cast("bigint")
    n = F.row_number().over(W.partitionBy("timeline_id", "window_ms").orderBy("off")) - 1
    numbered = arrivals.withColumn("window_ms", window).withColumn("flush", F.floor(n / most).cast("bigint"))
    return numbered.groupBy("timeline_id", "window_ms", "flush").agg(F.count("*").alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


def validated(batches: DataFrame, states: DataFrame) -> DataFrame:
    """Batches (batch_id, items: array of (timeline_id, term, payload)) checked whole, before anything is written: (batch_id, n, code, commit_off, current_term).

    The first item that fails decides, in each item in the order MISSING_EVENT, MIXED_BATCH,
    INVALID_TERM; an INVALID_TERM answers -1 and the timeline's term (states: timeline_id, term).
    """
    items = F.col("items")
    first = F.try_element_at(items, F.lit(1))
    joined = batches.join(states.select(F.col("timeline_id").alias("_timeline"), F.col("term").alias("_term")), first["timeline_id"] == F.col("_timeline"), "left")
    stale = first["term"] < F.coalesce("_term", F.lit(0))
    fault = lambda x, i: (
        F.when(x["payload"].isNull(), "MISSING_EVENT").when((x["timeline_id"] != first["timeline_id"]) | (x["term"] != first["term"]), "MIXED_BATCH").when(stale, "INVALID_TERM")
    )
    faults = F.filter(F.transform(items, fault), lambda x: x.isNotNull())
    code = F.when(F.size(items) == 0, "EMPTY_BATCH").otherwise(F.coalesce(F.try_element_at(faults, F.lit(1)), F.lit("OK")))
    answered = joined.withColumn("code", code)
    invalid = F.col("code") == "INVALID_TERM"
    return answered.select("batch_id", F.size(items).cast("bigint").alias("n"), "code", F.when(invalid, F.lit(-1).cast("bigint")).alias("commit_off"), F.when(invalid, F.col("_term")).alias("current_term"))


def wal_append(entries: DataFrame, order: str) -> DataFrame:
    """Entries (unit, ...) with the sequence number that each unit's write-ahead log gives them, from 1, and up to where it is synced after each."""
    placed = running(entries, ["unit"], F.col(order), F.lit(1).cast("bigint"), "sequence")
    return placed.withColumn("synced", F.col("sequence"))


def truncate_and_append(log: DataFrame, new: DataFrame) -> DataFrame:
    """What of each timeline lies before its first new offset, and the new events."""
    first = new.groupBy("timeline_id").agg(F.min("off").alias("_first"))
    kept = log.join(first, "timeline_id", "left").where("_first IS NULL OR off < _first").drop("_first")
    return kept.unionByName(new)


def upsert(writes: DataFrame, arrival: str) -> DataFrame:
    """Of the writes to an offset that of the highest term, then of the latest arrival."""
    rank = F.row_number().over(W.partitionBy("timeline_id", "off").orderBy(F.desc("term"), F.desc(arrival)))
    return writes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def fence_decision(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests (timeline_id, new_term) against states (timeline_id, term, lra): code, and the term and watermark that are answered."""
    joined = requests.join(states.withColumnRenamed("term", "_term"), "timeline_id", "left")
    stale: Column = F.col("new_term") < F.coalesce("_term", F.lit(0))
    return joined.select(
        "timeline_id", "new_term", F.when(stale, "FENCED").otherwise("OK").alias("code"),
        F.when(stale, F.lit(-1)).otherwise(F.coalesce("lra", F.lit(0))).cast("bigint").alias("lra"),
        F.greatest("new_term", F.coalesce("_term", F.lit(0))).cast("bigint").alias("current_term"),
    )
