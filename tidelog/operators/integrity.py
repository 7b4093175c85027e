"""Violations of a log's promises, found by comparing what was acknowledged with what was read.

acked: (timeline_id, off, payload, ...); reads: (timeline_id, off, payload, read_seq, ...).
Each violation is a plan over both; they share the partitioning by timeline.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import big_endian_head, fill_is_right, first_difference


def order(reads: DataFrame) -> DataFrame:
    """Reads whose offset is not above that of the read before (0 at first)."""
    previous = F.lag("off", 1, 0).over(W.partitionBy("timeline_id").orderBy("read_seq"))
    return reads.withColumn("previous_off", previous).where("off <= previous_off").select("timeline_id", "off", "read_seq", "previous_off")


def duplicate(reads: DataFrame) -> DataFrame:
    """Every read of an offset but its first."""
    n = F.row_number().over(W.partitionBy("timeline_id", "off").orderBy("read_seq"))
    return reads.withColumn("n", n.cast("bigint")).where("n > 1").select("timeline_id", "off", "read_seq", "n")


def gap(acked: DataFrame) -> DataFrame:
    """Every offset between the first and the last acknowledged that is missing."""
    following = F.lead("off").over(W.partitionBy("timeline_id").orderBy("off"))
    holes = acked.select("timeline_id", "off", following.alias("next_off")).where("next_off > off + 1")
    return holes.select("timeline_id", F.explode(F.sequence(F.col("off") + 1, F.col("next_off") - 1)).alias("off"))


def durability(acked: DataFrame, reads: DataFrame) -> DataFrame:
    """Acknowledged but never read."""
    return acked.join(reads, ["timeline_id", "off"], "left_anti").select("timeline_id", "off")


def phantom(acked: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of what was never acknowledged."""
    return reads.join(acked, ["timeline_id", "off"], "left_anti").select("timeline_id", "off", "read_seq")


def payload_mismatch(acked: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads whose payload is not the acknowledged one, and the first byte that differs."""
    a = acked.select("timeline_id", "off", F.col("payload").alias("expected"))
    differ = reads.join(a, ["timeline_id", "off"]).where("payload <> expected")
    at = first_difference(F.col("expected").cast("binary"), F.col("payload").cast("binary"))
    return differ.select("timeline_id", "off", "read_seq", at.cast("bigint").alias("first_difference"))


def corruption(soak: DataFrame, size: int = 256) -> DataFrame:
    """Soak payloads (timeline_id, off, payload) of wrong size, wrong fill or too short to have a number."""
    length = F.length("payload")
    what = (
        F.when(length < 8, "SHORT").when(length != size, "SIZE")
        .when(~fill_is_right(F.col("payload")), "FILL").when(big_endian_head(F.col("payload")) != F.col("off"), "NUMBER")
    )
    return soak.withColumn("what", what).where("what IS NOT NULL").select("timeline_id", "off", "what")


def summary(acked: DataFrame, reads: DataFrame) -> DataFrame:
    """For each timeline how many violations of each class there are, and the verdict."""
    found = {
        "order": order(reads), "duplicate": duplicate(reads), "gap": gap(acked), "durability": durability(acked, reads),
        "phantom": phantom(acked, reads), "payload_mismatch": payload_mismatch(acked, reads),
    }
    counted = reduce(DataFrame.unionByName, (v.groupBy("timeline_id").agg(F.count("*").alias("n")).withColumn("class", F.lit(k)) for k, v in found.items()))
    each = counted.groupBy("timeline_id").agg(*[F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(k) for k in found])
    # no pre-aggregated join of raw sides: both are one row for each timeline
    every = acked.select("timeline_id").union(reads.select("timeline_id")).distinct()
    total = reduce(lambda a, b: a + b, (F.coalesce(k, F.lit(0)) for k in found))
    return every.join(each, "timeline_id", "left").select(
        "timeline_id", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in found], F.when(total == 0, "PASS").otherwise("FAIL").alias("verdict")
    )


def counters(acked: DataFrame, reads: DataFrame, rejected: DataFrame, interval_ms: int) -> DataFrame:
    """What a verifier reports at the end of each interval: events written, read, verified (read as they were written) and refused
    in it, each as a total so far, and the rates of writing and reading, whole events a second.

    acked: (timeline_id, off, payload, ts_ms); reads: (timeline_id, off, payload, ts_ms); rejected: (ts_ms).
    """
    at = (F.floor(F.col("ts_ms") / interval_ms) * interval_ms).cast("bigint").alias("interval_ms")
    expected = acked.select("timeline_id", "off", F.col("payload").alias("_expected"))
    verified = reads.join(expected, ["timeline_id", "off"]).where("payload = _expected")
    kinds = {"written": acked, "read": reads, "verified": verified, "errors": rejected}
    counted = reduce(DataFrame.unionByName, (v.groupBy(at).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, v in kinds.items()))
    each = counted.groupBy("interval_ms").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])
    so_far = W.orderBy("interval_ms").rowsBetween(W.unboundedPreceding, 0)  # one row for each interval
    rate = lambda c: F.floor(F.col(c) * 1000 / interval_ms).cast("bigint").alias(f"{c}_rate")
    return each.select("interval_ms", *[F.sum(k).over(so_far).alias(k) for k in kinds], rate("written"), rate("read"))


def divergence(copies: DataFrame) -> DataFrame:
    """Offsets at which replicas (timeline_id, off, u, payload) disagree."""
    return copies.groupBy("timeline_id", "off").agg(F.count_distinct("payload").alias("n_payloads")).where("n_payloads > 1")


def not_sent(acked: DataFrame, sent: DataFrame) -> DataFrame:
    """Acknowledged (timeline_id, off) that were never sent."""
    return acked.select("timeline_id", "off").exceptAll(sent.select("timeline_id", "off"))
