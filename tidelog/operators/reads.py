"""Reading a log: ranges, limits, chunks, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument

CHUNK = 1024
#: First offset of a timeline.
ORIGIN = 1
END = 2**63 - 1


def in_range(start: int, end: int) -> Column:
    """start <= off < end; both bounds reach the scan."""
    if end < start:
        raise InvalidArgument(f"end {end} is before start {start}")
    return (F.col("off") >= start) & (F.col("off") < end)


def range_read(log: DataFrame, timeline: int, start: int, end: int) -> DataFrame:
    return log.where((F.col("timeline_id") == timeline) & in_range(start, end))


def fetch(log: DataFrame, start: int = ORIGIN, timelines: list[int] | None = None, limit: int | None = None, committed: DataFrame | None = None) -> DataFrame:
    """Events from start on, of all or some timelines; at most limit of each; only up to the watermark (timeline_id, lra) if one is given."""
    rows = log.where(F.col("off") >= start)
    if timelines is not None:
        rows = rows.where(F.col("timeline_id").isin(timelines))
    if limit is not None:  # offsets are dense, but a log may have holes
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("timeline_id").orderBy("off"))).where(F.col("_n") <= limit).drop("_n")
    if committed is not None:
        rows = rows.join(committed.select("timeline_id", "lra"), "timeline_id").where("off <= lra").drop("lra")
    return rows


def fetch_latest(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Events after each timeline's watermark (timeline_id, lra)."""
    return log.join(watermarks.select("timeline_id", "lra"), "timeline_id").where("off > lra").drop("lra")


def fetch_by_index(log: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Events from each timeline's first offset of a key on; index as secondary_index() makes it."""
    first = index.where(F.col("k") == key).select("timeline_id", "off").groupBy("timeline_id").agg(F.min("off").alias("_first"))
    return log.join(first, "timeline_id").where(F.col("off") >= F.col("_first")).drop("_first")


def chunks(log: DataFrame, size: int = CHUNK) -> DataFrame:
    """How each timeline's events are framed: type, first and last offset, where the next read begins."""
    n = F.row_number().over(W.partitionBy("timeline_id").orderBy("off")) - 1
    framed = (
        log.select("timeline_id", "off", n.alias("n")).groupBy("timeline_id", F.floor(F.col("n") / size).alias("chunk"))
        .agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count("*").alias("n_events"))
    )
    last = F.max("chunk").over(W.partitionBy("timeline_id"))
    kind = F.when(last == 0, "FULL").when(F.col("chunk") == 0, "FIRST").when(F.col("chunk") == last, "LAST").otherwise("MIDDLE")
    return framed.withColumn("chunk_type", kind).withColumn("advanced_off", F.col("last_off") + 1)


def frames(log: DataFrame, requests: DataFrame, size: int = CHUNK) -> DataFrame:
    """What requests (request_id, timeline_id, start, end) are answered: chunks as chunks() frames them, or one FULL chunk without
    events whose next read begins at start; a request whose end is before its start is answered INVALID_ARGUMENT."""
    good = requests.where("end >= start")
    asked = good.select(F.col("request_id"), F.col("timeline_id").alias("_timeline"), "start", "end")
    own = log.join(asked, (F.col("timeline_id") == F.col("_timeline")) & (F.col("off") >= F.col("start")) & (F.col("off") < F.col("end")))
    found = chunks(own.select(F.col("request_id").alias("timeline_id"), "off"), size).withColumnRenamed("timeline_id", "request_id").select("request_id", "chunk", "first_off", "last_off", "n_events", "chunk_type", "advanced_off")
    none = lambda kind, rows: rows.select("request_id", F.lit(0).cast("bigint").alias("chunk"), *[F.lit(None).cast("bigint").alias(c) for c in ("first_off", "last_off")], F.lit(0).cast("bigint").alias("n_events"), F.lit(kind).alias("chunk_type"), F.col("start").alias("advanced_off"))
    empty = good.join(found.select("request_id").distinct(), "request_id", "left_anti")
    return found.unionByName(none("FULL", empty)).unionByName(none("INVALID_ARGUMENT", requests.where("end < start")))


def with_ends(segments: DataFrame) -> DataFrame:
    """Segments (timeline_id, start_offset, ...) with their implicit end, exclusive."""
    following = F.lead("start_offset").over(W.partitionBy("timeline_id").orderBy("start_offset"))
    return segments.withColumn("end_offset", F.coalesce(following, F.lit(END)))


def route(offsets: DataFrame, segments: DataFrame) -> DataFrame:
    """Each offset with the segment of greatest start at most it; without one, nulls."""
    s = with_ends(segments).withColumnRenamed("timeline_id", "_timeline")
    here = (F.col("timeline_id") == F.col("_timeline")) & (F.col("off") >= F.col("start_offset")) & (F.col("off") < F.col("end_offset"))
    return offsets.join(s, here, "left").drop("_timeline")


def last_segment(segments: DataFrame) -> DataFrame:
    others = [c for c in segments.columns if c not in ("timeline_id", "start_offset")]
    return segments.groupBy("timeline_id").agg(F.max("start_offset").alias("start_offset"), *[F.max_by(c, "start_offset").alias(c) for c in others])
