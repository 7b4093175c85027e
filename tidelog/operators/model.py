"""The replication model's promises as plans over replicas' views.

copies: (timeline_id, off, u, payload), what each unit holds; acks: (timeline_id, off, u);
marks: (timeline_id, lra), the committed offset of each timeline. Each plan gives the rows
that break a promise; an empty result is a proof for the data at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import route


def _committed(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.join(marks.select("timeline_id", "lra"), "timeline_id").where("off >= 1 AND off <= lra").drop("lra")


def under_replicated(acks: DataFrame, sent: DataFrame, marks: DataFrame, rf: int) -> DataFrame:
    """Committed offsets that fewer than rf units have acknowledged."""
    held = acks.groupBy("timeline_id", "off").agg(F.count_distinct("u").alias("n_units"))
    every = _committed(sent.select("timeline_id", "off").distinct(), marks)
    joined = every.join(held, ["timeline_id", "off"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    return joined.where(F.col("n_units") < rf)


def lost(copies: DataFrame, sent: DataFrame, segments: DataFrame, marks: DataFrame) -> DataFrame:
    """Committed offsets that a unit of their segment's ensemble (array of u) does not hold."""
    due = route(_committed(sent.select("timeline_id", "off").distinct(), marks), segments)
    each = due.select("timeline_id", "off", F.explode("ensemble").alias("u"))
    return each.join(copies.select("timeline_id", "off", "u"), ["timeline_id", "off", "u"], "left_anti")


def diverging(copies: DataFrame, segments: DataFrame, marks: DataFrame) -> DataFrame:
    """Committed offsets of which units of the ensemble hold different payloads."""
    own = route(_committed(copies, marks), segments).where(F.array_contains(F.col("ensemble"), F.col("u")))
    return own.groupBy("timeline_id", "off").agg(F.count_distinct("payload").alias("n_payloads")).where("n_payloads > 1")


def pinned(acks: DataFrame, starts: DataFrame, marks: DataFrame) -> DataFrame:
    """Units that hold committed events of the writable segment (timeline_id, start_offset): these may not be taken out."""
    own = _committed(acks, marks).join(starts.select("timeline_id", "start_offset"), "timeline_id").where("off >= start_offset")
    return own.select("timeline_id", "u").distinct()


def beyond_window(sent: DataFrame, marks: DataFrame, window: int = 1) -> DataFrame:
    """Events sent further than window beyond what is committed: flow control was not kept."""
    return sent.join(marks.select("timeline_id", "lra"), "timeline_id").where(F.col("off") > F.col("lra") + window).select("timeline_id", "off", "lra")


def dirty_tail(copies: DataFrame, fenced: DataFrame) -> DataFrame:
    """What recovery truncates: copies beyond the least watermark of the fenced units (timeline_id, u, lra)."""
    least = fenced.groupBy("timeline_id").agg(F.coalesce(F.min("lra"), F.lit(0)).alias("lra"))
    return copies.join(least, "timeline_id").where("off > lra").select("timeline_id", "off", "u")


def aligned(copies: DataFrame, fenced: DataFrame) -> DataFrame:
    """What recovery keeps, the same on every unit."""
    least = fenced.groupBy("timeline_id").agg(F.coalesce(F.min("lra"), F.lit(0)).alias("lra"))
    return copies.join(least, "timeline_id").where("off <= lra").select("timeline_id", "off", "payload").distinct()


def broadcast(sends: DataFrame, answers: DataFrame, segments: DataFrame) -> DataFrame:
    """What each send to all members comes to: sends (timeline_id, off), segments with an ensemble array of u, answers (timeline_id, off, u, ok).

    (timeline_id, off, n_members, n_acked, failed): members that refused or did not answer, in order; they go to quarantine.
    """
    members = route(sends.select("timeline_id", "off"), segments).select("timeline_id", "off", F.explode("ensemble").alias("u"))
    joined = members.join(answers.select("timeline_id", "off", "u", "ok"), ["timeline_id", "off", "u"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    failed = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("u"))))  # as many as an ensemble has members
    return joined.groupBy("timeline_id", "off").agg(F.count("*").alias("n_members"), F.count_if("ok").alias("n_acked"), failed.alias("failed"))


def retries(sends: DataFrame, acks: DataFrame, segments: DataFrame) -> DataFrame:
    """Of each timeline the earliest send that a member has not acknowledged, and the members it is sent to again: (timeline_id, off, u)."""
    members = route(sends.select("timeline_id", "off"), segments).select("timeline_id", "off", F.explode("ensemble").alias("u"))
    missing = members.join(acks.select("timeline_id", "off", "u"), ["timeline_id", "off", "u"], "left_anti")
    first = missing.groupBy("timeline_id").agg(F.min("off").alias("_first"))
    return missing.join(first, "timeline_id").where("off = _first").drop("_first")


def fence_retries(members: DataFrame, answers: DataFrame, tries: int = 5) -> DataFrame:
    """Members (timeline_id, u) that no fence answer (timeline_id, u, attempt, answered) has come from, and the next attempt, or null after so many tries."""
    sent = answers.groupBy("timeline_id", "u").agg(F.max("attempt").alias("_last"), F.max(F.col("answered").cast("int")).alias("_done"))
    open_ = members.join(sent, ["timeline_id", "u"], "left").where("coalesce(_done, 0) = 0").withColumn("attempt", F.coalesce("_last", F.lit(0)) + 1)
    return open_.select("timeline_id", "u", F.when(F.col("attempt") <= tries, F.col("attempt")).cast("bigint").alias("attempt"))


def drained(sends: DataFrame, marks: DataFrame) -> DataFrame:
    """What a writer that is closed tells of its sends (timeline_id, off): ACKED up to the committed offset, CANCELLED beyond."""
    joined = sends.join(marks.select("timeline_id", "lra"), "timeline_id", "left")
    return joined.select("timeline_id", "off", F.when(F.col("off") <= F.col("lra"), "ACKED").otherwise("CANCELLED").alias("status"))
