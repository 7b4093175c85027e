"""Rates, ratios and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running


def rate(counters: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Increase a second of counters (keys, ts_ms, value) in each window; a fall is a reset to 0."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("ts_ms"))
    step = F.when(before.isNull(), 0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    start = F.floor(F.col("ts_ms") / (seconds * 1000)) * (seconds * 1000)
    return (
        counters.withColumn("_step", step).groupBy(*keys, start.cast("bigint").alias("window_ms"))
        .agg((F.sum("_step") / seconds).alias("rate"))
    )


def ratio(rows: DataFrame, keys: list[str], good: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(good).alias("good"), F.count("*").alias("n"), (F.count_if(good) / F.count("*")).alias("ratio"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear interpolation in cumulative buckets (keys, le, cum); the largest bound if the rank lies beyond."""
    w = W.partitionBy(*keys).orderBy("le")
    whole = W.partitionBy(*keys)
    placed = buckets.select(
        *keys, "le", "cum", F.coalesce(F.lag("cum").over(w), F.lit(0)).alias("below"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"),
        (F.max("cum").over(whole) * q).alias("rank"),
    )
    inside = placed.where("cum >= rank").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    span = F.col("cum") - F.col("below")
    value = F.when(span == 0, F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / span)
    return inside.select(*keys, value.alias("quantile"))


def quantiles(rows: DataFrame, keys: list[str], column: str, qs: list[float]) -> DataFrame:
    """Exact quantiles, interpolated between neighbours: values are counted, the counts summed up in order without one task
    holding a key's values, and of the places on either side of a quantile the least value that reaches them is taken."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, keys, F.col("_v"), F.col("_n"), "_cum")
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = placed.join(total, keys)
    least = lambda at: F.min(F.when(F.col("_cum") > at, F.col("_v")))
    ends = [(f"p{round(q * 100)}", (F.col("_total") - 1) * F.lit(q)) for q in qs]
    found = joined.groupBy(*keys, "_total").agg(*[least(end(at)).alias(f"_{side}_{name}") for name, at in ends for side, end in (("low", F.floor), ("high", F.ceil))])
    between = lambda name, at: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at - F.floor(at))
    return found.select(*keys, *[between(name, at).alias(name) for name, at in ends])


def up(rows: DataFrame, is_up: Column) -> DataFrame:
    """One row: the share of what is up, and how many are not, or 0 if there is nothing."""
    return rows.agg((F.count_if(is_up) / F.nullif(F.count("*"), F.lit(0))).alias("ratio"), F.coalesce(F.count_if(~is_up), F.lit(0)).alias("down"))


def sum_by(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(column).alias("total"))


def load(used: DataFrame, capacity: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The sum of a column over what there is room for (keys, capacity); null without capacity."""
    return sum_by(used, keys, column).join(capacity, keys, "left").withColumn("load", F.col("total") / F.nullif(F.col("capacity"), F.lit(0)))
