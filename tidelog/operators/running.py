"""Running sums over keys of any size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key of more rows is cut into ranges of its order; so many cuts, as a power of two.
HOT_ROWS, CUT_BITS = 1_000_000, 12


def running(rows: DataFrame, keys: list[str], order: Column, value: Column, into: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the sum of value over the rows of the same keys up to each one, in an order by a number.

    Where many rows share a key its order is cut at approximate quantiles; sums of the ranges
    before are added to those within a range, so that no task needs all rows of a key.
    """
    cuts = (1 << CUT_BITS) - 1
    own = rows.withColumn("_order", order).withColumn("_value", value)
    hot = own.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n")
    shares = F.from_json(F.lit(json.dumps([i / (cuts + 1) for i in range(1, cuts + 1)])), "array<double>")
    ranges = own.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_order", shares, 4 * cuts).alias("_cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CUT_BITS))])
    after = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at("_cuts", at + step) < F.col("_order"), at + step).otherwise(at))
    cut = own.join(ranges, keys, "left").withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(after)).drop("_cuts")
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.sum("_value").over(W.partitionBy(*keys, "_range").orderBy("_order").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_within", within).join(before, [*keys, "_range"]).withColumn(into, F.col("_before") + F.col("_within")).select(*rows.columns, into)
