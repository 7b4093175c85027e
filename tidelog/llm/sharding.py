"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in logical partitions. How many rows of each partition go to each shard
is drawn first, exactly as a uniform permutation of all rows would deal them: the
counts of one partition over the shards are multivariate hypergeometric given what
the shards still lack. Each partition is then permuted by itself, cut by its counts,
exchanged, and each shard is permuted again. Only counts reach the driver: as many
as there are partitions.

Rows, even equal ones, are dealt one by one. Null values only take part as values
of their row; an empty table gives an empty result. Columns of the input are carried
along, whatever their names; one named like an output column (``shard``, ``slot``) is
replaced by it.
"""

from __future__ import annotations

import json
import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import nested, written

#: Rows of one logical partition or of one slot range, about; sorted by one task.
ROWS_A_PART = 1_000_000
#: Most logical partitions; the matrix has so many rows, whatever the input.
MOST_PARTS = 8192


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among draws without return, by inversion.

    The law's weights are multiplied up from the mode by their ratios, in both directions as far as
    they matter, and divided by their sum: no term is a difference of large logarithms, so they add up
    to 1 whatever the sizes.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (good + 1) * (draws + 1) // (n + 2)))
    spread = math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))
    reach = math.ceil(14 * spread) + 60  # beyond, all weights together are below 2^-53 of the sum
    first, last = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, last, dtype=np.float64)
    down = np.arange(mode, first, -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    ends = np.cumsum(weights)
    return first + int(min(np.searchsorted(ends, rng.random() * ends[-1], side="right"), len(ends) - 1))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition its counts over the shards; column sums differ by one at most."""
    rng, total = random.Random(seed), sum(rows)
    lacks = [total // shards + (j < total % shards) for j in range(shards)]
    rng.shuffle(lacks)
    matrix = []
    for n in rows:
        left, rest, counts = n, sum(lacks), []
        for j in range(shards):
            k = hypergeometric(rng, lacks[j], rest - lacks[j], left) if left else 0
            rest -= lacks[j]
            left -= k
            lacks[j] -= k
            counts.append(k)
        matrix.append(counts)
    return matrix


def deal(df: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard)."""
    spark = df.sparkSession
    own = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    rows = written(own.select(nested(own), F.monotonically_increasing_id().alias("_uid")), "deal")
    total = rows.count()
    parts = min(MOST_PARTS, max(16, math.ceil(total / ROWS_A_PART)))
    keyed = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "_uid"), F.lit(parts)).cast("int"))
    sizes = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    ends = [reduce(lambda a, k: [*a, (a[-1] if a else 0) + k], counts, []) for counts in matrix]
    plan = spark.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("_part", "_ends")
    )
    place = W.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_uid"), "_uid")
    dealt = (
        keyed.withColumn("_rank", F.row_number().over(place))
        .join(F.broadcast(plan), "_part")  # at most MOST_PARTS rows
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
        .drop("_part", "_rank", "_ends")
    )
    # A slot is what lies in the shard's earlier key ranges, and the rank in its own range.
    ranges = max(1, math.ceil(total / shards / ROWS_A_PART))
    key = F.xxhash64(F.lit(seed + 2), "_uid")
    dealt = dealt.withColumn("_key", key).withColumn("_range", F.pmod(F.shiftrightunsigned(key, 8), F.lit(ranges)))
    before = (
        dealt.groupBy("shard", "_range").count()
        .withColumn("_before", F.sum("count").over(W.partitionBy("shard").orderBy("_range")) - F.col("count"))
        .drop("count")
    )
    within = W.partitionBy("shard", "_range").orderBy("_key", "_uid")
    return (
        dealt.withColumn("_in", F.row_number().over(within) - 1)
        .join(before, ["shard", "_range"])
        .withColumn("slot", F.col("_before") + F.col("_in"))
        .select("_row.*", "shard", "slot")
    )


def op10(docs: DataFrame) -> DataFrame:
    """The digest of deal(): 40 shards by the law ``rows``."""
    narrow = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return deal(narrow).withColumn("grown_shard", F.lit(None).cast("int"))
