"""Logs, replicas, segments and units derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import epoch_ms

#: Bounds of the value histogram.
BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline for each user; offsets from 1 in order of event_id."""
    off = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("timeline_id"), F.lit(1).cast("bigint").alias("term"), off.alias("off"), F.col("props").alias("payload"),
        F.col("event_type").alias("k"), "event_id", "value", epoch_ms(F.col("ts")).alias("ts_ms"),
    )


def acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("off % 37 <> 0")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers saw: losses, repeats, altered and late events."""
    own = log(spark, sf_dir).select("timeline_id", "off", "payload")
    copies = own.withColumn("copy", F.explode(F.when((F.col("off") % 41 != 0) & (F.col("off") % 43 == 0), F.array(F.lit(0), F.lit(1))).when(F.col("off") % 41 != 0, F.array(F.lit(0))).when(F.col("off") % 43 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    altered = F.when(F.col("off") % 31 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    late = F.when(F.col("off") % 29 == 0, 25).otherwise(0)
    return copies.select("timeline_id", "off", F.col("copy").cast("bigint").alias("copy"), altered.alias("payload"), (F.col("off") * 10 + F.col("copy") * 5 + late).alias("read_seq"))


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.explode(F.array(*[F.lit(s).cast("bigint") for s in (1, 21, 41)]))
    each = table(spark, sf_dir, "events").select(F.col("user_id").alias("timeline_id")).distinct().withColumn("start_offset", starts)
    return each.withColumn("ensemble", F.concat(F.lit("ens-"), F.col("start_offset").cast("string")))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("timeline_id")).agg(F.count("*").alias("max_off"))
    each = most.withColumn("u", F.explode(F.array(*[F.lit(u).cast("bigint") for u in (1, 2, 3)])))
    return each.select("timeline_id", "u", (F.col("max_off") - (F.col("timeline_id") + F.col("u")) % 3).alias("lra"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    part = lambda n: (key * n % 100).cast("double") / 100.0
    return table(spark, sf_dir, "supplier").select(
        key.alias("pos"), F.col("s_name").alias("address"), F.concat(F.lit("zone-"), (F.col("s_nationkey") % 5).cast("string")).alias("zone"),
        F.when(key % 4 == 0, "READONLY").otherwise("WRITABLE").alias("status"), part(7).alias("cpu"), part(13).alias("mem"), part(17).alias("disk"),
    )


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    wide = table(spark, sf_dir, "events").groupBy("event_type").agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(BOUNDS)]))
    return wide.select("event_type", pairs.alias("p")).select("event_type", "p.*")


#: The same views for DuckDB, as common table expressions.
CTES = {
    "log": """SELECT user_id AS timeline_id, CAST(1 AS BIGINT) AS term, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS off,
        props AS payload, event_type AS k, event_id, value, epoch_us(ts) // 1000 AS ts_ms FROM events""",
    "acked": "SELECT * FROM log WHERE off % 37 <> 0",
    "reads": """SELECT timeline_id, off, copy, CASE WHEN off % 31 = 0 THEN concat(payload, 'x') ELSE payload END AS payload,
        off * 10 + copy * 5 + CASE WHEN off % 29 = 0 THEN 25 ELSE 0 END AS read_seq
        FROM (SELECT timeline_id, off, payload, CAST(0 AS BIGINT) AS copy FROM log WHERE off % 41 <> 0
        UNION ALL SELECT timeline_id, off, payload, CAST(1 AS BIGINT) AS copy FROM log WHERE off % 43 = 0) r""",
    "segs": """SELECT timeline_id, CAST(s AS BIGINT) AS start_offset, concat('ens-', s) AS ensemble
        FROM (SELECT DISTINCT timeline_id FROM log) t CROSS JOIN (VALUES (1), (21), (41)) x(s)""",
    "replicas": """SELECT timeline_id, u, max_off - (timeline_id + u) % 3 AS lra
        FROM (SELECT timeline_id, max(off) AS max_off FROM log GROUP BY timeline_id) m CROSS JOIN (SELECT unnest([1::BIGINT, 2, 3]) AS u) x""",
    "units": """SELECT s_suppkey AS pos, s_name AS address, concat('zone-', s_nationkey % 5) AS zone,
        CASE WHEN s_suppkey % 4 = 0 THEN 'READONLY' ELSE 'WRITABLE' END AS status,
        (s_suppkey * 7 % 100) / 100e0 AS cpu, (s_suppkey * 13 % 100) / 100e0 AS mem, (s_suppkey * 17 % 100) / 100e0 AS disk FROM supplier""",
    "buckets": """SELECT event_type, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cum
        FROM events CROSS JOIN (SELECT unnest([10e0, 25e0, 50e0, 100e0, 250e0, 500e0]) AS le) b GROUP BY event_type, le""",
}
NEEDS = {"acked": ["log"], "reads": ["log"], "segs": ["log"], "replicas": ["log"]}


def sql(query: str, *views: str, **more: str) -> str:
    """A query with the views it needs in front."""
    names = list(dict.fromkeys(n for v in views for n in (*NEEDS.get(v, []), v)))
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
