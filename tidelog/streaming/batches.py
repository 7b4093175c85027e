"""Streams run over what is there, to a table in the shared folder that is then read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streams


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidelog-stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's rows once all that is available has been read; of an updated row, its last state."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)

    def put(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, epoch int").parquet(f"{at}/rows")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.source(spark, f"{sf_dir}/events.parquet")


def last_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in others])


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(events(spark, sf_dir).select("event_id", "user_id", "event_type")).drop("epoch")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_state(drained(streams.tumbling(events(spark, sf_dir)), "update"), ["event_type", "window_ms"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last epoch of complete mode: sessions that grew together count once."""
    rows = drained(streams.sessions(events(spark, sf_dir)), "complete")
    return rows.where(F.col("epoch") == rows.agg(F.max("epoch")).first()[0]).drop("epoch")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(streams.deduplicated(events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])).drop("epoch")


def commit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_state(drained(streams.commit_state(events(spark, sf_dir)), "update"), ["timeline_id"])


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in two runs with one checkpoint: the second goes on where the first ended, and nothing comes twice."""
    at, source = folder(spark), f"{folder(spark)}/in"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).withColumn("run", F.lit(half))
        stream.writeStream.option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, run int").parquet(f"{at}/rows").select("event_id", F.col("run").cast("bigint").alias("run"))


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each trigger takes, two at most, of the events in six."""
    source, schema = f"{folder(spark)}/in", "event_id long, part int"
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 6).cast("int").alias("part"))
    for p in range(6):
        parts.where(F.col("part") == p).coalesce(1).write.mode("append").parquet(source)
    rows = drained(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source))
    return rows.groupBy("epoch").agg(F.count_distinct("part").alias("files")).withColumn("epoch", F.col("epoch").cast("bigint"))
