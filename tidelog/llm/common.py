"""Shared plumbing of the corpus operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this repository on their path: functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Sorts after every real document id; stands for a null id where ids are ordered.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tidelog-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def nested(docs: DataFrame) -> Column:
    """All columns of a row as one, ``_row``: whatever their names are, they clash with none of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def parts_of(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """rows over so many partitions by a column of whole numbers: number k goes to partition k % parts, none of which hashing leaves out."""
    spark = rows.sparkSession
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = {r["p"]: r["id"] for r in spark.range(64 * parts).groupBy(at.alias("p")).agg(F.min("id").alias("id")).collect()}
    numbers = F.from_json(F.lit(json.dumps([found.get(p, p) for p in range(parts)])), "array<int>")
    return rows.withColumn("_to", F.element_at(numbers, (F.pmod(F.col(column), F.lit(parts)) + 1).cast("int"))).repartition(parts, "_to").drop("_to")


def row_parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose values of a string or binary column stay near most_bytes."""
    for batch in batches:
        values, first, held = batch.column(column), 0, 0
        sizes = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if batch.num_rows > first:
            yield batch.slice(first)


def tidied(work):
    """work, for mapInArrow, that gives its memory back when a task ends: Python workers live on and share an executor's memory."""

    def run(batches):
        own = work(batches)
        gc.disable()  # what tasks make has no cycles, and walking their large dictionaries takes a tenth of the time
        try:
            yield from own
        finally:
            del own
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


Query = Callable[[SparkSession, str], DataFrame]
