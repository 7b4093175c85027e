import time

from pyspark.sql import functions as F

from tidelog.streaming import batches, streams
from tidelog.streaming.metrics import QueryMetrics

SF = "/root/testdata/sf0.001"


def run(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_tail_goes_on_where_it_stopped(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    spark.range(10).write.parquet(f"{source}/a")

    def drain():
        rows = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(source)
        rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert drain() == list(range(10))
    spark.range(10, 15).write.parquet(f"{source}/b")
    assert drain() == list(range(15)) and drain() == list(range(15))


def test_sliding_windows_equal_the_batch(spark):
    rows = batches.events(spark, SF)
    got = {(r["event_type"], r["window_ms"]): r["n"] for r in run(streams.sliding(rows), "sliding", "complete").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = batch.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").count()
    assert got == {(r["event_type"], r["ms"]): r["count"] for r in expected.withColumn("ms", F.unix_millis("w.start")).collect()}


def test_interval_join_equals_the_batch(spark):
    rows = batches.events(spark, SF)
    got = {tuple(r) for r in run(streams.interval_join(rows, rows, "6 hours"), "pairs").collect()}
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = e.alias("a"), e.alias("b")
    expected = a.join(b, F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 hours")).select("a.event_id", "b.event_id")
    assert got == {tuple(r) for r in expected.collect()} and got


def test_late_events_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    write = lambda minutes, part: spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "event_id long, m int").selectExpr("event_id", "1 AS user_id", "'x' AS event_type", "timestamp_seconds(m * 60) AS ts").coalesce(1).write.parquet(f"{path}/{part}")
    write([0, 1, 200], "a")
    rows = spark.readStream.schema("event_id long, user_id int, event_type string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part, minutes in (("b", [2, 201]), ("c", [500])):
        streams.tumbling(rows).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        write(minutes, part)
    streams.tumbling(rows).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = {r["window_ms"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got[0] == 2  # the event of minute 2 came after its window had closed


def test_metrics_table(spark):
    metrics = QueryMetrics()
    spark.streams.addListener(metrics)
    try:
        run(batches.events(spark, SF).select("event_id"), "measured")
        for _ in range(50):
            if metrics.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    rows = metrics.table(spark).where("query = 'measured'").collect()
    assert sum(r["input_rows"] for r in rows) == 1000 and metrics.started >= 1
