import random

import pytest
from pyspark.sql import functions as F

from tidelog import verify
from tidelog.errors import CodecError
from tidelog.functions import segment_files, wire
from tidelog.functions.codec import encode_record
from tidelog.operators import metrics, running


def test_running_sums_of_hot_keys(spark):
    """A key of most rows is cut into ranges; sums are those of a window."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(5), i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o long, v long").repartition(5)
    got = {(r["k"], r["o"]): r["s"] for r in running.running(df, ["k"], F.col("o"), F.col("v"), "s", hot_rows=100).collect()}
    sums, expected = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        expected[k, o] = sums[k]
    assert got == expected
    assert running.running(df.limit(0), ["k"], F.col("o"), F.col("v"), "s").count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([float(rng.randrange(20)), None])) for k in "aab" for _ in range(101)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    expected = {r["k"]: (r["x"], r["y"]) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("x"), F.percentile("v", F.lit(0.95)).alias("y")).collect()}
    assert {r["k"]: (pytest.approx(r["p50"]), pytest.approx(r["p95"])) for r in metrics.quantiles(df, ["k"], "v", [0.5, 0.95]).collect()} == expected


def test_messages():
    assert wire.varint(300) == b"\xac\x02" and len(wire.varint(-1)) == 10
    unit = {"id": "u1", "address": "10.0.0.1:80"}
    for fields, message in (
        (wire.TIMELINE, {"name": "t", "timeline_id": 300, "status": "SEALED", "term": 0, "version": -1, "lra": 2**62}),
        (wire.SEGMENT, {"ensemble": [unit, {"id": "", "address": "x"}], "start_offset": 21}),
        (wire.REGISTRATION, {"unit": unit, "status": "WRITABLE", "zone": "z", "cpu_usage": 0.5, "memory_usage": 0.0, "disk_usage": -1.5}),
    ):
        assert wire.decode(wire.encode(message, fields), fields) == message
    assert wire.encode({"name": "t", "timeline_id": 300}, wire.TIMELINE) == b"\x0a\x01t\x10\xac\x02"
    assert wire.decode(b"", wire.SEGMENT) == {"ensemble": [], "start_offset": 0}
    assert wire.decode(b"\x78\x05", wire.UNIT) == {"id": "", "address": ""}  # a field that is not known
    for bad in (b"\x0a\x05ab", b"\x10\x80", b"\x0f"):
        with pytest.raises(CodecError):
            wire.decode(bad, wire.TIMELINE)


@pytest.mark.parametrize("aligned", [False, True])
def test_segment_files(spark, tmp_path, aligned):
    import io

    rng = random.Random(6)
    groups = [[encode_record("FULL", n, bytes(rng.randrange(3000))) for n in range(rng.randrange(1, 5))] for _ in range(40)]
    file = io.BytesIO()
    writer = segment_files.SegmentWriter(file, 1 << 30, aligned)
    starts = [writer.append(g) for g in groups]
    reader = segment_files.SegmentReader(file.getvalue(), aligned)
    assert len(list(reader.read_all())) == sum(map(len, groups)) and all(reader.read_at(s)[1] == 0 for s in starts)
    assert not aligned or all(s % segment_files.ALIGNED == 0 for s in starts)
    with pytest.raises(CodecError):
        reader.read_at(len(file.getvalue()))
    small = segment_files.SegmentWriter(io.BytesIO(), 100, aligned)
    assert small.append([bytes(90)]) == 0 and small.append([bytes(20)]) is None
    rows = spark.range(500).selectExpr("'FULL' AS record_type", "id % 9 AS log_number", "CAST(repeat('x', CAST(id AS INT)) AS BINARY) AS data").repartition(3)
    files = segment_files.write_segments(rows, f"file://{tmp_path}/s", 20_000, aligned).collect()
    assert sum(f["n"] for f in files) == 500 and all(f["size"] <= 20_000 for f in files)
    back = segment_files.read_segments(spark, f"file://{tmp_path}/s", aligned)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_soak(spark, tmp_path):
    said = []
    assert verify.run(spark, f"file://{tmp_path}", timelines=2, rate=20, duration=3, report_interval=1, say=said.append)
    assert sum("PASS" in x for x in said) == 2 and "0 write errors" in said[-3] and not said[-3].split(" written")[0].endswith(" 0")
    counters = verify.Counters()
    counters.add(written=11, read=7)
    assert counters.rates(2) == (5, 3) and counters.rates(2) == (0, 0)
