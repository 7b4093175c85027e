import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.errors import CodecError
from tidelog.functions import codec


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keys(spark):
    assert one(spark, fn.segment_key(F.lit("t"), F.lit(42))) == "t/seg-0000000000000000042"
    assert one(spark, fn.sanitized(F.lit("http://a:1/b"))) == "http_a_1_b"
    assert one(spark, fn.zone_or_default(F.lit(""))) == "default"
    assert one(spark, fn.unit_key(F.lit(None).cast("string"), F.lit("a:1"))) == "units/default/a_1"
    assert one(spark, fn.endpoint(F.lit(" h:1 "))) == "http://h:1"
    assert one(spark, fn.endpoint(F.lit("https://h"))) == "https://h"
    assert [one(spark, fn.aligned(F.lit(n))) for n in (0, 1, 4096, 4097)] == [0, 4096, 4096, 8192]
    assert one(spark, fn.action_id(F.lit(7))) == "action-7"


def test_soak_payload(spark):
    p = fn.soak_payload(F.lit(300).cast("long"), 32)
    assert bytes(one(spark, p)) == (300).to_bytes(8, "big") + bytes([300 % 256]) * 24
    assert one(spark, fn.big_endian_head(p)) == 300
    assert one(spark, fn.fill_is_right(p)) is True
    assert one(spark, fn.fill_is_right(F.concat(p, F.unhex(F.lit("00"))))) is False


def test_first_difference(spark):
    at = lambda a, b: one(spark, fn.first_difference(F.lit(a).cast("binary"), F.lit(b).cast("binary")))
    assert at("abc", "abd") == 2
    assert at("abc", "ab") == 2
    assert at("", "x") == 0
    assert at("abc", "abc") is None


@pytest.mark.parametrize(("value", "kind", "text"), [(1.0, "double", "1"), (1.5, "double", "1.5"), (None, "int", "NULL"), (True, "boolean", "true"), (7, "bigint", "7")])
def test_rendered(spark, value, kind, text):
    assert one(spark, fn.rendered(F.lit(value).cast(kind), kind)) == text


def test_rendered_binary_and_other(spark):
    assert one(spark, fn.rendered(F.unhex(F.lit("61FF")), "binary")) == "a�"
    assert one(spark, fn.rendered(F.current_date(), "date")) == "<date>"


@pytest.mark.parametrize("data", [b"some bytes", b"", b"\xab" * 32768, b"\xff" * 65535])
def test_record_round_trip(data):
    raw = codec.encode_record("FIRST", 12345, data)
    assert len(raw) == 11 + len(data)
    assert codec.decode_record(raw) == ("FIRST", 12345, data, len(raw))


def test_record_batch_and_damage():
    raw = b"".join(codec.encode_record("FULL", i, b"entry no. %d" % i) for i in range(3))
    assert [n for _, n, _ in codec.decode_records(raw)] == [0, 1, 2]
    with pytest.raises(CodecError, match="checksum"):
        codec.decode_record(raw[:15] + b"X" + raw[16:])
    with pytest.raises(CodecError, match="header"):
        codec.decode_record(raw[:5])
    with pytest.raises(CodecError, match="announced"):
        codec.decode_record(raw[:14])
    with pytest.raises(CodecError, match="type"):
        codec.decode_record(raw[:6] + b"\x09" + raw[7:])
    with pytest.raises(CodecError):
        codec.encode_record("FULL", 0, b"x" * 65536)


def test_decoded_reports_damage(spark):
    rows = spark.createDataFrame([(1, bytearray(codec.encode_record("FULL", 1, b"a"))), (2, bytearray(b"bad"))], "id int, record binary")
    got = {r["id"]: r for r in codec.decoded(rows).collect()}
    assert bytes(got[1]["data"]) == b"a" and got[1]["error"] is None
    assert got[2]["data"] is None and "header" in got[2]["error"]
