import pytest

from tidelog.errors import NotEnoughUnits
from tidelog.operators.placement import find_replacement, select_ensemble

UNITS = "pos long, address string, zone string, status string, cpu double, mem double, disk double"


def choose(spark, units, rf, include=(), exclude=()):
    rows = [(i, a, z, s, *load) for i, (a, z, s, load) in enumerate(units)]
    got = select_ensemble(
        spark.createDataFrame(rows, UNITS), spark.createDataFrame([(a, i) for i, a in enumerate(include)], "address string, rank int"),
        spark.createDataFrame([(a,) for a in exclude], "address string"), rf,
    )
    return [r["address"] for r in got.orderBy("place").collect()]


HOT, COLD, OTHER = (0.9, 0.8, 0.5), (0.1, 0.1, 0.1), (0.2, 0.2, 0.1)


@pytest.mark.parametrize("rf", [1, 2, 3])
def test_as_many_as_replicas(spark, rf):
    assert len(choose(spark, [(f"u{i}", f"z{i}", "WRITABLE", COLD) for i in range(3)], rf)) == rf


def test_include_is_kept_in_order(spark):
    units = [(f"u{i}", "z", "WRITABLE", COLD) for i in range(4)]
    assert choose(spark, units, 3, include=["u3", "u1"])[:2] == ["u3", "u1"]


def test_readonly_and_excluded_are_left_out(spark):
    units = [("a", "z", "READONLY", COLD), ("b", "z", "WRITABLE", COLD), ("c", "z", "WRITABLE", COLD)]
    assert choose(spark, units, 1, include=["a"], exclude=["b"]) == ["c"]


def test_zones_are_spread_and_pressure_decides(spark):
    units = [("a", "z1", "WRITABLE", HOT), ("b", "z1", "WRITABLE", COLD), ("c", "z2", "WRITABLE", OTHER), ("d", "z1", "WRITABLE", OTHER)]
    assert choose(spark, units, 2) == ["b", "c"]


def test_zones_with_kept_units_come_later(spark):
    units = [("a", "z1", "WRITABLE", COLD), ("b", "z1", "WRITABLE", COLD), ("c", "z2", "WRITABLE", HOT)]
    assert choose(spark, units, 2, include=["a"]) == ["a", "c"]


def test_too_few_units(spark):
    assert choose(spark, [("a", "z", "WRITABLE", COLD)], 2) == []
    assert choose(spark, [("a", "z", "WRITABLE", COLD), ("b", "z", "WRITABLE", COLD)], 2, exclude=["b"]) == []


def test_replacement_forgives_the_oldest(spark):
    rows = [(i, f"u{i}", f"z{i}", "WRITABLE", *COLD) for i in range(4)]
    listing = lambda: spark.createDataFrame(rows, UNITS)
    assert find_replacement(listing, ["u0"], ["u1", "u2"], 2) == (["u0", "u3"], ["u1", "u2"])
    found, left = find_replacement(listing, ["u0"], ["u1", "u2"], 3)
    assert sorted(found) == ["u0", "u1", "u3"] and left == ["u2"]
    with pytest.raises(NotEnoughUnits):
        find_replacement(listing, [], [], 5, tries=2, wait=0)
