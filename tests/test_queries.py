import pytest

from tests.compare import assert_same, duck
from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(catalogue.queries()[name](spark, SF), con, ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15


def test_offset_bounds_reach_the_scan(spark, tmp_path, capsys):
    from tidelog.operators import reads

    spark.range(100).selectExpr("1 AS timeline_id", "id AS off", "'p' AS payload").write.parquet(str(tmp_path / "log"))
    reads.range_read(spark.read.parquet(str(tmp_path / "log")), 1, 5, 9).select("off").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(off,5), LessThan(off,9)" in plan and "ReadSchema: struct<timeline_id:int,off:bigint>" in plan


@pytest.mark.parametrize("name, times", [("ext_math", 1), ("ext_unpivot", 2)])
def test_all_of_lineitem_is_read(spark, name, times):
    sf = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert catalogue.queries()[name](spark, sf).count() == times * lines
    con = duck(sf)
    assert len(con.sql(ORACLE[name]).fetchall()) == times * lines
