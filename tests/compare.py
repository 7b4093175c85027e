"""Rows of Spark and DuckDB in one form."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(expected.columns, expected.fetchall())
