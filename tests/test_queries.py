"""Every registered query with SQL equals DuckDB's answer on the smallest tables; plans have the shape they should."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spendtrail.queries import QUERIES, SQL
from spendtrail.queries.journeys import journeys

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 3) + 0.0
    return value


def rows(columns, table):
    return sorted((tuple(str(plain(v)).removesuffix(" 00:00:00") for v in row) for row in table[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    ours, theirs = rows(columns, got), rows(columns, want.astype({c: got[c].dtype for c in columns if got[c].dtype.kind in "if" and want[c].notna().all() and got[c].notna().all()}))
    assert len(ours) == len(theirs)
    off = sum(a != b for a, b in zip(ours, theirs, strict=True))
    assert off == 0, [x for x in zip(ours, theirs, strict=True) if x[0] != x[1]][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_journeys_need_one_exchange_and_no_python(spark):
    text = plan(journeys(spark, SF, dedupe=False).df)
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "Pandas" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(journeys(spark, SF).df.select("path_id", "channel"))
    assert "props" not in text.split("ReadSchema")[1]
    pushed = plan(spark.read.parquet(f"{SF}/events.parquet").where(F.col("user_id") == 3).select("ts"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in pushed
