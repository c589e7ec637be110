"""Every registered query against its SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tickerloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan
    got = normal(df.columns, df.collect())
    if name not in ORACLE:
        assert got[1]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    assert got == normal([d[0] for d in cur.description], cur.fetchall())
    con.close()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES)
