"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_flagship(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    assert __spark_entry__.entry(spark).count() > 0


def test_vector_scan_is_pushed_down(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    plan = __spark_entry__.queries()["knn_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "IsNotNull(embedding)" in plan
