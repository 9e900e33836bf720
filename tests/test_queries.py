import math
import os

import duckdb
import pytest

from wayfold.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(row):
    return repr([round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in row])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(plain(r) for r in df.collect()) == sorted(plain([r[i] for i in at]) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["licence", "instant_id", "x", "y"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prefilter_and_stay_in_the_jvm(spark):
    text = catalogue.QUERIES["q13"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text and "ArrowEvalPython" not in text
    assert "xmin" in text and "CartesianProduct" not in text
