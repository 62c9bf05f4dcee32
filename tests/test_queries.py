import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import nightglass.plans.synthetic  # noqa: F401
from nightglass.plans.bindings import Q

SF = "/root/testdata/sf0.001"


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v.item() if hasattr(v, "item") else v

    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.items() if sql])
def test_query(spark, tables, name):
    f, sql = Q[name]
    assert rows(f(spark, SF).toPandas()) == rows(tables.execute(sql).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_running_stats(spark):
    from nightglass.streaming.running import enough, running_stats

    ev = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value")
    out = enough(running_stats(ev, "ts", "value", "event_type", "1 day"))
    assert out.agg({"frames": "sum"}).first()[0] == ev.count()
