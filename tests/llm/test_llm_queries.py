import collections

import duckdb
import pytest

from nightglass.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(Q.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(want)
