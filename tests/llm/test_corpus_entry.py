import re

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.sql(E.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([norm(r[c]) for c in cols]) for r in got.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())
