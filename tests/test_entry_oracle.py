import re

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TRAINED = ["logo_cv_train", "random_search_trials", "round_search_trials"]      # these fit models
ALL = sorted(n for n in E.oracle_sql() if not re.match(r"op\d+_|pipeline$", n) and n not in TRAINED)    # op: see tests/llm


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"home_id", "accuracy", "macro_f1", "weighted_f1"}


def test_oracles_are_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ALL)
def test_oracle_agrees_at_smoke_scale(spark, name):
    check(spark, name)


@pytest.mark.parametrize("name", TRAINED)
def test_oracle_agrees_for_trained_queries(spark, monkeypatch, name):
    """The same with two small trees in place of each ensemble: sizes, candidates and counts do not depend on them."""
    from foldwise.operators import train as T
    make = T.make_classifier
    monkeypatch.setattr(T, "make_classifier", lambda kind="ovr_gbt", params=None, *args, **kw: make(
        kind, dict(T.DEFAULT_PARAMS if params is None else params, n_estimators=2, max_depth=2), *args, **kw))
    check(spark, name)


def check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    s = sorted(repr(tuple(_norm(r[c]) for c in order)) for r in sdf.collect())
    di = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    d = sorted(repr(tuple(_norm(r[c]) for c in order)) for r in di)
    assert s == d
