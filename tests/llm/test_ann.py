import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import ann
from foldwise.llm.queries import QUERIES


def brute(rows, queries, top=20):
    """Nearest by inner product in double precision, ties to the smaller id."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q, v in queries:
        s = (x * np.array(v, np.float64)).sum(axis=1)
        s[ids == q] = -np.inf
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:top]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_query_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.93
    score = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(s == pytest.approx(score[q, i], abs=1e-12) for q, v in got.items() for i, s in v if (q, i) in score)


def test_copies_tie_to_smaller_ids_and_hot_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    monkeypatch.setattr(ann, "HELD", 500)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    rows += [(1000 + i, [3.0, 1.0, 0.5, 0.1, 0.1, 0.3]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hot = [q for q in want if q >= 1000]
    assert hot and all(got[q] == [i for i, _ in want[q]] for q in hot)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97


def test_vectors_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]),
            (3, [1.0, 2.0]), (2, [1.0, 2.0]), (5, [-1.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (120, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumn("id", F.lit("x")).withColumn("query", F.lit(1))
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 120, 0.5), (0, 4, 5, -1.0),
                   (120, 1, 2, 1.5), (120, 2, 3, 1.5), (120, 3, 0, 0.5), (120, 4, 5, -0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0
