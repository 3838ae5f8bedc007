import math

import pytest
from pyspark.sql import functions as F

from foldwise.llm import quality_bayes as Q
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_keeps_good_and_rejects_bad(spark):
    rows = QUERIES["op4_quality_classifier"](spark, SF)
    seen = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in seen if r["quality"] == 1]
    bad = [r["kept"] for r in seen if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_site_posteriors_equal_plain_arithmetic(spark):
    data = [("a", "x", 1.0)] * 30 + [("a", "y", 0.0)] * 5 + [("b", "x", 0.0)] * 40 + [("b", None, 0.25)] + [(None, "x", 1.0)] * 3
    df = spark.createDataFrame(data, "host string, path string, y double")
    mean, table = Q.site_posteriors(df, ["host", "path"])
    groups = {}
    for h, p, y in data:
        g = groups.setdefault((h, p), [0, 0.0])
        g[0] += 1
        g[1] += y
    assert mean == pytest.approx((1 + sum(g[1] for g in groups.values())) / (2 + len(data)))

    def kappa(level):
        n = sum(x[0] for x in level)
        m = sum(x[1] for x in level) / n
        noise = m * (1 - m)
        ss = sum(x[0] * (x[1] / x[0] - x[2]) ** 2 for x in level)
        spare = n - sum(x[0] ** 2 for x in level) / n
        between = max(0.0, (ss - (len(level) - 1) * noise) / spare)
        return min(1e6, max(1.0, noise / between - 1)) if between else 1e6

    hosts = {}
    for (h, _), (n, s) in groups.items():
        x = hosts.setdefault(h, [0, 0.0, mean])
        x[0] += n
        x[1] += s
    k0 = kappa(list(hosts.values()))
    p0 = {h: (k0 * mean + s) / (k0 + n) for h, (n, s, _) in hosts.items()}
    k1 = kappa([(n, s, p0[h]) for (h, _), (n, s) in groups.items()])
    for r in table.collect():
        n, s = groups[r["host"], r["path"]]
        assert r["p_0"] == pytest.approx(p0[r["host"]])
        assert r["p_1"] == pytest.approx((k1 * p0[r["host"]] + s) / (k1 + n))


def test_sparse_sites_shrink_more(spark):
    data = [("a", "x", 1.0)] * 50 + [("b", "x", 0.0)] * 50 + [("c", "x", 0.0)]
    _, table = Q.site_posteriors(spark.createDataFrame(data, "host string, path string, y double"), ["host", "path"])
    p = {r["host"]: r["p_0"] for r in table.collect()}
    assert p["b"] < p["c"] < p["a"]


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, None, "en", "k"), (1, None, None, "en", "k"), (None, "x " * 50, "s", None, "k")],
                                 "doc_id int, text string, source string, lang string, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id int, quality int")
    for lab in (labels, labels.limit(0)):
        got = Q.classify(docs, lab)
        assert got.columns == ["doc_id", "text", "source", "lang", *Q.RESULTS]
        rows = got.collect()
        assert len(rows) == 3 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in rows)
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_join_by_group_salted_equals_broadcast(spark):
    from foldwise.llm.common import join_by_group
    left = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("x"))
    small = spark.createDataFrame([("hot", 1), (None, 2)], "g string, v int")
    want = sorted(map(str, join_by_group(left, small, ["g"], F.col("id")).collect()))
    assert want == sorted(map(str, join_by_group(left, small, ["g"], F.col("id"), max_rows=1).collect()))
    assert len(want) == 500
