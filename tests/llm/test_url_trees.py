import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldwise.llm import url_trees as U

SF = "/root/testdata/sf0.01"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "nope", "HTTP://A.Org", "http://A.ORG/x?y#z", "http://a.example.org/es/1", "x://example.org/en/12?u=http://b.com/de/",
        "http://h?x/y", "http://xorg/", "http://org/", "http://É.com/fr/é", "a?b=://c.org/#", "http://h#/f?x", "://", "http:///p",
        "http://example.org/es", "http://m.example.org/en/1", "http://com/de/x"]


def test_host_path_and_rules(spark):
    rows = U.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")).orderBy("page_id").collect()
    for r, url in zip(rows, URLS, strict=True):
        host, path = plain(url)
        assert (r["host"], r["path"]) == (host, path)
        fits = [x for x in U.DEFAULT_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.pattern), default=None)
        assert r["rule"] == (best.pattern if best else None)
        assert r["verdict"] == (best.verdict if best else "block" if r["score"] >= 0.5 else "allow")


def test_expression_equals_the_fitted_model(spark):
    f = U.features(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"))
    f = f.withColumn("label", (F.col("path_length") + F.col("digits") > 14).cast("double"))
    data = VectorAssembler(inputCols=list(U.FEATURES), outputCol="features").transform(f)
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(data.select("features", "label"))
    both = model.transform(data).withColumn("p", 1 / (1 + F.exp(-2 * U.trees_to_column(model))))
    assert all(r["p"] == pytest.approx(r["probability"][1], abs=1e-12) for r in both.select("p", "probability").collect())


def test_learns_from_labelled_urls(spark):
    f = U.features(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"))
    f = f.withColumn("label", (F.col("has_fragment") > 0).cast("double")).withColumn("key", F.col("page_id"))
    p = U.fit(f, max_rows=200)
    wrong = f.where((p >= 0.5) != (F.col("label") == 1)).count()
    assert wrong <= 0.02 * f.count()


def test_repeats_empty_table_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id int, url string").withColumn("host", F.lit(1))
    rows = U.judge(d).collect()
    assert len(rows) == 3 and {r["verdict"] for r in rows if r["rule"]} == {"allow"}
    assert U.judge(d.limit(0)).count() == 0
