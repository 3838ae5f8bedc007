import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics as M


def _pred(spark):
    return spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "D")], "y string, p string")


def test_fixture_f3(spark):
    conf = M.confusion_long(_pred(spark), "y", "p")
    r = M.summary_metrics(conf).first()
    assert r.accuracy == pytest.approx(0.5)
    assert r.macro_f1 == pytest.approx(1 / 3, abs=1e-6)
    assert r.weighted_f1 == pytest.approx(0.5)
    assert r.macro_precision == pytest.approx(0.375)
    assert r.macro_recall == pytest.approx(0.375)


def test_wide_full_class_list(spark):
    conf = M.confusion_long(_pred(spark), "y", "p")
    w = M.confusion_wide(conf, ["A", "B", "C", "D"])
    rows = {r.actual: r for r in w.collect()}
    assert len(rows) == 4 and len(w.columns) == 5
    assert rows["D"].pred_A == 0 and rows["D"].pred_D == 0
    assert rows["C"].pred_D == 1
    assert sum(sum(r[1:]) for r in w.collect()) == 4


def test_binary_areas(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(0.75)
    assert M.pr_auc(df, "y", "s").first().pr_auc == pytest.approx(0.791667, abs=1e-6)


def test_auc_with_ties_and_many_buckets(spark):
    import random
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(exp, abs=1e-6)


def test_evaluator_and_argmax(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    assert M.MacroF1Evaluator().evaluate(df) == pytest.approx(1 / 3)
    assert M.MacroF1Evaluator(metricName="weighted_f1").evaluate(df) == pytest.approx(0.5)
    assert M.MacroF1Evaluator(metricName="accuracy").evaluate(df) == pytest.approx(0.5)
    arr = spark.createDataFrame([([0.1, 0.7, 0.7, 0.1],)], "a array<double>")
    assert arr.select(M.argmax_index("a").alias("i")).first().i == 1


def test_log_loss(spark):
    import math
    df = spark.createDataFrame([([0.2, 0.8], 1), ([0.5, 0.5], 0), ([1.0, 0.0], 1)], "p array<double>, y int")
    exp = (-math.log(0.8) - math.log(0.5) - math.log(1e-15)) / 3
    assert M.log_loss(df, "p", "y").first().log_loss == pytest.approx(exp, abs=1e-6)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from foldwise.operators.cumulative import exact_quantiles
    rng = np.random.default_rng(1)
    a = rng.normal(size=5000).round(3)
    b = rng.integers(0, 50, size=5000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r.column, r.p): r.value for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75]).collect()}
    for c, arr in (("a", a), ("b", b)):
        for p in (0.25, 0.5, 0.75):
            assert got[(c, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-9)


def test_one_class_groups_have_no_area(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.4), ("b", 1, 0.3), (None, 0, 0.2), (None, 1, 0.9)], "g string, y int, s double")
    assert {r.g: r.roc_auc for r in M.roc_auc(df, "y", "s", ["g"]).collect()} == {"a": 1.0, "b": None, None: 1.0}
    none = M.pr_auc(df.where("y = 0"), "y", "s", ["g"]).collect()
    assert {r.g: r.pr_auc for r in none} == {"a": None, None: None}


def test_scores_of_other_classes_are_an_error(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2, 0.7])], "y int, p array<double>")
    with pytest.raises(Exception):
        M.roc_auc_ovr(df, "y", "p", 2).collect()


def test_exact_quantiles_with_outliers_and_infinities(spark):
    import numpy as np
    from foldwise.operators.cumulative import exact_quantiles
    a = np.concatenate([np.arange(999.0), [1e300, float("inf")]])
    df = spark.createDataFrame([(float(x),) for x in a] + [(None,), (float("nan"),)], "a double").withColumn("e", F.lit(None).cast("double"))
    got = {(r.column, r.p): r.value for r in exact_quantiles(df, ["a", "e"], [0.0, 0.3, 0.5, 1.0]).collect()}
    assert got["a", 0.0] == 0 and got["a", 0.3] == 300 and got["a", 0.5] == 500 and got["a", 1.0] == float("inf")
    assert got["e", 0.5] is None


def test_scores_read_their_counts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (None, 0.0)], "a double, b double").mapInArrow(note, "a double, b double")
    scores = M.summary_metrics(M.confusion_long(rows, "a", "b"), digits=None)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = scores.first()
    assert seen.value == 4 and (got["n"], got["accuracy"]) == (4, 0.5)
