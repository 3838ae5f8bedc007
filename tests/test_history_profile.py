import pytest

from foldwise.operators import history as H
from foldwise.operators import profile as P
from foldwise.operators import registry as R


def test_f6_best_and_stop(spark):
    h = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([.40, .50, .49, .50, .48])],
                              "trial int, round int, score double")
    assert H.best_round(h).first().best_round == 2
    r = H.early_stop_round(h, 2).first()
    assert r.stop_round == 4 and r.best_round_at_stop == 2
    # chunked running best equals the one-chunk result
    assert H.early_stop_round(h, 2, chunk_rounds=2).first().stop_round == 4


def test_best_trial_ties_and_nan(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, float("nan")), (4, 0.1)], "trial int, score double")
    assert H.best_trial(s).first().trial == 1


def test_f7_population_std(spark):
    f = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5), (3.0, 0.5), (4.0, 0.5)], "accuracy double, f1_macro double")
    r = R.cv_summary(f).first()
    assert r.mean_accuracy == 2.5 and r.std_accuracy == pytest.approx(1.118034)


def test_f9_balance_and_rarity(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "label string, n bigint")
    r = P.summarize_counts(c).first()
    assert (r.min_n, r.p25, r.median, r.mean, r.max_n, r.max_min_ratio) == (1, 1.75, 2.5, 2.5, 4, 4.0)
    assert P.labels_below(c, 3).count() == 2
    rt = {x.threshold: x.n_below for x in P.rarity_table(c, thresholds=(3, 100)).collect()}
    assert rt == {3: 2, 100: 4}


def test_coherence_tie_to_smallest_name(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "c"), ("g", "c"), ("g", "a")], "p string, c string")
    r = P.bucket_coherence(df, "p", "c").first()
    assert (r.top_child, r.top_n, r.n_children, r.total) == ("a", 2, 3, 5)
    assert r.top_share == pytest.approx(0.4)


def test_fold_progress(spark):
    f = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0)], "fold int, seconds double")
    rows = H.fold_progress(f, total_folds=5).orderBy("fold").collect()
    assert [r.avg_seconds for r in rows] == [10.0, 15.0, 20.0]
    assert rows[-1].eta_seconds == 40.0
