import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.operators import sampling, splits
from foldwise.operators.ranking import exact_rank, hash_key


def _groups(spark):
    rows = [("h1", i) for i in range(1, 11)] + [("h2", i) for i in range(1, 8)]
    return spark.createDataFrame(rows, "g string, i int")


def test_fixture_picks(spark):
    out = sampling.exact_group_sample(_groups(spark), "g", "i", 0.3, seed=42)
    got = sorted((r.g, r.i) for r in out.collect())
    assert got == [("h1", 3), ("h1", 4), ("h1", 5), ("h2", 5), ("h2", 6)]


def test_bucketed_rank_equals_single_window(spark):
    # one hot group (a third of the rows and more) and many small ones
    rows = [(0, i) for i in range(3000)] + [(g, i) for g in range(1, 50) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int").withColumn("k", hash_key(7, "g", "i"))
    a = exact_rank(df, ["g"], "k", "r", tie_cols=["i"], prefix_chars=2)
    b = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")))
    assert a.select("g", "i", "r").exceptAll(b.select("g", "i", "r")).count() == 0
    assert a.count() == b.count()


def test_sample_sizes_are_floor(spark):
    rows = [(0, i) for i in range(997)] + [(1, i) for i in range(13)]
    df = spark.createDataFrame(rows, "g int, i int")
    out = sampling.exact_group_sample(df, "g", "i", 0.37)
    n = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert n == {0: 368, 1: 4}
    glob = sampling.exact_global_sample(df, "i", 0.05)
    assert glob.count() == 50


def test_bad_fraction(spark):
    with pytest.raises(ValueError):
        sampling.exact_global_sample(_groups(spark), "i", 0.0)


def test_greedy_group_kfold_fixture(spark):
    rows = []
    for g, n in [("h1", 5), ("h2", 4), ("h3", 3), ("h4", 2), ("h5", 1)]:
        rows += [(g, i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    fm = {r.g: r.fold for r in splits.greedy_group_kfold(df, "g", 2).collect()}
    assert {g for g, f in fm.items() if f == 0} == {"h1", "h4", "h5"}
    assert {g for g, f in fm.items() if f == 1} == {"h2", "h3"}
    with pytest.raises(ValueError):
        splits.greedy_group_kfold(df, "g", 6)


def test_fold_invariants(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    fm = splits.snake_group_kfold(df, "user_id", 4)
    a = splits.assign_folds(df, fm, "user_id")
    assert a.count() == df.count()
    assert a.groupBy("user_id").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    tr, te = splits.fold_frames(a, 0)
    assert tr.count() + te.count() == df.count()


def test_stratified_balance(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = splits.stratified_folds(df, "event_type", "event_id", 3)
    per = out.groupBy("event_type", "fold").count().groupBy("event_type").agg(
        (F.max("count") - F.min("count")).alias("spread"))
    assert per.filter("spread > 1").count() == 0
    ho = splits.random_holdout(df, "event_id", 0.33)
    import math
    assert ho.filter("is_test").count() == math.ceil(0.33 * df.count())


def test_time_sequence_and_running_sums_match_plain_windows(spark):
    from foldwise.operators.cumulative import running_sums
    from foldwise.operators.ranking import exact_sequence
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    # make one user hot: a third of the rows
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    a = exact_sequence(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_format("ts", "yyyyMMddHH"), "s")
    b = ev.withColumn("s", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    assert a.select("event_id", "s").exceptAll(b.select("event_id", "s")).count() == 0
    scores = ev.groupBy("user_id", F.col("value").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(scores, ["user_id"], "score", ["n"])
    w = Window.partitionBy("user_id").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    plain = scores.withColumn("cum_n", F.sum("n").over(w))
    assert r.select("user_id", "score", "cum_n").exceptAll(plain.select("user_id", "score", "cum_n")).count() == 0


def test_greedy_phases_equal_the_sequential_assignment():
    import random
    from collections import Counter

    from foldwise.operators.splits import greedy_phases
    for seed in range(400):
        r = random.Random(seed)
        k = r.randint(2, 6)
        sizes = sorted((r.choice([1, 1, 1, 2, 3, r.randint(1, 30)]) for _ in range(r.randint(1, 60))), reverse=True)
        load, want, got = [0] * k, [], []
        for n in sizes:
            f = min(range(k), key=lambda i: (load[i], i))
            load[f] += n
            want.append(f)
        for _, first, last, folds in greedy_phases(sorted(Counter(sizes).items(), reverse=True), k):
            got += [folds[(x - first) % len(folds)] for x in range(first, last + 1)]
        assert got == want


def test_string_groups_with_a_common_stem(spark):
    from foldwise.operators import splits as S
    df = spark.createDataFrame([(f"home_0{g:03d}", i) for g in range(150) for i in range(g % 5 + 1)], "home_id string, i int")
    folds = {r.home_id: r.fold for r in S.logo_folds(df, "home_id").collect()}
    assert folds == {h: i for i, h in enumerate(sorted(folds))}


def test_null_groups_keep_their_rows(spark):
    from foldwise.operators import splits as S
    from foldwise.operators.baseline import logo_majority_eval, null_baselines
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("g", "a", 3), ("h", "a", 4)], "g string, label string, id int")
    assert S.assign_folds(df, S.logo_folds(df, "g"), "g").count() == 4
    assert S.stratified_holdout(df.withColumn("label", F.lit(None).cast("string")), "label", "id", 0.5).where("is_val").count() == 2
    assert logo_majority_eval(df, "g", "label").count() == 3
    assert null_baselines(df, "g", "label").count() == 3


def test_hold_outs_and_samples_have_exact_sizes(spark):
    from foldwise.operators import sampling, splits as S
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    for f in (0.05, 0.333, 1.0):
        want = {r.g: int(f * r.n) for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
        got = {r.g: r.n for r in sampling.exact_group_sample(df, "g", "id", f).groupBy("g").agg(F.count("*").alias("n")).collect()}
        assert got == {g: n for g, n in want.items() if n}
    assert S.random_holdout(df, "id", 0.1).where("is_test").count() == 100
    assert sampling.exact_global_sample(df, "id", 0.0005).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sizes_are_exact_when_ids_repeat(spark, seed):
    from foldwise.operators import splits as S
    rows = [(7 if i < 60 else i, "a", i % 3, f"r{i}") for i in range(100)]           # 60 rows share an id
    df = spark.createDataFrame(rows, "id long, g string, y int, x string").repartition(4).cache()
    assert sampling.exact_group_sample(df, "g", "id", 0.3, seed).count() == 30
    assert sampling.exact_global_sample(df, "id", 0.3, seed).count() == 30
    held = S.random_holdout(df, "id", 0.33, seed)
    assert held.columns == [*df.columns, "is_test"] and held.count() == 100 and held.where("is_test").count() == 33
    strat = S.stratified_holdout(df, "y", "id", 0.1, seed)
    assert strat.count() == 100
    assert {r["y"]: r["n"] for r in strat.where("is_val").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3, 2: 3}
    assert sorted(r["x"] for r in strat.collect()) == sorted(r[3] for r in rows)
    picked = sorted(map(tuple, sampling.exact_group_sample(df, "g", "id", 0.3, seed).collect()))
    assert picked == sorted(map(tuple, sampling.exact_group_sample(df, "g", "id", 0.3, seed).collect()))


def test_sizes_are_exact_for_equal_rows_and_null_ids(spark):
    rows = [("a", None)] * 50 + [("b", 3)] * 40 + [("b", 4), (None, 1), (None, 1), (None, 1)] + [("c", i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(3)
    got = sampling.exact_group_sample(df, "g", "id", 0.5)
    assert {r["g"]: r["n"] for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 25, "b": 20, None: 1, "c": 4}
    assert sampling.exact_global_sample(df, "id", 0.5).count() == len(rows) // 2
    assert sampling.exact_group_sample(df.limit(0), "g", "id", 0.5).count() == 0
    assert sampling.exact_global_sample(df.limit(0), "id", 0.5).count() == 0


def test_rows_of_a_sampled_dataset_are_told_apart(spark):
    from foldwise.sources.files import row_text
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "", "b"), ("a", None, "b")],
                               "x string, y string, z string")
    texts = [r[0] for r in df.select(row_text(df)).collect()]
    assert len(set(texts)) == 4 and texts[0] == texts[4]
