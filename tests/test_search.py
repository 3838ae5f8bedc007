import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import registry as R
from foldwise.operators import search as S
from foldwise.operators import splits
from foldwise.operators import train as T
from foldwise.operators.ledger import DONE, STARTED, Ledger, run_units

SMALL = {"max_depth": 2, "n_estimators": 3}


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    rows = [(i, float(i % 3) + r.random() * 1.2, r.random(), "abc"[i % 3], i % 2, f"h{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, z double, y string, fold int, home_id string")
    out, _ = T.prepare(df, ["x", "z"], "y", keep=["id", "fold", "home_id"])
    out = T.persist(out)
    yield out
    out.unpersist()


# ---- ledger

def test_a_unit_counts_once_and_the_latest_finished_attempt_wins(spark, tmpdir_path):
    book = Ledger(spark, f"{tmpdir_path}/ledger", "w")
    assert book.results() == {} and book.attempts().count() == 0
    book.append([("a", 1, STARTED, None), ("b", 1, STARTED, None), ("c", 1, STARTED, None)])
    book.append([("a", 1, DONE, {"s": 1})])
    book.append([("a", 2, STARTED, None), ("a", 2, DONE, {"s": 2}), ("a", 2, DONE, {"s": 2}), ("a", 3, STARTED, None)])
    book.append([("b", 1, "failed", {"error": "x"}), ("b", 2, STARTED, None)])
    Ledger(spark, f"{tmpdir_path}/ledger", "other").append([("c", 9, DONE, {"s": 9})])
    assert book.results() == {"a": {"s": 2}}
    got = {r["unit"]: (r["attempts"], r["state"]) for r in book.attempts().collect()}
    assert got == {"a": (3, DONE), "b": (2, STARTED), "c": (1, STARTED)}


def test_work_that_was_killed_goes_on_with_the_units_left(spark, tmpdir_path):
    book, calls = Ledger(spark, f"{tmpdir_path}/ledger", "w"), []

    def work(unit, broken=()):
        calls.append(unit)
        if unit in broken:
            raise KeyError(unit)
        return {"unit": unit}

    with pytest.raises(KeyError):
        run_units(list("abcd"), lambda u: work(u, "c"), book, parallelism=1)
    assert set(book.results()) >= {"a", "b"} and "c" not in book.results()
    done, calls[:] = set(book.results()), []
    told = []
    got = run_units(list("abcd"), work, book, parallelism=3, on_done=lambda u, r: told.append(u))
    assert got == {u: {"unit": u} for u in "abcd"}
    assert sorted(calls) == sorted(told) == sorted(set("abcd") - done)
    assert {r["unit"]: r["attempts"] for r in book.attempts().collect()}["c"] == 2
    calls.clear()
    assert run_units(list("abcd"), work, book) == got and not calls


# ---- leave one group out

def test_cuts_of_all_groups_equal_a_holdout_without_the_group(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), r.choice(["h1", "h2", "h3", None])) for i in range(400)] + [(500 + i, "rare", "h1") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, y string, home string")
    ranked = splits.rank_for_holdouts(df, "y", "id", 42).cache()
    cuts = {(c["home"], c["y"]): c for c in splits.group_holdout_cuts(ranked, "y", "home", 0.1).collect()}
    for home in ("h1", "h2", None):
        rest = df.filter(~F.col("home").eqNullSafe(F.lit(home)))
        want = {x["id"] for x in splits.stratified_holdout(rest, "y", "id", 0.1, 42).filter("is_val").collect()}
        got = set()
        for x in ranked.collect():
            c = cuts.get((home, x["y"]))
            cut = c["cut"] if c else round(0.1 * 30)
            if x["home"] != home and x["__rank"] <= cut:
                got.add(x["id"])
        assert got == want


@pytest.mark.parametrize("learner", ["rf", "ovr_gbt"])
def test_leave_one_group_out_resumes_from_a_ledger(spark, data, tmpdir_path, monkeypatch, learner):
    book, fits, make = Ledger(spark, f"{tmpdir_path}/ledger", "logo"), [], T.make_classifier

    def note(*args, **kw):
        fits.append(args[0])
        if len(fits) == 3:
            raise InterruptedError
        return make(*args, **kw)
    monkeypatch.setattr(T, "make_classifier", note)
    run = lambda: T.leave_one_group_out(data, "y", "home_id", "id", ["x", "z"], SMALL, patience=1, learner=learner,
                                        max_fit_rows=100, parallelism=1, ledger=book)
    with pytest.raises(InterruptedError):
        run()
    folds, conf, imp = run()
    assert len(fits) == 3 + 3           # two folds were done, one was lost, three are left
    got = folds.orderBy("fold").collect()
    assert [r["home_id"] for r in got] == [f"h{i}" for i in range(5)]
    for r in got:
        assert (r["n_train"] + r["n_val"], r["n_test"], r["n_val"], r["n_classes"]) == (240, 60, 24, 3) and r["accuracy"] > 0.5
    assert conf.groupBy().sum("n").first()[0] == 300 and imp.count() == 10


def test_fit_rows_are_bounded(spark, data):
    n = T.fit_share(data, 300, 100, "id", "label").count()
    assert 60 < n < 140 and T.fit_share(data, 300, 100, "id", "label").rdd.getNumPartitions() == 1
    assert T.fit_share(data, 300, None, "id").count() == T.fit_share(data, 300, 300, "id").count() == 300


# ---- searches

def test_kfold_scores(data):
    got = S.kfold_scores(data, SMALL, "rf").orderBy("fold").collect()
    assert [(r["fold"], r["n_test"]) for r in got] == [(0, 150), (1, 150)] and all(0.5 < r["score"] <= 1 for r in got)


def test_random_search_feeds_the_registry(spark, data, tmpdir_path):
    cands = [{"max_depth": 1, "n_estimators": 1}, {"max_depth": 4, "n_estimators": 5}, {"max_depth": 3, "n_estimators": 5}]
    book = Ledger(spark, f"{tmpdir_path}/ledger", "search")
    found = S.random_search(data, cands, ledger=book)
    assert found.curve.count() == 6 and found.trials.count() == 3 and len(book.results()) == 6
    means = {r["trial"]: r["m"] for r in found.curve.groupBy("trial").agg(F.avg("score").alias("m")).collect()}
    assert found.best_trial == min(means, key=lambda t: (-means[t], t)) and found.best_params == cands[found.best_trial - 1]
    assert found.model.getNumTrees == found.best_params["n_estimators"]
    path = f"{tmpdir_path}/runs"
    R.append_run(S.search_record(spark, found, "sklearn", "y", ["a", "b", "c"], ["x", "z"], "20260409_205617", cv_scheme="GroupKFold"), path)
    R.append_run(S.search_checkpoint(spark, found, "sklearn", 0, 0), f"{tmpdir_path}/checkpoints")
    runs = R.runs_table(R.read_run_records(spark, path), R.read_checkpoints(spark, f"{tmpdir_path}/checkpoints")).collect()
    assert len(runs) == 1 and runs[0]["cv_primary"] == pytest.approx(found.best_score) and runs[0]["n_classes"] == 3
    assert runs[0]["best_params"] == {k: str(v) for k, v in found.best_params.items()} and runs[0]["cv_folds"] == 2
    trials = R.trials_table(R.read_checkpoints(spark, f"{tmpdir_path}/checkpoints")).collect()
    assert sorted(r["trial"] for r in trials) == [1, 2, 3]


def test_halving_drops_trials_by_their_first_folds(spark, data, monkeypatch):
    cands = [{"max_depth": 1, "n_estimators": 1}, {"max_depth": 4, "n_estimators": 5}, {"max_depth": 3, "n_estimators": 5}, {"max_depth": 1, "n_estimators": 2}]
    found = S.random_search(data, cands, halving=2)
    folds = {r["trial"]: r["n_folds"] for r in found.trials.collect()}
    assert sorted(folds.values()) == [1, 1, 2, 2] and folds[found.best_trial] == 2


def test_round_counts_equal_the_tree_prefixes(data):
    model = T.make_classifier("ovr_gbt", {"n_estimators": 4, "max_depth": 3}).fit(data)
    want = T.ovr_round_predictions(model, data, range(1, 5)).groupBy("round", "label", "prediction").count()
    assert sorted(map(tuple, S.round_confusions(model, data, 4).collect())) == sorted(map(tuple, want.collect()))


def test_round_search(spark, data, tmpdir_path):
    cands = [{"max_depth": 1, "learning_rate": 0.1}, {"max_depth": 3, "learning_rate": 0.3}]
    book = Ledger(spark, f"{tmpdir_path}/ledger", "rounds")
    found = S.round_search(data, cands, n_rounds=4, patience=2, ledger=book)
    curve = {}
    for r in found.curve.collect():
        curve.setdefault((r["trial"], r["round"]), []).append(r["score"])
    assert set(curve) == {(t, r) for t in (1, 2) for r in range(1, 5)} and all(len(v) == 2 for v in curve.values())
    want = {}
    for t in (1, 2):
        best, at = -1.0, 0
        for r in range(1, 5):
            m = sum(curve[t, r]) / 2
            if m > best:
                best, at = m, r
            elif r - at >= 2:
                break
        want[t] = (best, at)
    assert {r["trial"]: (pytest.approx(r["score"]), r["best_rounds"]) for r in found.trials.collect()} == want
    assert found.best_trial == min(want, key=lambda t: (-want[t][0], t)) and found.final_rounds == found.best_rounds == want[found.best_trial][1]
    assert all(len(m.trees) == found.final_rounds for m in found.model.models)
    assert {u for u in book.results() if u.startswith("checkpoint:")} == {"checkpoint:1", "checkpoint:2"}
    again = S.round_search(data, cands, n_rounds=4, patience=2, force_final_rounds=True, ledger=book)      # curves come from the ledger
    assert again.best_rounds == found.best_rounds and again.final_rounds == 4 and len(again.model.models[0].trees) == 4
    forced = S.round_search(data, cands[:1], n_rounds=2, learning_rate=0.5)
    assert forced.best_params["learning_rate"] == 0.5 and forced.trials.first()["params"]["learning_rate"] == "0.5"
    row = S.search_checkpoint(spark, again, "native", 4, 2, None, True).first()
    assert row["trials_completed"] == 2 and row["best_so_far"]["trial"] == again.best_trial and row["force_final_rounds"]


@pytest.mark.parametrize("search", ["random", "rounds"])
def test_rows_of_a_fold_are_picked_once_for_all_trials(data, monkeypatch, search):
    made, split = [], S._split

    def note(frame, fold_col, fold, *args):
        made.append(fold)
        return split(frame, fold_col, fold, *args)
    monkeypatch.setattr(S, "_split", note)
    cands = [{"max_depth": 1, "n_estimators": 2}, {"max_depth": 2, "n_estimators": 2}, {"max_depth": 3, "n_estimators": 2}]
    found = S.random_search(data, cands) if search == "random" else S.round_search(data, cands[:2], n_rounds=2)
    assert sorted(made) == [0, 1] and found.trials.count() == (3 if search == "random" else 2)
