"""Model search over candidate settings: trials x folds, or trials x folds x boosting rounds.

Every fit is a unit of a ledger (``operators.ledger``): fits run on driver
threads over one persisted table, a finished one is never fitted again, and a
search that was stopped goes on where it was.  Scores and curves are small
tables (one row per trial, fold and round); the rows themselves stay where they
are: a fold is a filter, a fit sees about ``max_fit_rows`` of them, and scoring
returns counts.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import history as H
from foldwise.operators import registry as R
from foldwise.operators import train as T
from foldwise.operators.ledger import Ledger, run_units
from foldwise.operators.metrics import summary_metrics

FIT_ROWS = 20_000


@dataclass
class SearchResult:
    """What a search found.  ``trials``: (trial, params, n_folds, score, best_rounds, is_best) rows, best_rounds null
    without rounds; ``curve``: (trial, fold, round, score) rows, round 0 without rounds."""
    trials: DataFrame
    curve: DataFrame
    best_trial: int
    best_params: dict[str, Any]
    best_score: float
    best_rounds: int | None
    final_rounds: int | None
    model: Any
    train_metrics: dict[str, float]
    trial_rows: list[dict] = field(default_factory=list)


def _text(params: dict[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in params.items()}


def _split(data: DataFrame, fold_col: str, fold: int, sizes: dict[int, int], max_fit_rows: int | None, id_col: str, seed: int):
    """(rows to fit, rows to score) of a fold."""
    rest = data.filter(F.col(fold_col) != fold)
    fit = T.fit_share(rest, sum(n for k, n in sizes.items() if k != fold), max_fit_rows, id_col, "label", seed=seed)
    return fit, data.filter(F.col(fold_col) == fold)


class _Splits:
    """The split of each fold, made once for all trials: the rows to fit are kept, so no trial scans the table for them."""

    def __init__(self, *args):
        self.args, self.made, self.lock = args, {}, threading.Lock()

    def of(self, fold: int):
        data, fold_col, *rest = self.args
        with self.lock:
            if fold not in self.made:
                fit, test = _split(data, fold_col, fold, *rest)
                self.made[fold] = T.persist(fit), T.spread(test)
            return self.made[fold]

    def unpersist(self) -> None:
        for fit, _ in self.made.values():
            fit.unpersist()


def _sizes(data: DataFrame, fold_col: str) -> dict[int, int]:
    """Rows of each fold."""
    return {r[0]: r[1] for r in data.groupBy(fold_col).agg(F.count(F.lit(1))).orderBy(fold_col).collect()}


def _refit(data: DataFrame, learner: str, params: dict[str, Any], seed: int, rows: int, max_fit_rows: int | None, id_col: str):
    """The model on all folds' rows, and its metrics on the rows it was fitted on."""
    fit = T.persist(T.fit_share(data, rows, max_fit_rows, id_col, "label", seed=seed))
    model = T.make_classifier(learner, params, seed, counted=True).fit(fit)
    row = T.model_metrics(model, fit)
    fit.unpersist()
    return model, {"train_f1_macro": float(row["macro_f1"]), "train_f1_weighted": float(row["weighted_f1"]),
                   "train_accuracy": float(row["accuracy"])}


def kfold_scores(data: DataFrame, params: dict[str, Any] | None = None, learner: str = "rf", metric: str = "weighted_f1",
                 fold_col: str = "fold", id_col: str = "id", max_fit_rows: int | None = FIT_ROWS, seed: int = 42,
                 parallelism: int = 4, ledger: Ledger | None = None) -> DataFrame:
    """(fold, n_test, score, seconds): k-fold score of one setting by ``metric`` (weighted_f1, macro_f1 or accuracy)."""
    sizes = _sizes(data, fold_col)

    def one(unit: str) -> dict:
        began, fold = time.time(), int(unit.split(":")[1])
        fit, test = _split(data, fold_col, fold, sizes, max_fit_rows, id_col, seed)
        model = T.make_classifier(learner, params, seed).fit(fit)
        row = T.fold_metrics(model.transform(test))
        return {"score": float(row[metric]), "seconds": time.time() - began}

    found = run_units([f"fold:{k}" for k in sizes], one, ledger, parallelism)
    rows = [(k, n, found[f"fold:{k}"]["score"], found[f"fold:{k}"]["seconds"]) for k, n in sizes.items()]
    return data.sparkSession.createDataFrame(rows, "fold int, n_test bigint, score double, seconds double")


def random_search(data: DataFrame, candidates: Sequence[dict[str, Any]], learner: str = "rf", metric: str = "macro_f1",
                  fold_col: str = "fold", id_col: str = "id", max_fit_rows: int | None = FIT_ROWS, seed: int = 42,
                  parallelism: int = 4, halving: int | None = None, ledger: Ledger | None = None) -> SearchResult:
    """Every candidate on every fold; the best mean score (ties: the earlier trial) is fitted on all rows.

    ``halving``: after each of the first folds only the best 1 / ``halving`` of the candidates go on (at least one);
    the best is chosen among those that saw all folds.  Without it, the full search."""
    sizes, spark = _sizes(data, fold_col), data.sparkSession
    folds, splits = list(sizes), _Splits(data, fold_col, sizes, max_fit_rows, id_col, seed)

    def one(unit: str) -> dict:
        began, (trial, fold) = time.time(), (int(x) for x in unit.removeprefix("trial:").split("/fold:"))
        fit, test = splits.of(fold)
        model = T.make_classifier(learner, candidates[trial - 1], seed + trial + fold, counted=True).fit(fit)
        row = T.model_metrics(model, test)
        return {"score": float(row[metric]), "seconds": time.time() - began}

    scores: dict[int, dict[int, float]] = {t: {} for t in range(1, len(candidates) + 1)}
    mean = lambda t: sum(scores[t].values()) / len(scores[t])
    alive = list(scores)
    steps = [folds] if halving is None else [[k] for k in folds]
    for i, step in enumerate(steps):
        found = run_units([f"trial:{t}/fold:{k}" for t in alive for k in step], one, ledger, parallelism)
        for t in alive:
            scores[t] |= {k: found[f"trial:{t}/fold:{k}"]["score"] for k in step}
        if halving is not None and i + 1 < len(steps):
            alive = sorted(sorted(alive, key=lambda t: (-mean(t), t))[:max(1, math.ceil(len(alive) / halving))])
    splits.unpersist()
    best = min(alive, key=lambda t: (-mean(t), t))
    model, train = _refit(data, learner, candidates[best - 1], seed, sum(sizes.values()), max_fit_rows, id_col)
    rows = [{"trial": t, "params": _text(candidates[t - 1]), "n_folds": len(scores[t]), "score": mean(t), "best_rounds": None,
             "is_best": t == best} for t in scores]
    trials = _trials(spark, rows)
    curve = spark.createDataFrame([(t, k, 0, s) for t, by in scores.items() for k, s in by.items()],
                                  "trial int, fold int, round int, score double")
    return SearchResult(trials, curve, best, dict(candidates[best - 1]), mean(best), None, None, model, train, rows)


def _trials(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["trial"], r["params"], r["n_folds"], r["score"], r["best_rounds"], r["is_best"]) for r in rows],
                                 "trial int, params map<string,string>, n_folds int, score double, best_rounds int, is_best boolean")


# ---- rounds ---------------------------------------------------------------------------------------------------------

def round_confusions(model, data: DataFrame, n_rounds: int, features_col: str = "features") -> DataFrame:
    """(round, actual, predicted, n): counts of ``label`` and the class predicted after 1 .. ``n_rounds`` rounds of a
    one-vs-rest boosted model, from one evaluation of each tree; a task returns counts."""
    from pyspark.ml.functions import vector_to_array
    shared = data.sparkSession.sparkContext.broadcast(T.class_trees(model, n_rounds))    # trees x nodes, whatever the rows
    k = len(model.models)

    def run(batches):
        import pyarrow as pa
        count = np.zeros((n_rounds, k, k), np.int64)
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            label = np.array(batch.column(1)).astype(np.int64)
            margin = np.zeros((batch.num_rows, k))
            for r in range(n_rounds):
                for c, own in enumerate(shared.value):
                    if r < len(own):
                        margin[:, c] += own[r][0] * T.tree_values(own[r][1], x)
                np.add.at(count[r], (label, margin.argmax(axis=1)), 1)
        r, a, p = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in (
            (r + 1, pa.int32()), (a.astype(float), pa.float64()), (p.astype(float), pa.float64()), (count[r, a, p], pa.int64()))],
            ["round", "actual", "predicted", "n"])

    rows = data.select(vector_to_array(F.col(features_col)).alias("x"), F.col("label").cast("double").alias("y"))
    counts = rows.mapInArrow(run, "round int, actual double, predicted double, n bigint")
    return counts.groupBy("round", "actual", "predicted").agg(F.sum("n").alias("n"))


def round_search(data: DataFrame, candidates: Sequence[dict[str, Any]], n_rounds: int, patience: int = 50,
                 learning_rate: float | None = None, force_final_rounds: bool = False, metric: str = "macro_f1",
                 fold_col: str = "fold", id_col: str = "id", max_fit_rows: int | None = FIT_ROWS, seed: int = 42,
                 parallelism: int = 4, ledger: Ledger | None = None) -> SearchResult:
    """Search over trials, folds and boosting rounds.

    Each (trial, fold) gives a curve of scores by round.  A trial's curve is the mean over its folds, cut where
    ``patience`` rounds bring nothing better; its best round is the first with the highest score.  The best trial
    (ties: the earlier) is fitted on all rows with its best rounds, or with ``n_rounds`` if ``force_final_rounds``.
    ``learning_rate`` overrides the candidates'.  With a ledger, each finished trial adds a row ``checkpoint:<trial>``."""
    candidates = [dict(c, **({} if learning_rate is None else {"learning_rate": learning_rate})) for c in candidates]
    sizes, spark = _sizes(data, fold_col), data.sparkSession
    left, splits = {t: set(sizes) for t in range(1, len(candidates) + 1)}, _Splits(data, fold_col, sizes, max_fit_rows, id_col, seed)

    def one(unit: str) -> dict:
        trial, fold = (int(x) for x in unit.removeprefix("trial:").split("/fold:"))
        fit, test = splits.of(fold)
        model = T.make_classifier("ovr_gbt", dict(candidates[trial - 1], n_estimators=n_rounds), seed + trial, counted=True).fit(fit)
        scores = summary_metrics(round_confusions(model, test, n_rounds), ["round"], digits=None)
        return {"curve": [float(r[metric]) for r in scores.select("round", metric).orderBy("round").collect()]}    # one row a round

    def done(unit: str, _: dict) -> None:
        trial, fold = (int(x) for x in unit.removeprefix("trial:").split("/fold:"))
        left[trial].discard(fold)
        if ledger is not None and not left[trial]:
            ledger.append([(f"checkpoint:{trial}", 1, "done", {"trial": trial, "params": candidates[trial - 1]})])

    units = [f"trial:{t}/fold:{k}" for t in left for k in sizes]
    found = run_units(units, one, ledger, parallelism, done)
    splits.unpersist()
    rows = [(t, k, r, s) for t in left for k in sizes for r, s in enumerate(found[f"trial:{t}/fold:{k}"]["curve"], 1)]
    curve = spark.createDataFrame(rows, "trial int, fold int, round int, score double")
    mean = curve.groupBy("trial", "round").agg(F.avg("score").alias("score"))
    stop = H.early_stop_round(mean, patience)
    upto = mean.join(stop, "trial").filter(F.col("stop_round").isNull() | (F.col("round") <= F.col("stop_round")))
    best = H.best_round(upto.select("trial", "round", "score"))
    top = H.best_trial(best.select("trial", F.col("best_score").alias("score"))).first()
    if top is None or top["trial"] is None:
        raise RuntimeError("no trial has a valid score")
    by = {r["trial"]: r for r in best.collect()}        # one row a trial
    rounds = int(by[top["trial"]]["best_round"])
    final = n_rounds if force_final_rounds else rounds
    params = candidates[top["trial"] - 1]
    model, train = _refit(data, "ovr_gbt", dict(params, n_estimators=final), seed, sum(sizes.values()), max_fit_rows, id_col)
    rows = [{"trial": t, "params": _text(candidates[t - 1]), "n_folds": len(sizes), "score": float(by[t]["best_score"]),
             "best_rounds": int(by[t]["best_round"]), "is_best": t == top["trial"]} for t in left if t in by]
    return SearchResult(_trials(spark, rows), curve, top["trial"], params, float(top["score"]), rounds, final, model, train, rows)


# ---- records --------------------------------------------------------------------------------------------------------

def search_record(spark, result: SearchResult, api: str, target: str, classes: Sequence[str], features: Sequence[str],
                  timestamp: str, **details) -> DataFrame:
    """The run record of a search, with its trials, in the registry's schema (one row, to append)."""
    history = [(r["trial"], r["score"], r["params"]) for r in result.trial_rows]
    known = {"best_params": _text(result.best_params), "best_cv_f1_macro": result.best_score, "best_num_boost_round": result.best_rounds,
             "final_num_boost_round": result.final_rounds, "n_folds": max(r["n_folds"] for r in result.trial_rows),
             "trial_scores": history} | details
    fields = R.RUN_RECORD_SCHEMA["details"].dataType.names
    if unknown := set(known) - set(fields):
        raise ValueError(f"unknown details: {sorted(unknown)}")
    train = result.train_metrics
    return R.make_run_record(
        spark, timestamp=timestamp, api=api, target_column=target, metric_primary="f1_macro", metric_primary_cv=result.best_score,
        train_metrics=(train["train_f1_macro"], train["train_f1_weighted"], train["train_accuracy"]), feature_count=len(features),
        features=list(features), classes=list(classes), details=tuple(known.get(f) for f in fields))


def search_checkpoint(spark, result: SearchResult, api: str, n_rounds: int, patience: int, learning_rate: float | None = None,
                      force_final_rounds: bool = False) -> DataFrame:
    """The search as one checkpoint row in the registry's schema: the trials so far and the best of them."""
    history = [(r["trial"], r["score"], r["best_rounds"], r["params"]) for r in result.trial_rows]
    best = next(h for h, r in zip(history, result.trial_rows) if r["is_best"])
    row = (api, result.trial_rows[0]["n_folds"], n_rounds, patience, learning_rate, force_final_rounds, len(history), history, best)
    return spark.createDataFrame([row], R.CHECKPOINT_SCHEMA)
