"""Evaluation-history operators: best round, patience stop, best trial, progress.

A history table has one row per (trial, round, score).  Rounds of one trial
are a sequence, so running maxima are computed per (trial, chunk of rounds)
with a carry from earlier chunks (one row per chunk): a trial with a huge
number of rounds is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import null_safe_join

DEFAULT_CHUNK = 4096


def _clean(history: DataFrame, score: str) -> DataFrame:
    # NaN never wins (Spark sorts NaN above every number)
    return history.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))


def best_round(history: DataFrame, trial: str = "trial", rnd: str = "round", score: str = "score") -> DataFrame:
    """Per trial: the first round reaching the maximum score (idxmax + 1)."""
    best = _clean(history, score).groupBy(trial).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col(rnd)).alias("neg_r"))).alias("b"))
    return best.select(trial, (-F.col("b.neg_r")).cast(history.schema[rnd].dataType).alias("best_round"),
                       F.col("b.s").alias("best_score"))


def running_best(history: DataFrame, trial: str = "trial", rnd: str = "round", score: str = "score",
                 chunk_rounds: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``run_best_score`` / ``run_best_round``: the best so far (first
    occurrence on ties) at each round."""
    h = _clean(history, score).withColumn("__chunk", F.floor(F.col(rnd) / chunk_rounds))
    key = F.struct(F.col(score).alias("s"), (-F.col(rnd)).alias("neg_r"))
    w = Window.partitionBy(trial, "__chunk").orderBy(rnd).rowsBetween(Window.unboundedPreceding, 0)
    inner = h.withColumn("__in", F.max(key).over(w))
    per_chunk = h.groupBy(trial, "__chunk").agg(F.max(key).alias("__m"))
    wc = Window.partitionBy(trial).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(trial, "__chunk", F.max("__m").over(wc).alias("__carry"))
    j = null_safe_join(inner, carry, [trial, "__chunk"], "left")
    best = F.greatest(F.col("__in"), F.col("__carry"))
    return (j.withColumns({"run_best_score": best["s"], "run_best_round": (-best["neg_r"])})
             .drop("__chunk", "__in", "__carry"))


def early_stop_round(history: DataFrame, patience: int, trial: str = "trial", rnd: str = "round",
                     score: str = "score", chunk_rounds: int = DEFAULT_CHUNK) -> DataFrame:
    """Per trial: the round at which training with ``patience`` rounds without
    improvement stops (NULL if it never stops), and the best round then."""
    rb = running_best(history, trial, rnd, score, chunk_rounds)
    stop = rb.filter(F.col(rnd) - F.col("run_best_round") >= patience)
    first = stop.groupBy(trial).agg(F.min(F.struct(F.col(rnd).alias("r"), F.col("run_best_round").alias("b")))
                                    .alias("x"))
    trials = history.select(trial).distinct()
    return (null_safe_join(trials, first, trial, "left")
                  .select(trial, F.col("x.r").alias("stop_round"), F.col("x.b").alias("best_round_at_stop")))


def best_trial(scores: DataFrame, trial: str = "trial", score: str = "score") -> DataFrame:
    """The trial with the strictly highest score; ties go to the lower trial."""
    best = _clean(scores, score).agg(F.min(F.struct((-F.col(score)).alias("neg"), F.col(trial).alias("t")))
                                     .alias("b"))
    return best.select(F.col("b.t").alias(trial), (-F.col("b.neg")).alias(score))


def trial_scores(fold_scores: DataFrame, trial: str = "trial", score: str = "score",
                 digits: int = 6) -> DataFrame:
    """Mean and population std of fold scores per trial (AGG-13)."""
    return fold_scores.groupBy(trial).agg(F.round(F.avg(score), digits).alias("mean_score"),
                                          F.round(F.stddev_pop(score), digits).alias("std_score"),
                                          F.count(F.lit(1)).alias("n_folds"))


def fold_progress(folds: DataFrame, fold: str = "fold", seconds: str = "seconds",
                  total_folds: int | None = None) -> DataFrame:
    """Running average fold time and remaining-time estimate, in fold order.

    One row per fold: the window runs over the fold table, not the data."""
    w = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, 0)
    total = F.lit(total_folds) if total_folds is not None else F.count(F.lit(1)).over(Window.partitionBy())
    done = F.row_number().over(Window.orderBy(fold))
    return folds.select(fold, seconds, done.alias("done"), total.alias("total"),
                        F.avg(seconds).over(w).alias("avg_seconds")) \
                .withColumn("eta_seconds", F.col("avg_seconds") * (F.col("total") - F.col("done")))
