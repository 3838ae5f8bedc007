"""Registry / history queries over histories and per-group results derived
from the driver tables.

* evaluation history: trial = user, round = position of the event in the
  user's time order (exact, skew-safe sequence), score = value
* per-group results: the flagship leave-one-group-out evaluation
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import history as H
from foldwise.operators import registry as R
from foldwise.operators.ranking import exact_sequence
from foldwise.plans.catalog import query
from foldwise.plans.q_labels import LOGO_CTES, q_logo_majority_eval
from foldwise.plans.sqlparts import EV_CLEAN, with_
from foldwise.session import read_table

PATIENCE = 5

_HIST_SQL = r"""
h AS (SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round,
             CAST(round(value * 100) AS BIGINT) AS score FROM events)"""


def trial_score_rows(spark, sf_dir):
    """(trial, score) of every event, without the rounds."""
    # integer score (value in hundredths): sums are exact, so means agree to the last bit
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("trial"),
                                                      F.round(F.col("value") * 100).cast("bigint").alias("score"))


def eval_history(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    seq = exact_sequence(ev.select("user_id", "ts", "event_id", "value"), ["user_id"],
                         [F.col("ts"), F.col("event_id")], F.date_format("ts", "yyyyMMddHHmm"), "round")
    return seq.select(F.col("user_id").alias("trial"), "round",
                      F.round(F.col("value") * 100).cast("bigint").alias("score"))


@query("best_round", with_(_HIST_SQL, r"""
r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score DESC, round) AS rn FROM h)
SELECT trial, round AS best_round, score AS best_score FROM r WHERE rn = 1"""))
def q_best_round(spark, sf_dir):
    return H.best_round(eval_history(spark, sf_dir))


@query("early_stop_round", with_(_HIST_SQL, rf"""
rb AS (SELECT *, max(score) OVER (PARTITION BY trial ORDER BY round
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM h),
nb AS (SELECT *, max(CASE WHEN prev_max IS NULL OR score > prev_max THEN round END)
                   OVER (PARTITION BY trial ORDER BY round ROWS UNBOUNDED PRECEDING) AS run_best_round FROM rb),
st AS (SELECT trial, min(round) AS stop_round, arg_min(run_best_round, round) AS best_round_at_stop
       FROM nb WHERE round - run_best_round >= {PATIENCE} GROUP BY trial)
SELECT t.trial, st.stop_round, st.best_round_at_stop
FROM (SELECT DISTINCT trial FROM h) t LEFT JOIN st USING (trial)"""))
def q_early_stop_round(spark, sf_dir):
    return H.early_stop_round(eval_history(spark, sf_dir), PATIENCE)


@query("trial_scores", with_(_HIST_SQL, r"""
z AS (SELECT 1)
SELECT trial, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, count(*) AS n_folds
FROM h GROUP BY trial"""))
def q_trial_scores(spark, sf_dir):
    return H.trial_scores(trial_score_rows(spark, sf_dir))


@query("best_trial", with_(_HIST_SQL, r"""
m AS (SELECT trial, avg(score) AS score FROM h GROUP BY trial)
SELECT trial, round(score, 6) AS score FROM m ORDER BY score DESC, trial LIMIT 1"""))
def q_best_trial(spark, sf_dir):
    means = trial_score_rows(spark, sf_dir).groupBy("trial").agg(F.avg("score").alias("score"))
    return H.best_trial(means).select("trial", F.round("score", 6).alias("score"))


@query("cv_summary", with_(EV_CLEAN, LOGO_CTES) + r"""
SELECT count(*) AS n_folds, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
       round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy,
       round(avg(macro_f1), 6) AS mean_f1
FROM logo""")
def q_cv_summary(spark, sf_dir):
    return R.cv_summary(q_logo_majority_eval(spark, sf_dir), "accuracy", "macro_f1")


@query("fold_interval", with_(EV_CLEAN, LOGO_CTES) + r"""
SELECT count(*) AS n_folds, round(avg(accuracy), 6) AS mean, round(var_samp(accuracy), 6) AS variance,
       round(stddev_samp(accuracy) / sqrt(count(*)), 6) AS std_error,
       round(avg(accuracy) - 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS low,
       round(avg(accuracy) + 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS high
FROM logo""")
def q_fold_interval(spark, sf_dir):
    """Variance and interval of the accuracy across held-out groups."""
    return R.fold_interval(q_logo_majority_eval(spark, sf_dir), "accuracy")


@query("hardest_easiest_groups", with_(EV_CLEAN, LOGO_CTES) + r""",
hard AS (SELECT 'hardest' AS kind, CAST(row_number() OVER (ORDER BY accuracy, home_id) AS INTEGER) AS rank,
                home_id, accuracy FROM logo ORDER BY accuracy, home_id LIMIT 5),
easy AS (SELECT 'easiest' AS kind, CAST(row_number() OVER (ORDER BY accuracy DESC, home_id) AS INTEGER) AS rank,
                home_id, accuracy FROM logo ORDER BY accuracy DESC, home_id LIMIT 5)
SELECT * FROM hard UNION ALL SELECT * FROM easy""")
def q_hardest_easiest_groups(spark, sf_dir):
    return R.hardest_easiest(q_logo_majority_eval(spark, sf_dir), "home_id", "accuracy", 5)


_IMP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("importance_summary", r"""
WITH per AS (
  SELECT l_suppkey, f.feature, f.v AS importance FROM (
    SELECT l_suppkey, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice,
           avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY l_suppkey) a,
  LATERAL (VALUES ('l_quantity', a.l_quantity), ('l_extendedprice', a.l_extendedprice),
                  ('l_discount', a.l_discount), ('l_tax', a.l_tax)) f(feature, v))
SELECT feature, round(avg(importance), 6) AS mean, round(stddev_pop(importance), 6) AS std,
       round(min(importance), 6) AS min, round(max(importance), 6) AS max, count(*) AS n_folds
FROM per GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 3""")
def q_importance_summary(spark, sf_dir):
    """Per-fold feature values (fold = supplier, value = mean of the column)
    summarised across folds; top 3 by mean."""
    li = read_table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _IMP_COLS])
    long = per.unpivot(["l_suppkey"], _IMP_COLS, "feature", "importance")
    return R.importance_summary(long, top=3)


@query("group_leaderboard", with_(EV_CLEAN, LOGO_CTES) + r""",
last AS (SELECT user_id AS home_id, strftime(max(ts), '%Y%m%d_%H%M%S') AS ts_str FROM events GROUP BY 1),
runs AS (SELECT l.home_id, l.macro_f1 AS score, l.accuracy, l.weighted_f1, last.ts_str,
                (SELECT count(DISTINCT activity_general) FROM ev_clean e WHERE e.home_id = l.home_id) AS n_classes
         FROM logo l JOIN last USING (home_id)),
ok AS (SELECT * FROM runs WHERE n_classes = 2)
SELECT CAST(row_number() OVER (ORDER BY score DESC, strptime(ts_str, '%Y%m%d_%H%M%S') DESC, CAST(home_id AS VARCHAR))
            AS INTEGER) AS rank,
       CAST(home_id AS VARCHAR) AS source_file, ts_str AS timestamp, printf('%.4f', score) AS cv_macro_f1,
       printf('%.4f', weighted_f1) AS train_macro_f1, printf('%.4f', accuracy) AS train_accuracy
FROM ok ORDER BY score DESC, strptime(ts_str, '%Y%m%d_%H%M%S') DESC, CAST(home_id AS VARCHAR) LIMIT 5""")
def q_group_leaderboard(spark, sf_dir):
    """Leaderboard over per-group evaluation runs (a run per held-out group):
    comparable runs = both general classes present, top 5 by macro-F1 then
    recency."""
    from foldwise.plans.q_labels import clean_events
    logo = q_logo_majority_eval(spark, sf_dir)
    ev = clean_events(spark, sf_dir)
    last = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("home_id")).agg(
        F.date_format(F.max("ts"), "yyyyMMdd_HHmmss").alias("timestamp"))
    ncls = ev.groupBy("home_id").agg(F.countDistinct("activity_general").alias("n_classes"))
    runs = (logo.join(last, "home_id").join(ncls, "home_id").select(
        F.col("home_id").cast("string").alias("source_file"), "timestamp",
        F.to_timestamp_ntz("timestamp", F.lit("yyyyMMdd_HHmmss")).alias("ts"),
        F.lit("majority").alias("api"), F.lit("activity_general_events").alias("target"),
        F.lit(None).cast("double").alias("sample_fraction"),
        F.col("macro_f1").alias("cv_primary"), F.col("weighted_f1").alias("train_f1_macro"),
        F.col("accuracy").alias("train_accuracy"), F.col("n_classes").cast("bigint").alias("n_classes"),
        F.lit(2).cast("bigint").alias("expected_n_classes")))
    lb = R.leaderboard(runs, 5)
    return lb.select("rank", "source_file", "timestamp", "cv_macro_f1", "train_macro_f1", "train_accuracy")


N_BOOT = 200


@query("bootstrap_home_sums", with_(EV_CLEAN, LOGO_CTES, f"""
a AS (SELECT home_id, accuracy FROM logo),
w AS (SELECT a.accuracy, b.replicate, ('0x' || substr(md5('42|' || b.replicate || '|' || a.home_id), 1, 8))::BIGINT AS u
  FROM a, (SELECT CAST(range AS INTEGER) AS replicate FROM range({N_BOOT})) b),
p AS (SELECT replicate, accuracy, {" + ".join(f"(u >= {t})::INTEGER" for t in R.POISSON_STEPS)} AS n FROM w)
SELECT replicate, CAST(sum(n) AS BIGINT) AS weight, round(sum(n * accuracy), 6) AS weighted FROM p GROUP BY replicate"""))
def q_bootstrap_home_sums(spark, sf_dir):
    """Poisson bootstrap over homes of the leave-one-home-out accuracy: weights and weighted scores of every replicate."""
    per = q_logo_majority_eval(spark, sf_dir)
    return R.bootstrap_sums(per, "accuracy", "home_id", N_BOOT).withColumn("weighted", F.round("weighted", 6))
