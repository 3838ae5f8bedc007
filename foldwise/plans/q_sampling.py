"""Sampling and split queries over the labelled events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import sampling, splits
from foldwise.plans.catalog import query
from foldwise.plans.q_labels import clean_events
from foldwise.plans.sqlparts import EV_CLEAN, with_

_COLS = ["event_id", "home_id", "activity", "activity_general"]


def _ev(spark, sf_dir):
    return clean_events(spark, sf_dir).select(*_COLS)


@query("exact_group_sample", with_(EV_CLEAN, r"""
k AS (SELECT event_id, home_id, activity, activity_general,
             row_number() OVER (PARTITION BY home_id
                                ORDER BY md5('42|' || home_id || '|' || event_id), event_id) AS rn,
             count(*) OVER (PARTITION BY home_id) AS n
      FROM ev_clean)
SELECT event_id, home_id, activity, activity_general FROM k WHERE rn <= floor(0.3 * n)"""))
def q_exact_group_sample(spark, sf_dir):
    return sampling.exact_group_sample(_ev(spark, sf_dir), "home_id", "event_id", 0.3, seed=42)


@query("exact_global_sample", with_(EV_CLEAN, r"""
k AS (SELECT event_id, home_id, activity, activity_general,
             row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS rn,
             count(*) OVER () AS n
      FROM ev_clean)
SELECT event_id, home_id, activity, activity_general FROM k WHERE rn <= floor(0.05 * n)"""))
def q_exact_global_sample(spark, sf_dir):
    return sampling.exact_global_sample(_ev(spark, sf_dir), "event_id", 0.05, seed=7)


@query("home_subset", with_(EV_CLEAN, r"""
h AS (SELECT DISTINCT home_id FROM ev_clean ORDER BY home_id LIMIT 3),
s AS (SELECT e.* FROM ev_clean e WHERE home_id IN (SELECT home_id FROM h)),
k AS (SELECT event_id, home_id, activity, activity_general,
             row_number() OVER (ORDER BY md5('42|' || event_id), event_id) AS rn, count(*) OVER () AS n FROM s)
SELECT event_id, home_id, activity, activity_general FROM k WHERE rn <= floor(0.05 * n)"""))
def q_home_subset(spark, sf_dir):
    """Quick-test subset: first 3 groups in sorted order, then an exact 5 % sample."""
    return sampling.quick_subset(_ev(spark, sf_dir), "home_id", n_groups=3, fraction=0.05,
                                 id_col="event_id", seed=42)


@query("diagonal_union", with_(EV_CLEAN, r"""
a AS (SELECT event_id, home_id, activity, value, CAST(NULL AS VARCHAR) AS props
      FROM ev_clean WHERE activity_general = 'browse'),
b AS (SELECT event_id, home_id, activity, CAST(NULL AS DOUBLE) AS value, props
      FROM ev_clean WHERE activity_general = 'convert')
SELECT * FROM a UNION ALL SELECT * FROM b"""))
def q_diagonal_union(spark, sf_dir):
    ev = clean_events(spark, sf_dir)
    a = ev.filter(F.col("activity_general") == "browse").select("event_id", "home_id", "activity", "value")
    b = ev.filter(F.col("activity_general") == "convert").select("event_id", "home_id", "activity", "props")
    return a.unionByName(b, allowMissingColumns=True)


@query("fold_logo", with_(EV_CLEAN, r"""
s AS (SELECT home_id, count(*) AS n FROM ev_clean GROUP BY 1)
SELECT home_id, CAST(row_number() OVER (ORDER BY home_id) - 1 AS INTEGER) AS fold,
       n AS n_test, CAST(sum(n) OVER () - n AS BIGINT) AS n_train FROM s"""))
def q_fold_logo(spark, sf_dir):
    return splits.logo_folds(_ev(spark, sf_dir), "home_id")


@query("fold_group_kfold", with_(EV_CLEAN, r"""
s AS (SELECT home_id, count(*) AS n FROM ev_clean GROUP BY 1),
r AS (SELECT home_id, n, row_number() OVER (ORDER BY n DESC, home_id) - 1 AS r FROM s)
SELECT home_id,
       CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 5 - 1 - r % 5 END AS INTEGER) AS fold, n FROM r"""))
def q_fold_group_kfold(spark, sf_dir):
    """Balanced group k-fold, distributed snake order (k = 5)."""
    return splits.snake_group_kfold(_ev(spark, sf_dir), "home_id", 5)


@query("fold_group_kfold_greedy", "WITH RECURSIVE " + EV_CLEAN.strip() + r""",
s AS (
  SELECT home_id, n, row_number() OVER (ORDER BY n DESC, home_id) AS i
  FROM (SELECT home_id, count(*) AS n FROM ev_clean GROUP BY 1)),
r AS (
  SELECT 0 AS i, CAST(NULL AS BIGINT) AS home_id, CAST(NULL AS INTEGER) AS fold, CAST(NULL AS BIGINT) AS n,
         [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT q.i, q.home_id, q.f, q.n,
         list_transform(range(5), lambda j: q.loads[j + 1] + CASE WHEN j = q.f THEN q.n ELSE 0 END)
  FROM (SELECT s.i, s.home_id, s.n, r.loads,
               CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER) AS f
        FROM r JOIN s ON s.i = r.i + 1) q)
SELECT home_id, fold, n FROM r WHERE i > 0""")
def q_fold_group_kfold_greedy(spark, sf_dir):
    """GroupKFold greedy assignment (sequential over per-group sizes)."""
    return splits.greedy_group_kfold(_ev(spark, sf_dir), "home_id", 5)


@query("fold_stratified", with_(EV_CLEAN, r"""
k AS (SELECT event_id, home_id, activity_general,
             row_number() OVER (PARTITION BY activity_general ORDER BY md5('42|' || event_id), event_id) AS rn
      FROM ev_clean)
SELECT event_id, home_id, activity_general, CAST((rn - 1) % 3 AS INTEGER) AS fold FROM k"""))
def q_fold_stratified(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "home_id", "activity_general")
    return splits.stratified_folds(ev, "activity_general", "event_id", n_splits=3, seed=42)


@query("holdout_stratified", with_(EV_CLEAN, r"""
k AS (SELECT event_id, activity,
             row_number() OVER (PARTITION BY activity ORDER BY md5('42|' || event_id), event_id) AS rn,
             count(*) OVER (PARTITION BY activity) AS n
      FROM ev_clean)
SELECT event_id, activity, rn <= round(0.1 * n) AS is_val FROM k"""))
def q_holdout_stratified(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("event_id", "activity")
    return splits.stratified_holdout(ev, "activity", "event_id", fraction=0.1, seed=42)


@query("holdout_random", with_(EV_CLEAN, r"""
k AS (SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) AS rn,
             count(*) OVER () AS n FROM ev_clean)
SELECT event_id, rn <= ceil(0.33 * n) AS is_test FROM k"""))
def q_holdout_random(spark, sf_dir):
    return splits.random_holdout(_ev(spark, sf_dir).select("event_id"), "event_id", 0.33, seed=42)


@query("fold_assign_rows", with_(EV_CLEAN, r"""
s AS (SELECT home_id, count(*) AS n FROM ev_clean GROUP BY 1),
r AS (SELECT home_id, row_number() OVER (ORDER BY n DESC, home_id) - 1 AS r FROM s),
f AS (SELECT home_id, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 5 - 1 - r % 5 END AS INTEGER) AS fold FROM r)
SELECT f.fold, CAST(count(*) AS BIGINT) AS n_val, count(DISTINCT e.home_id) AS n_groups
FROM ev_clean e JOIN f USING (home_id) GROUP BY f.fold"""))
def q_fold_assign_rows(spark, sf_dir):
    """Row -> fold by group join, then rows and groups per fold (invariant view)."""
    ev = _ev(spark, sf_dir)
    fm = splits.snake_group_kfold(ev, "home_id", 5)
    return (splits.assign_folds(ev, fm, "home_id").groupBy("fold")
                  .agg(F.count(F.lit(1)).alias("n_val"), F.countDistinct("home_id").alias("n_groups")))


@query("fold_progress", with_(EV_CLEAN, r"""
s AS (SELECT home_id, count(*) AS n FROM ev_clean GROUP BY 1),
r AS (SELECT home_id, n, row_number() OVER (ORDER BY n DESC, home_id) - 1 AS r FROM s),
f AS (SELECT CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 5 - 1 - r % 5 END AS INTEGER) AS fold, n FROM r),
c AS (SELECT fold, CAST(sum(n) AS DOUBLE) / 1000 AS seconds FROM f GROUP BY fold)
SELECT fold, seconds, CAST(row_number() OVER (ORDER BY fold) AS INTEGER) AS done, 5 AS total,
       round(avg(seconds) OVER (ORDER BY fold ROWS UNBOUNDED PRECEDING), 6) AS avg_seconds,
       round(avg(seconds) OVER (ORDER BY fold ROWS UNBOUNDED PRECEDING) * (5 - row_number() OVER (ORDER BY fold)), 6)
         AS eta_seconds
FROM c"""))
def q_fold_progress(spark, sf_dir):
    """Progress / remaining-time estimate over the folds of a grouped split,
    with a fold's cost taken as its validation rows / 1000."""
    from foldwise.operators.history import fold_progress
    ev = _ev(spark, sf_dir)
    fm = splits.snake_group_kfold(ev, "home_id", 5)
    cost = fm.groupBy("fold").agg((F.sum("n").cast("double") / 1000).alias("seconds"))
    out = fold_progress(cost, "fold", "seconds", total_folds=5)
    return out.select("fold", "seconds", F.col("done").cast("int").alias("done"), F.col("total").cast("int").alias("total"),
                      F.round("avg_seconds", 6).alias("avg_seconds"), F.round("eta_seconds", 6).alias("eta_seconds"))
