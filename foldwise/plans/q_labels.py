"""Label queries: cleaning, generalisation, indexing, counts, flagship baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import labels as L
from foldwise.operators import baseline, profile
from foldwise.plans.catalog import query
from foldwise.plans.sqlparts import EV_CLEAN, EV_RAW, with_
from foldwise.plans.views import EVENTS_CATCH_ALL, EVENTS_GENERAL_MAP, labelled_events


def clean_events(spark, sf_dir):
    ev = labelled_events(spark, sf_dir)
    return L.clean_and_generalise(ev, "activity", EVENTS_GENERAL_MAP, EVENTS_CATCH_ALL, "activity_general")


LOGO_CTES = r"""
gl AS (SELECT home_id, activity_general AS label, count(*) AS n FROM ev_clean GROUP BY 1, 2),
tot AS (SELECT label, sum(n) AS total FROM gl GROUP BY 1),
homes AS (SELECT home_id, sum(n) AS n_rows, count(*) AS n_present FROM gl GROUP BY 1),
cand AS (
  SELECT h.home_id, t.label, t.total - coalesce(g.n, 0) AS score
  FROM homes h CROSS JOIN tot t
  LEFT JOIN gl g ON g.home_id = h.home_id AND g.label = t.label),
pick AS (
  SELECT home_id, label AS predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY score DESC, label ASC) AS rn FROM cand)
  WHERE rn = 1),
j AS (
  SELECT h.home_id, h.n_rows, h.n_present, p.predicted,
         CAST(coalesce(g.n, 0) AS DOUBLE) AS c, CAST(h.n_rows AS DOUBLE) AS nn,
         h.n_present + CASE WHEN coalesce(g.n, 0) = 0 THEN 1 ELSE 0 END AS k
  FROM homes h JOIN pick p USING (home_id)
  LEFT JOIN gl g ON g.home_id = h.home_id AND g.label = p.predicted),
logo AS (
SELECT home_id, CAST(n_rows AS BIGINT) AS n_rows, predicted,
       round(c / nn, 6) AS accuracy,
       round(2 * c / (c + nn) / k, 6) AS macro_f1,
       round(c * (2 * c / (c + nn)) / nn, 6) AS weighted_f1,
       round((c / nn) / k, 6) AS macro_precision,
       round(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END / k, 6) AS macro_recall
FROM j)"""


@query("logo_majority_eval", with_(EV_CLEAN, LOGO_CTES) + "\nSELECT * FROM logo")
def q_logo_majority_eval(spark, sf_dir):
    """Flagship: clean + generalise labels, leave-one-group-out majority
    baseline, per-group accuracy / macro-F1 / weighted-F1 / macro P and R."""
    return baseline.logo_majority_eval(clean_events(spark, sf_dir), "home_id", "activity_general")


@query("label_clean_generalise", with_(EV_RAW, r"""
x AS (SELECT event_id, home_id, activity AS activity_original,
             regexp_replace(activity, '^r[12]\.', '') AS activity,
             CASE WHEN substr(activity, 1, 3) IN ('r1.', 'r2.') THEN substr(activity, 4) ELSE activity END
               AS activity_slice
      FROM ev_raw)
SELECT event_id, home_id, activity_original, activity, activity_slice,
       CASE activity WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse'
                     WHEN 'purchase' THEN 'convert' WHEN 'signup' THEN 'convert'
                     ELSE activity END AS activity_general,
       activity AS activity_grouped
FROM x WHERE activity <> 'error'"""))
def q_label_clean_generalise(spark, sf_dir):
    ev = labelled_events(spark, sf_dir).select("event_id", "home_id", "activity")
    out = (ev.withColumns({"activity_original": F.col("activity"),
                           "activity_slice": L.strip_resident_prefix_slice("activity")})
             .transform(lambda d: L.clean_and_generalise(d, "activity", EVENTS_GENERAL_MAP,
                                                         EVENTS_CATCH_ALL, "activity_general")))
    # the 35-key grouping map has no events label: every value passes through
    out = out.withColumn("activity_grouped", L.map_labels("activity", L.grouped_activity_map()))
    return out.select("event_id", "home_id", "activity_original", "activity", "activity_slice",
                      "activity_general", "activity_grouped")


@query("label_index", with_(EV_CLEAN, r"""
c AS (SELECT activity AS label, count(*) AS n FROM ev_clean GROUP BY 1)
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index, n FROM c"""))
def q_label_index(spark, sf_dir):
    return profile.label_index_table(clean_events(spark, sf_dir), "activity", "label")


@query("label_counts", with_(EV_CLEAN, r"""
r AS (SELECT 'raw' AS label_space, activity AS label, count(*) AS n FROM ev_clean GROUP BY 2),
g AS (SELECT 'general' AS label_space, activity_general AS label, count(*) AS n FROM ev_clean GROUP BY 2)
SELECT * FROM r UNION ALL SELECT * FROM g"""))
def q_label_counts(spark, sf_dir):
    return profile.label_counts_both(clean_events(spark, sf_dir), "activity", "activity_general")


@query("label_grouping_sets", with_(EV_CLEAN, r"""
x AS (SELECT activity, activity_general FROM ev_clean)
SELECT activity, activity_general,
       CAST(GROUPING(activity, activity_general) AS INTEGER) AS grouping_id,
       count(*) AS n
FROM x GROUP BY GROUPING SETS ((activity), (activity_general), ())"""))
def q_label_grouping_sets(spark, sf_dir):
    return profile.label_grouping_sets(clean_events(spark, sf_dir), "activity", "activity_general")


@query("label_regex_filter", with_(EV_CLEAN, r"""
z AS (SELECT 1)
SELECT event_id, home_id, activity FROM ev_clean WHERE NOT regexp_matches(activity, 'ur|gn')"""))
def q_label_regex_filter(spark, sf_dir):
    """Drop labels matching a regex alternation (``ur|gn``: purchase, signup)."""
    ev = clean_events(spark, sf_dir).select("event_id", "home_id", "activity")
    return L.filter_labels_regex(ev, "activity", "ur|gn", keep=False)


@query("null_baselines", with_(EV_CLEAN, LOGO_CTES) + r""",
own AS (SELECT home_id, max(n) AS own_top FROM gl GROUP BY home_id),
k AS (SELECT count(DISTINCT label) AS k FROM gl)
SELECT logo.home_id, logo.n_rows, logo.accuracy AS logo_majority_accuracy,
       round(own.own_top / logo.n_rows, 6) AS in_group_majority_accuracy,
       round(1.0 / k.k, 6) AS uniform_accuracy
FROM logo JOIN own USING (home_id), k""")
def q_null_baselines(spark, sf_dir):
    """Null-model baselines per group: held-out majority, in-group majority, 1/k."""
    return baseline.null_baselines(clean_events(spark, sf_dir), "home_id", "activity_general")
