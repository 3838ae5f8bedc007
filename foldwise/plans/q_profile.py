"""Profiling queries: class balance, rarity, coverage, coherence, describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import profile
from foldwise.plans.catalog import query
from foldwise.plans.q_labels import clean_events
from foldwise.plans.sqlparts import EV_CLEAN, with_
from foldwise.session import read_table

_COUNTS_SQL = r"""
cnt AS (
  SELECT 'raw' AS label_space, activity AS label, count(*) AS n FROM ev_clean GROUP BY 2
  UNION ALL
  SELECT 'general', activity_general, count(*) FROM ev_clean GROUP BY 2
  UNION ALL
  SELECT 'supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2)"""


def _space_counts(spark, sf_dir):
    ev = clean_events(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem")
    sup = profile.label_counts(li.withColumn("l_suppkey", F.col("l_suppkey").cast("string")), "l_suppkey")
    return (profile.label_counts_both(ev, "activity", "activity_general")
                   .unionByName(sup.select(F.lit("supplier").alias("label_space"), "label", "n")))


@query("class_balance_summary", with_(EV_CLEAN, _COUNTS_SQL, r"""
s AS (SELECT 1)
SELECT label_space, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS total, CAST(min(n) AS BIGINT) AS min_n,
       round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS median,
       round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS max_n, round(max(n) / min(n), 6) AS max_min_ratio
FROM cnt GROUP BY label_space"""))
def q_class_balance_summary(spark, sf_dir):
    return profile.summarize_counts(_space_counts(spark, sf_dir), ["label_space"])


@query("rarity_table", with_(EV_CLEAN, _COUNTS_SQL, r"""
t AS (SELECT * FROM (VALUES (100), (500), (1000), (5000)) v(threshold))
SELECT c.label_space, CAST(t.threshold AS INTEGER) AS threshold, count(*) FILTER (WHERE c.n < t.threshold) AS n_below
FROM cnt c, t GROUP BY c.label_space, t.threshold"""))
def q_rarity_table(spark, sf_dir):
    return profile.rarity_table(_space_counts(spark, sf_dir), ["label_space"])


@query("labels_below_threshold", with_(EV_CLEAN, _COUNTS_SQL, r"""
s AS (SELECT 1)
SELECT label_space, label, n FROM cnt WHERE n < 600"""))
def q_labels_below_threshold(spark, sf_dir):
    return profile.labels_below(_space_counts(spark, sf_dir), 600)


@query("label_group_coverage", r"""
SELECT l_returnflag || l_linestatus AS label, count(DISTINCT l_suppkey) AS n_groups, count(*) AS n_rows
FROM lineitem GROUP BY 1""")
def q_label_group_coverage(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("label"), "l_suppkey")
    return profile.label_group_coverage(li, "label", "l_suppkey")


@query("label_home_coverage", with_(EV_CLEAN, r"""
s AS (SELECT 1)
SELECT activity AS label, count(DISTINCT home_id) AS n_groups, count(*) AS n_rows FROM ev_clean GROUP BY 1"""))
def q_label_home_coverage(spark, sf_dir):
    return profile.label_group_coverage(clean_events(spark, sf_dir), "activity", "home_id")


@query("bucket_coherence", r"""
WITH pc AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2),
top AS (SELECT p_type, p_brand AS top_child FROM (
          SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rn FROM pc) WHERE rn = 1)
SELECT pc.p_type, count(*) AS n_children, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS top_n,
       any_value(top.top_child) AS top_child, round(max(n) / sum(n), 6) AS top_share
FROM pc JOIN top USING (p_type) GROUP BY pc.p_type""")
def q_bucket_coherence(spark, sf_dir):
    return profile.bucket_coherence(read_table(spark, sf_dir, "part"), "p_type", "p_brand")


@query("label_bucket_coherence", with_(EV_CLEAN, r"""
pc AS (SELECT activity_general, activity, count(*) AS n FROM ev_clean GROUP BY 1, 2),
top AS (SELECT activity_general, activity AS top_child FROM (
          SELECT *, row_number() OVER (PARTITION BY activity_general ORDER BY n DESC, activity) AS rn FROM pc)
        WHERE rn = 1)
SELECT pc.activity_general, count(*) AS n_children, CAST(sum(n) AS BIGINT) AS total,
       CAST(max(n) AS BIGINT) AS top_n, any_value(top.top_child) AS top_child, round(max(n) / sum(n), 6) AS top_share
FROM pc JOIN top USING (activity_general) GROUP BY pc.activity_general"""))
def q_label_bucket_coherence(spark, sf_dir):
    return profile.bucket_coherence(clean_events(spark, sf_dir), "activity_general", "activity")


_DESCRIBE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, CAST(count(*) - count({x}) AS BIGINT) AS null_count, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(max({x}), 6) AS max, round(quantile_cont({x}, 0.25), 6) AS q25, "
            f"round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.75), 6) AS q75 FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql("lineitem", _DESCRIBE_COLS))
def q_describe_numeric(spark, sf_dir):
    return profile.describe_numeric(read_table(spark, sf_dir, "lineitem"), _DESCRIBE_COLS)
