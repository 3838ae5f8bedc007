"""Full label maps, splits as frames, and what sources and sinks write and read back.

Everything is derived from ``events`` and written to the shared folder, so
each query has plain SQL over the given table as its counterpart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions import features as FE
from foldwise.functions import labels as L
from foldwise.operators import metrics as M
from foldwise.operators import registry as R
from foldwise.operators import splits
from foldwise.plans.catalog import query
from foldwise.plans.q_labels import clean_events
from foldwise.plans.q_metrics import _PRED_SQL, EVENT_CLASSES, rule_predictions
from foldwise.plans.sqlparts import EV_CLEAN, with_
from foldwise.sources import files, sinks
from foldwise.session import ensure_checkpoint_dir, read_table

N_HOMES = 5


def shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _labelled(spark, sf_dir, names: list[str]):
    """events with a raw label taken in turn from ``names``, every third with a resident prefix."""
    arr = F.array(*[F.lit(n) for n in names])
    raw = F.get(arr, (F.col("event_id") % len(names)).cast("int"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r1."), raw)).otherwise(raw).alias("activity"))


def _names_sql(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _map_sql(mapping: dict[str, str], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items())) + f" ELSE {col} END"


GENERAL_NAMES = [*sorted(L.GENERAL_ACTIVITY_MAP), L.CATCH_ALL_LABEL, "Not_In_The_Map"]
GROUPED_NAMES = [*sorted(L.grouped_activity_map()), "Not_In_The_Map"]


@query("label_map_general", f"""
WITH r AS (SELECT event_id, {_names_sql(GENERAL_NAMES)}[CAST(event_id % {len(GENERAL_NAMES)} AS INTEGER) + 1] AS a FROM events)
SELECT event_id, a AS activity, {_map_sql(L.GENERAL_ACTIVITY_MAP, 'a')} AS activity_general FROM r WHERE a <> '{L.CATCH_ALL_LABEL}'""")
def q_label_map_general(spark, sf_dir):
    """Prefix cleanup, catch-all drop and the full general map; every key occurs."""
    return L.clean_and_generalise(_labelled(spark, sf_dir, GENERAL_NAMES))


@query("label_map_grouped", f"""
WITH r AS (SELECT event_id, {_names_sql(GROUPED_NAMES)}[CAST(event_id % {len(GROUPED_NAMES)} AS INTEGER) + 1] AS a FROM events)
SELECT event_id, a AS activity_original, {_map_sql(L.grouped_activity_map(), 'a')} AS activity_grouped FROM r""")
def q_label_map_grouped(spark, sf_dir):
    """The full grouping map on clean labels; unmapped labels pass through."""
    df = _labelled(spark, sf_dir, GROUPED_NAMES).withColumn("activity", L.strip_resident_prefix("activity"))
    return L.apply_activity_grouping(df).select("event_id", "activity_original", "activity_grouped")


@query("fold_frames", with_(EV_CLEAN, f"""
f AS (SELECT activity, home_id % {N_HOMES} AS fold FROM ev_clean)
SELECT 'train' AS part, activity, count(*) AS n FROM f WHERE fold <> 2 GROUP BY 2
UNION ALL SELECT 'validation', activity, count(*) FROM f WHERE fold = 2 GROUP BY 2
UNION ALL SELECT 'held_out', activity, count(*) FROM f WHERE fold = 1 GROUP BY 2"""))
def q_fold_frames(spark, sf_dir):
    """Train and validation frames of a fold, and one group held out."""
    ev = clean_events(spark, sf_dir).withColumn("fold", F.col("home_id") % N_HOMES)
    train, val = splits.fold_frames(ev, 2)
    _, held = splits.holdout_group(ev, "fold", 1)
    parts = [x.groupBy("activity").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(p))
             for p, x in (("train", train), ("validation", val), ("held_out", held))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "activity", "n")


@query("feature_selection", with_(EV_CLEAN, r"""
z AS (SELECT 1)
SELECT event_id, value, hour(ts) AS hour FROM ev_clean"""))
def q_feature_selection(spark, sf_dir):
    """Constant columns dropped, then the numeric columns less the excluded ones."""
    ev = clean_events(spark, sf_dir).withColumns({"zero": F.lit(0), "one": F.lit(1.0), "hour": F.hour("ts").cast("bigint")})
    kept = FE.drop_constant_features(ev, ["zero", "one"])
    return kept.select(*FE.numeric_feature_columns(kept, exclude=["home_id", "dow"]))


def _homes(spark, sf_dir):
    return clean_events(spark, sf_dir).select(
        "event_id", "value", "activity", F.concat(F.lit("h"), F.col("home_id") % N_HOMES).alias("home_id"))


@query("csv_round_trip", with_(EV_CLEAN, f"""
h AS (SELECT event_id, value, activity, 'h' || (home_id % {N_HOMES}) AS home_id FROM ev_clean)
SELECT * FROM h"""))
def q_csv_round_trip(spark, sf_dir):
    """Feature files per group, half of them with the columns in another order, read back by name."""
    folder, ev = shared(spark, "csv"), _homes(spark, sf_dir)
    for part, cols in ((0, ["event_id", "value", "activity"]), (1, ["activity", "value", "event_id"])):
        ev.where(F.pmod(F.xxhash64("home_id"), F.lit(2)) == part).select("home_id", *cols).write.option("header", True) \
          .partitionBy("home_id").mode("append").csv(folder)
    paths = [r["path"] for r in files.list_group_files(spark, folder, ".csv").collect()]    # one row per file
    back = files.read_group_csvs(spark, paths, types={"event_id": T.LongType(), "value": T.DoubleType(), "activity": T.StringType()})
    return back.withColumn("home_id", F.substring_index("home_id", "=", -1))


@query("processed_round_trip", with_(EV_CLEAN, f"""
h AS (SELECT event_id, value, activity, 'h' || (home_id % {N_HOMES}) AS home_id FROM ev_clean)
SELECT * FROM h WHERE home_id IN ('h1', 'h3')"""))
def q_processed_round_trip(spark, sf_dir):
    """Processed table written by group and read back with pruned groups."""
    path = files.save_processed(_homes(spark, sf_dir), shared(spark, "processed"))
    return files.load_processed(spark, path).where(F.col("home_id").isin("h1", "h3"))


@query("confusion_sink", with_(EV_CLEAN, _PRED_SQL, r"""
c AS (SELECT y_true AS actual, y_pred AS predicted, count(*) AS n FROM pr GROUP BY ALL)
SELECT actual, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE predicted = '{k}'), 0) AS BIGINT) AS pred_{k}"
                               for k in EVENT_CLASSES) + " FROM c GROUP BY actual"))
def q_confusion_sink(spark, sf_dir):
    """Confusion matrices written per group; the aggregate file read back."""
    path = shared(spark, "confusion")
    conf = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred", ["home_id"])
    sinks.write_confusion_matrices(conf, EVENT_CLASSES, path)
    schema = "actual string, " + ", ".join(f"pred_{k} bigint" for k in EVENT_CLASSES)
    return spark.read.schema(schema).option("header", True).csv(f"{path}/aggregate")


@query("prediction_sink", with_(EV_CLEAN, _PRED_SQL, f"""
z AS (SELECT 1)
SELECT event_id, y_true, y_pred, y_true = y_pred AS correct, home_id % {N_HOMES} AS home_id FROM pr"""))
def q_prediction_sink(spark, sf_dir):
    """Predictions written by group and read back."""
    path = shared(spark, "predictions")
    pred = rule_predictions(spark, sf_dir).withColumn("home_id", F.col("home_id") % N_HOMES)
    sinks.write_predictions(pred.withColumn("correct", F.col("y_true") == F.col("y_pred")), path)
    return spark.read.parquet(path).withColumn("home_id", F.col("home_id").cast("bigint"))


def _run_records(spark, sf_dir):
    """One run record per user and one checkpoint per second user, from their events."""
    ev = clean_events(spark, sf_dir)
    per = ev.groupBy("home_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"), F.countDistinct("activity").alias("k"))
    stamp = F.concat(F.lit("202601"), F.lpad((F.col("home_id") % 28 + 1).cast("string"), 2, "0"), F.lit("_"),
                     F.lpad((F.col("home_id") % 24).cast("string"), 2, "0"), F.lit("3015"))
    runs = per.select(
        stamp.alias("timestamp"), F.when(F.col("home_id") % 2 == 0, "native").otherwise("sklearn").alias("api"),
        F.lit("custom").alias("target_column"), ((F.col("home_id") % 5 + 1) / 10).alias("sample_fraction"),
        F.round(F.col("m") % 1000 / 1000, 3).alias("metric_primary_cv"),
        F.struct(F.round(F.col("n") % 100 / 100, 2).alias("train_f1_macro")).alias("train_metrics"),
        F.array_repeat(F.lit("c"), F.col("k").cast("int")).alias("classes"),
        F.struct(F.concat(F.lit("runs/ck_"), "home_id", F.lit(".json")).alias("checkpoint_path")).alias("details"),
        F.col("home_id").cast("string").alias("metric_rationale"))
    checks = per.where("home_id % 2 = 0").select(F.concat(F.lit("ck_"), "home_id", F.lit(".json")).alias("file"),
                                                 (F.col("home_id") % 7 + 2).alias("n_folds"))
    return runs, checks


@query("run_registry", with_(EV_CLEAN, r"""
p AS (SELECT home_id, count(*) AS n, max(event_id) AS m, count(DISTINCT activity) AS k FROM ev_clean GROUP BY 1)
SELECT CAST(home_id AS VARCHAR) AS run, CASE WHEN home_id % 2 = 0 THEN 'XGBoost native' ELSE 'XGBoost sklearn' END AS model,
       'custom (' || k || ' classes)' AS target_label, strptime('202601' || lpad(CAST(home_id % 28 + 1 AS VARCHAR), 2, '0') || '_'
         || lpad(CAST(home_id % 24 AS VARCHAR), 2, '0') || '3015', '%Y%m%d_%H%M%S') AS ts,
       printf('%.4f', round(m % 1000 / 1000.0, 3)) AS cv_macro_f1, '0.' || (home_id % 5 + 1) AS sample_fraction,
       printf('%.4f', round(n % 100 / 100.0, 2)) AS train_macro_f1,
       CASE WHEN home_id % 2 = 0 THEN home_id % 7 + 2 END AS cv_folds FROM p"""))
def q_run_registry(spark, sf_dir):
    """Run records written as JSON lines, read into the runs table with their checkpoint and formatted."""
    from foldwise.functions import formatting as FM
    runs, checks = _run_records(spark, sf_dir)
    path = shared(spark, "runs")
    R.append_run(runs, path)
    records = spark.read.schema(R.RUN_RECORD_SCHEMA).json(path).withColumn("source_file", F.col("metric_rationale"))
    table = R.runs_table(records, checks.withColumnRenamed("file", "checkpoint_file"))
    return table.select(
        F.col("source_file").alias("run"), FM.pretty_api("api").alias("model"),
        FM.pretty_target("target", "n_classes").alias("target_label"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        FM.fmt_float("cv_primary").alias("cv_macro_f1"), FM.fmt_fraction("sample_fraction").alias("sample_fraction"),
        FM.fmt_float("train_f1_macro").alias("train_macro_f1"), "cv_folds")
