"""Skew check: does any single task receive a hot group?

Builds a skewed copy of ``events`` (rows replicated 10x, one user given a
third of all rows), runs the skew-sensitive operators and a plain
single-window baseline, and reads Spark's event log (written to a scratch
folder) to report, per operator, the largest number of shuffle records read
by one task against the number of input rows.

usage: python tools/skew_check.py [--sf-dir DIR] [--copies N]
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=10)
    args = ap.parse_args()

    scratch = tempfile.mkdtemp(prefix="foldwise-skew-", dir=os.environ.get("TMPDIR", "/tmp"))
    logdir = f"{scratch}/eventlog"
    os.makedirs(logdir)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from foldwise.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=32, extra={"spark.eventLog.enabled": "true",
                                                         "spark.eventLog.dir": f"file://{logdir}",
                                                         "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                                         # a local shuffle read hands one task a whole map
                                                         # output (an input split), which would mask the
                                                         # key distribution this check measures
                                                         "spark.sql.adaptive.localShuffleReader.enabled": "false"})
    ev = spark.read.parquet(f"{args.sf_dir}/events.parquet")
    rep = ev.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(args.copies - 1))))
    rep = rep.select((F.col("event_id") * args.copies + F.col("c")).alias("event_id"),
                     (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, c)")).alias("ts"),
                     F.when(F.abs(F.hash("event_id", "c")) % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
                      .alias("user_id"), "event_type", "value")
    from foldwise.session import ensure_checkpoint_dir
    data_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/skewed"   # the shared folder, not a local one
    rep.repartition(32).write.parquet(data_dir)   # many small input splits
    df = spark.read.parquet(data_dir)
    n = df.count()
    hot = df.filter("user_id = 0").count()

    from foldwise.operators.sampling import exact_group_sample
    from foldwise.operators.splits import stratified_folds
    from foldwise.operators.windows import event_window_features
    from foldwise.plans.views import EVENT_TYPES

    from foldwise.operators import history, splits
    from foldwise.operators.baseline import logo_majority_eval
    from foldwise.operators.metrics import roc_auc
    from foldwise.operators.ranking import exact_sequence

    def hist():
        h = exact_sequence(df, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_format("ts", "yyyyMMddHHmm"),
                           "round")
        return history.early_stop_round(h.select(F.col("user_id").alias("trial"), "round",
                                                 F.col("value").alias("score")), 5)

    jobs = {
        "exact_group_sample": lambda: exact_group_sample(df, "user_id", "event_id", 0.05),
        "assign_folds": lambda: splits.assign_folds(df, splits.snake_group_kfold(df, "user_id", 5), "user_id"),
        "logo_majority_eval": lambda: logo_majority_eval(df, "user_id", "event_type"),
        "roc_auc": lambda: roc_auc(df.withColumn("y", (F.col("event_type") == "click").cast("int")), "y", "value"),
        "sequence_and_early_stop": hist,
        "stratified_folds": lambda: stratified_folds(df, "event_type", "event_id", 5),
        "event_window_features": lambda: event_window_features(df, "user_id", "ts", "event_id", "event_type",
                                                               EVENT_TYPES, chunk_rows=4096),
        "event_window_features_hot_minute": lambda: event_window_features(     # all rows of one group within four seconds
            df.withColumns({"user_id": F.lit(0), "ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 4)}),
            "user_id", "ts", "event_id", "event_type", EVENT_TYPES, chunk_rows=10_000),
        "baseline_plain_group_window": lambda: df.withColumn(
            "rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))),
    }
    for name, make in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        make().write.format("noop").mode("overwrite").save()
    spark.stop()

    # largest shuffle read of one task, per job group
    job_group: dict[int, str] = {}
    stage_group: dict[int, str] = {}
    worst: dict[str, int] = {}
    for path in sorted(glob.glob(f"{logdir}/**/*", recursive=True)):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        if path.endswith(".zstd"):
            import zstandard
            opener = lambda p: __import__("io").TextIOWrapper(
                zstandard.ZstdDecompressor().stream_reader(open(p, "rb")), encoding="utf-8")
        else:
            opener = open
        with opener(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    if g:
                        job_group[e["Job ID"]] = g
                        for s in e.get("Stage IDs", []):
                            stage_group[s] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(e.get("Stage ID"))
                    m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    r = m.get("Total Records Read", 0)
                    if g:
                        worst[g] = max(worst.get(g, 0), r)
    out = {"rows": n, "hot_group_rows": hot,
           "max_shuffle_records_one_task": worst,
           "max_share_of_rows": {k: round(v / n, 4) for k, v in worst.items()},
           "scratch": scratch}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
