"""Run registry: run records, checkpoints, folds, importance, leaderboard.

Runs, trials and folds are rows in tables (JSON or Parquet) instead of loose
files; every report is a DataFrame query over them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType)

from foldwise.functions import formatting as FM

MAX_TABLE_ROWS = 5      # Fixed value: rows of the report's leaderboard
# Where a 32-bit uniform number reaches the next value of a Poisson(1) variable.
POISSON_STEPS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2 ** 32) for k in range(9)]

PARAMS = MapType(StringType(), StringType())
# Fields of the reference's run records and checkpoints.
RUN_RECORD_SCHEMA = StructType([
    StructField("timestamp", StringType()),
    StructField("api", StringType()),
    StructField("target_column", StringType()),
    StructField("sample_fraction", DoubleType()),
    StructField("train_threads", LongType()),
    StructField("metric_primary", StringType()),
    StructField("metric_primary_cv", DoubleType()),
    StructField("train_metrics", StructType([StructField("train_f1_macro", DoubleType()),
                                             StructField("train_f1_weighted", DoubleType()),
                                             StructField("train_accuracy", DoubleType())])),
    StructField("feature_count", LongType()),
    StructField("features", ArrayType(StringType())),
    StructField("classes", ArrayType(StringType())),
    StructField("details", StructType([
        StructField("best_params", PARAMS),
        StructField("best_cv_f1_macro", DoubleType()),
        StructField("best_num_boost_round", LongType()),
        StructField("requested_num_boost_round", LongType()),
        StructField("early_stopping_rounds", LongType()),
        StructField("learning_rate_override", DoubleType()),
        StructField("final_num_boost_round", LongType()),
        StructField("force_final_rounds", BooleanType()),
        StructField("checkpoint_path", StringType()),
        StructField("cv_scheme", StringType()),
        StructField("n_folds", LongType()),
        StructField("trial_scores", ArrayType(StructType([
            StructField("trial", LongType()), StructField("cv_macro_f1_mean", DoubleType()),
            StructField("params", PARAMS)]))),
    ])),
    StructField("metric_rationale", StringType()),
])

CHECKPOINT_SCHEMA = StructType([
    StructField("api", StringType()),
    StructField("n_folds", LongType()),
    StructField("num_boost_round", LongType()),
    StructField("early_stopping_rounds", LongType()),
    StructField("learning_rate_override", DoubleType()),
    StructField("force_final_rounds", BooleanType()),
    StructField("trials_completed", LongType()),
    StructField("trial_history", ArrayType(StructType([
        StructField("trial", LongType()), StructField("macro_f1", DoubleType()),
        StructField("best_rounds", LongType()), StructField("params", PARAMS)]))),
    StructField("best_so_far", StructType([
        StructField("trial", LongType()), StructField("macro_f1", DoubleType()),
        StructField("best_rounds", LongType()), StructField("params", PARAMS)])),
])


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One multi-line JSON document per file; unreadable files are skipped,
    bare ``NaN`` parses, missing keys are NULL.  Adds ``source_file``."""
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
          .option("allowNonNumericNumbers", True).json(path))
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "source_path": F.col("_metadata.file_path")})


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path, RUN_RECORD_SCHEMA)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint files, with their name and whole path."""
    return read_json_records(spark, path, CHECKPOINT_SCHEMA).withColumns(
        {"checkpoint_file": F.col("source_file"), "checkpoint_source": F.url_decode(F.replace("source_path", F.lit("+"), F.lit("%2B")))})


def trials_table(checkpoints: DataFrame) -> DataFrame:
    """One row per finished trial of every checkpoint."""
    return checkpoints.select("checkpoint_file", F.inline("trial_history"))


def runs_table(records: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Flatten run records; fold count falls back to the run's checkpoint (looked up by
    path, only when the run does not record it): one row a run."""
    runs = records.select(
        "source_file", "timestamp", FM.parse_run_timestamp("timestamp").alias("ts"), "api",
        F.col("target_column").alias("target"), "sample_fraction", F.col("train_threads").alias("threads"),
        F.col("details.cv_scheme").alias("cv_scheme"), F.col("details.n_folds").alias("n_folds_run"),
        F.col("details.checkpoint_path").alias("checkpoint_path"),
        F.col("metric_primary_cv").alias("cv_primary"),
        F.col("train_metrics.train_f1_macro").alias("train_f1_macro"),
        F.col("train_metrics.train_accuracy").alias("train_accuracy"),
        F.when(F.col("classes").isNull(), F.lit(0)).otherwise(F.size("classes")).cast("bigint").alias("n_classes"),
        FM.expected_class_count("target_column").cast("bigint").alias("expected_n_classes"),
        F.col("details.best_params").alias("best_params"),
        FM.first_present(F.col("details.final_num_boost_round"), F.col("details.best_num_boost_round"))
          .alias("rounds"),
        F.col("details.early_stopping_rounds").alias("early_stopping_rounds"))
    if checkpoints is None:
        return runs.withColumn("cv_folds", F.col("n_folds_run")).drop("n_folds_run")
    folds = checkpoint_folds(runs.select("checkpoint_path"), checkpoints)
    j = runs.join(folds.withColumnRenamed("checkpoint_path", "__ck"), F.col("checkpoint_path") == F.col("__ck"), "left")
    return j.withColumn("cv_folds", F.coalesce("n_folds_run", "__ck_folds")).drop("__ck", "__ck_folds", "n_folds_run")


def path_ends(path: Column) -> Column:
    """All ends of a path, shortest (the file name) first, without store, empty and ``.`` segments."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    parts = F.filter(F.split(bare, r"[/\\]+"), lambda x: (x != "") & (x != "."))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                 lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "/")))


def checkpoint_folds(paths: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(checkpoint_path, __ck_folds): fold count of the checkpoint that each recorded path names.  A path names the
    checkpoint that shares its longest end, if only one does; files of one name in several folders are told apart."""
    source = "checkpoint_source" if "checkpoint_source" in checkpoints.columns else "checkpoint_file"
    ends = checkpoints.select(F.col(source).alias("__source"), "n_folds", F.explode(path_ends(F.col(source))).alias("__end"))
    ends = ends.groupBy("__end").agg(F.countDistinct("__source").alias("__files"), F.max("n_folds").alias("__ck_folds"))
    asked = paths.distinct().select("checkpoint_path", F.posexplode(path_ends(F.col("checkpoint_path"))).alias("__length", "__asked"))
    met = asked.join(ends, F.col("__asked") == F.col("__end"))
    best = met.groupBy("checkpoint_path").agg(F.max_by(F.struct("__files", "__ck_folds"), "__length").alias("b"))
    return best.filter("b.__files = 1").select("checkpoint_path", "b.__ck_folds")


def comparable_runs(runs: DataFrame, score: str = "cv_primary") -> DataFrame:
    """Finite score and, when the target's class count is known, all classes present."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    full = F.col("expected_n_classes").isNull() | (F.col("n_classes") == F.col("expected_n_classes"))
    return runs.filter(finite & full)


def leaderboard(runs: DataFrame, top: int = MAX_TABLE_ROWS, score: str = "cv_primary") -> DataFrame:
    """Comparable runs by score desc then recency desc; top ``top`` rows with
    display strings; rank 1 is the leader.  The sort runs over the run table."""
    ok = comparable_runs(runs, score)
    ts = F.coalesce(F.col("ts"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    order = [F.col(score).desc(), ts.desc(), F.col("source_file")]
    # top-k first (TakeOrderedAndProject), then rank the k survivors
    ranked = ok.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return (ranked.select(
        F.col("rank").cast("int").alias("rank"), "source_file", "timestamp",
        FM.pretty_api("api").alias("model"),
        FM.pretty_target("target", "n_classes").alias("target_label"),
        FM.fmt_fraction("sample_fraction").alias("sample_fraction"),
        FM.fmt_float(score).alias("cv_macro_f1"),
        FM.fmt_float("train_f1_macro").alias("train_macro_f1"),
        FM.fmt_float("train_accuracy").alias("train_accuracy"),
        (F.col("rank") == 1).alias("is_leader")))


def leader_block(runs: DataFrame, score: str = "cv_primary") -> DataFrame:
    """The leader's settings: rounds, early stopping, learning rate, depth,
    and the parameters that go by two names in the two APIs."""
    lb = leaderboard(runs, 1, score).select("source_file")
    r = runs.join(lb, "source_file", "inner")
    p = F.col("best_params")
    return r.select(
        FM.pretty_api("api").alias("model"), FM.pretty_target("target", "n_classes").alias("target_label"),
        FM.fmt_float(score).alias("cv_macro_f1"), FM.fmt_fraction("sample_fraction").alias("sample_fraction"),
        FM.fmt_float("train_f1_macro").alias("train_macro_f1"), FM.fmt_float("train_accuracy").alias("train_accuracy"),
        "rounds", "early_stopping_rounds", "cv_scheme", "cv_folds",
        FM.fmt_float(F.element_at(p, "learning_rate"), 3).alias("learning_rate"),
        F.element_at(p, "max_depth").alias("max_depth"),
        F.coalesce(F.element_at(p, "reg_alpha"), F.element_at(p, "alpha")).alias("reg_alpha"),
        F.coalesce(F.element_at(p, "reg_lambda"), F.element_at(p, "lambda")).alias("reg_lambda"))


def append_run(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append run / fold / trial rows to a table (Spark's commit protocol
    makes each append atomic)."""
    df.write.mode("append").format(fmt).save(path)


def unfinished(units: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units not yet recorded as finished (resume after a failure)."""
    return units.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def cv_summary(folds: DataFrame, acc: str = "accuracy", f1: str = "f1_macro", seconds: str | None = None,
               group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean / population std / min / max accuracy, mean F1, total time."""
    aggs = [F.count(F.lit(1)).alias("n_folds"),
            F.round(F.avg(acc), digits).alias("mean_accuracy"),
            F.round(F.stddev_pop(acc), digits).alias("std_accuracy"),
            F.round(F.min(acc), digits).alias("min_accuracy"),
            F.round(F.max(acc), digits).alias("max_accuracy"),
            F.round(F.avg(f1), digits).alias("mean_f1")]
    if seconds:
        aggs.append(F.round(F.sum(seconds), digits).alias("total_seconds"))
    return folds.groupBy(*group_cols).agg(*aggs)


def fold_interval(folds: DataFrame, score: str = "accuracy", z: float = 1.96, group_cols: Sequence[str] = (),
                  digits: int = 6) -> DataFrame:
    """Mean of a score over folds with its sample variance, standard error and normal
    interval (NULL with fewer than two folds)."""
    error = F.stddev_samp(score) / F.sqrt(F.count(score))
    agg = folds.groupBy(*group_cols).agg(
        F.count(score).alias("n_folds"), F.avg(score).alias("mean"), F.var_samp(score).alias("variance"),
        error.alias("std_error"), (F.avg(score) - z * error).alias("low"), (F.avg(score) + z * error).alias("high"))
    return agg.select(*group_cols, "n_folds", *[F.round(c, digits).alias(c) for c in ("mean", "variance", "std_error", "low", "high")])


def poisson_weight(seed: int, replicate: Column, group: Column) -> Column:
    """Poisson(1) weight of a group in a bootstrap replicate, from md5(seed|replicate|group): the same in every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), group.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return sum(((u >= F.lit(t)).cast("bigint") for t in POISSON_STEPS[1:]), (u >= F.lit(POISSON_STEPS[0])).cast("bigint"))


def bootstrap_sums(per_group: DataFrame, score: str, group_col: str, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, weight, weighted): sums over the groups of their Poisson weights and weighted scores; one pass."""
    rows = per_group.filter(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("__s"), F.col(group_col).alias("__g"),
        F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    rows = rows.withColumn("__w", poisson_weight(seed, F.col("replicate"), F.coalesce(F.col("__g").cast("string"), F.lit(""))))
    return rows.groupBy("replicate").agg(F.sum("__w").alias("weight"), F.sum(F.col("__w") * F.col("__s")).alias("weighted"))


def bootstrap_interval(per_group: DataFrame, score: str, group_col: str, n_boot: int = 200, seed: int = 42, level: float = 0.95,
                       digits: int = 6) -> DataFrame:
    """Percentile interval of a mean over groups: (n_boot, mean, low, high), over replicates with any weight."""
    means = bootstrap_sums(per_group, score, group_col, n_boot, seed).filter("weight > 0").select((F.col("weighted") / F.col("weight")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.count("m").alias("n_boot"), F.round(F.avg("m"), digits).alias("mean"),
                     F.round(F.percentile("m", tail), digits).alias("low"), F.round(F.percentile("m", 1 - tail), digits).alias("high"))


def importance_summary(imp: DataFrame, feature: str = "feature", value: str = "importance",
                       top: int | None = None, digits: int = 6) -> DataFrame:
    """Per feature mean / population std / min / max over folds, sorted by mean."""
    s = imp.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.min(value).alias("min"), F.max(value).alias("max"),
                                 F.count(F.lit(1)).alias("n_folds"))
    if top is not None:
        s = s.orderBy(F.col("mean").desc(), F.col(feature)).limit(top)
    return s.select(feature, *[F.round(c, digits).alias(c) for c in ["mean", "std", "min", "max"]], "n_folds")


def hardest_easiest(per_group: DataFrame, group_col: str, score: str = "accuracy", k: int = 5) -> DataFrame:
    """The k lowest and k highest scoring groups (kind, rank, group, score)."""
    hard = per_group.orderBy(F.col(score).asc(), F.col(group_col)).limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).asc(), F.col(group_col))))
    easy = per_group.orderBy(F.col(score).desc(), F.col(group_col)).limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(group_col))))
    return (hard.select(F.lit("hardest").alias("kind"), F.col("rank").cast("int").alias("rank"), group_col, score)
                .unionByName(easy.select(F.lit("easiest").alias("kind"), F.col("rank").cast("int").alias("rank"),
                                         group_col, score)))


def per_group_table(folds: DataFrame, group_col: str, score: str = "accuracy") -> DataFrame:
    """Per-group results sorted by score, best first (RPT-3)."""
    return folds.orderBy(F.col(score).desc(), F.col(group_col))


def make_run_record(spark: SparkSession, **fields) -> DataFrame:
    """One run-record row in the registry schema (missing fields are NULL)."""
    names = [f.name for f in RUN_RECORD_SCHEMA.fields]
    unknown = set(fields) - set(names)
    if unknown:
        raise ValueError(f"unknown run-record fields: {sorted(unknown)}")
    return spark.createDataFrame([tuple(fields.get(n) for n in names)], RUN_RECORD_SCHEMA)


def list_models(runs: DataFrame, model_dir_col: str = "source_file") -> DataFrame:
    """Saved models = rows of the runs table, newest first."""
    return runs.select(model_dir_col, "timestamp", "api", "target", "cv_primary").orderBy(F.col("timestamp").desc())


def cv_simple_view(folds: DataFrame, group_col: str = "home_id") -> DataFrame:
    """Simple CV view: per group accuracy / n_train / n_test / n_classes, plus an
    ``overall`` row (mean, population std, min and max of accuracy, number of groups)."""
    per = folds.select(F.col(group_col).cast("string").alias("group"), "accuracy", "n_train", "n_test", "n_classes")
    overall = folds.agg(F.lit("overall").alias("group"), F.avg("accuracy").alias("accuracy"),
                        F.stddev_pop("accuracy").alias("std_accuracy"), F.min("accuracy").alias("min_accuracy"),
                        F.max("accuracy").alias("max_accuracy"), F.count(F.lit(1)).alias("n_homes"))
    return per.unionByName(overall, allowMissingColumns=True)
