"""Result sinks: confusion matrices, predictions, importances, CV summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.metrics import confusion_wide, sum_confusions
from foldwise.operators.registry import importance_summary


def write_confusion_matrices(conf_long: DataFrame, classes: Sequence[str], path: str,
                             group_col: str = "home_id", per_group_files: bool = False) -> None:
    """The matrices of all groups (``<group>, actual, pred_<class>...``, full class list) under
    ``<path>/per_group``, and the aggregate over groups under ``<path>/aggregate``.

    The groups lie in a few files in order of group; ``per_group_files`` writes a folder for each instead."""
    per = confusion_wide(conf_long, classes, [group_col])
    if per_group_files:
        per.write.mode("overwrite").option("header", True).partitionBy(group_col).csv(f"{path}/per_group")
    else:
        per.repartitionByRange(group_col).sortWithinPartitions(group_col, "actual") \
           .write.mode("overwrite").option("header", True).csv(f"{path}/per_group")
    agg = confusion_wide(sum_confusions(conf_long.drop(group_col)), classes)
    agg.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/aggregate")


def write_predictions(pred: DataFrame, path: str, group_col: str = "home_id") -> None:
    """``y_true, y_pred, correct, prob_<class>...`` as Parquet partitioned by group."""
    pred.write.mode("overwrite").partitionBy(group_col).parquet(path)


def write_importance(imp: DataFrame, path: str, top: int = 20) -> None:
    """Full per-feature statistics and the top-``top`` list as JSON."""
    importance_summary(imp).write.mode("overwrite").json(f"{path}/all")
    importance_summary(imp, top=top).coalesce(1).write.mode("overwrite").json(f"{path}/top")


def write_cv_results(folds: DataFrame, summary: DataFrame, path: str, config: dict[str, Any] | None = None,
                     classes: Sequence[str] | None = None, features: Sequence[str] | None = None) -> None:
    """Per-fold rows, the overall summary and, where given, the config (one object), the
    classes and the features (one row each, in order), JSON lines."""
    spark = folds.sparkSession
    folds.write.mode("overwrite").json(f"{path}/folds")
    if features is not None:
        summary = summary.withColumn("n_features", F.lit(len(features)))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    if config is not None:
        spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    for name, column, values in (("classes", "class", classes), ("features", "feature", features)):
        if values is not None:
            rows = spark.createDataFrame(list(enumerate(values)), f"position int, {column} string")
            rows.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def prediction_table(scored: DataFrame, classes: Sequence[str], prob: F.Column, truth: str,
                     pred: str, keep: Sequence[str] = ()) -> DataFrame:
    return scored.select(*keep, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred"),
                         (F.col(truth) == F.col(pred)).alias("correct"),
                         *[F.element_at(prob, i + 1).alias(f"prob_{c}") for i, c in enumerate(classes)])
