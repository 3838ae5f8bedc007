"""Null-model baselines evaluated leave-one-group-out.

For each group the prediction is the majority label of *all other* groups
(ties broken by label name).  Every step runs over aggregated tables:

* ``(group, label) -> n`` is a partial + final hash aggregate of the data;
* label totals come from that aggregate (one row per label);
* the held-out majority is ``argmax_l (total_l - own_l)``.  Labels absent from
  the group score ``total_l``, so the best of them is the first label of the
  global ranking that the group lacks; labels present in the group are scored
  directly.  No groups x labels product is ever built.

Per-group metrics follow from the confusion table of a constant predictor:
one predicted label ``p`` with ``c`` correct rows out of ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import null_safe_join


def group_label_counts(df: DataFrame, group_col: str, label_col: str) -> DataFrame:
    return df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def logo_majority_predictions(gl: DataFrame, group_col: str, label_col: str) -> DataFrame:
    """(group, predicted, pred_score) from a (group, label, n) table."""
    totals = gl.groupBy(label_col).agg(F.sum("n").alias("total"))
    # global label ranking: one row per label (the class vocabulary)
    ranked = totals.withColumn("lrank", F.row_number().over(
        Window.orderBy(F.col("total").desc(), F.col(label_col).asc())))

    present = null_safe_join(gl, ranked, label_col)
    # (a) best label present in the group, scored on the other groups only
    best_present = present.groupBy(group_col).agg(
        F.min(F.struct((-(F.col("total") - F.col("n"))).alias("neg"), F.col(label_col).alias("lab"))).alias("bp"),
        F.count(F.lit(1)).alias("n_present"))
    # (b) first global rank the group does not contain: ranks 1..m all present
    #     iff the i-th smallest present rank equals i
    w = Window.partitionBy(group_col).orderBy("lrank")
    gaps = (present.select(group_col, "lrank")
                   .withColumn("i", F.row_number().over(w))
                   .groupBy(group_col)
                   .agg(F.min(F.when(F.col("lrank") != F.col("i"), F.col("i"))).alias("gap"),
                        F.max("i").alias("m")))
    first_absent = gaps.select(group_col, F.coalesce("gap", F.col("m") + 1).alias("lrank"))
    absent_best = first_absent.join(ranked.select("lrank", F.col(label_col).alias("abs_lab"),
                                                  F.col("total").alias("abs_score")), "lrank", "left")
    cand = null_safe_join(best_present, absent_best.drop("lrank"), group_col, "left")
    p_score = -F.col("bp.neg")
    take_absent = F.col("abs_lab").isNotNull() & (
        (F.col("abs_score") > p_score) | ((F.col("abs_score") == p_score) & (F.col("abs_lab") < F.col("bp.lab"))))
    return cand.select(
        group_col,
        F.when(take_absent, F.col("abs_lab")).otherwise(F.col("bp.lab")).alias("predicted"),
        F.when(take_absent, F.col("abs_score")).otherwise(p_score).alias("pred_score"),
        "n_present")


def logo_majority_eval(df: DataFrame, group_col: str, label_col: str, digits: int = 6,
                       materialise: bool = True) -> DataFrame:
    """Per held-out group: predicted majority label and accuracy / F1 / P / R.

    The (group, label) count table feeds six branches of the plan; it is
    written once to the shared checkpoint folder (it has groups x labels
    rows) so the source is scanned once, not once per branch."""
    gl = group_label_counts(df, group_col, label_col)
    if materialise:
        from foldwise.session import cut_lineage
        gl = cut_lineage(gl)
    preds = logo_majority_predictions(gl, group_col, label_col)
    sizes = gl.groupBy(group_col).agg(F.sum("n").alias("n_rows"))
    own = gl.select(group_col, F.col(label_col).alias("predicted"), F.col("n").alias("correct"))
    j = (null_safe_join(null_safe_join(preds, sizes, group_col), own, [group_col, "predicted"], "left")
              .withColumn("correct", F.coalesce("correct", F.lit(0))))
    c, n = F.col("correct").cast("double"), F.col("n_rows").cast("double")
    # labels in truth or prediction
    k = F.col("n_present") + F.when(F.col("correct") == 0, 1).otherwise(0)
    f1_p = 2 * c / (c + n)
    return j.select(
        group_col,
        F.col("n_rows").cast("bigint").alias("n_rows"),
        "predicted",
        F.round(c / n, digits).alias("accuracy"),
        F.round(f1_p / k, digits).alias("macro_f1"),
        F.round(c * f1_p / n, digits).alias("weighted_f1"),
        F.round((c / n) / k, digits).alias("macro_precision"),
        F.round(F.when(F.col("correct") > 0, 1.0).otherwise(0.0) / k, digits).alias("macro_recall"),
    )


def null_baselines(df: DataFrame, group_col: str, label_col: str, digits: int = 6) -> DataFrame:
    """Per group: accuracy of the held-out majority label (trained on the
    other groups), of the group's own majority label (in-sample), and the
    uniform-guess expectation 1/k over the k classes seen anywhere."""
    from foldwise.session import cut_lineage
    gl = cut_lineage(group_label_counts(df, group_col, label_col))
    preds = logo_majority_predictions(gl, group_col, label_col)
    per = gl.groupBy(group_col).agg(F.sum("n").alias("n_rows"), F.max("n").alias("own_top"))
    own = gl.select(group_col, F.col(label_col).alias("predicted"), F.col("n").alias("correct"))
    k = gl.select(label_col).distinct().agg(F.count(F.lit(1))).scalar()
    j = (null_safe_join(null_safe_join(preds, per, group_col), own, [group_col, "predicted"], "left")
              .withColumn("correct", F.coalesce("correct", F.lit(0))))
    n = F.col("n_rows").cast("double")
    return j.select(group_col, F.col("n_rows").cast("bigint").alias("n_rows"),
                    F.round(F.col("correct") / n, digits).alias("logo_majority_accuracy"),
                    F.round(F.col("own_top") / n, digits).alias("in_group_majority_accuracy"),
                    F.round(F.lit(1.0) / k, digits).alias("uniform_accuracy"))
