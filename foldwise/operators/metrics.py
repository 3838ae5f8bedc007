"""Exact classification metrics as aggregations.

Every metric starts from the long confusion table ``(group..., actual,
predicted, n)``: a partial + final hash aggregate whose size is bounded by
groups x classes^2, whatever the number of scored rows.  Per-class counts,
F1 variants, precision and recall are then small aggregates of that table.
Ranking metrics (ROC / PR area) aggregate per distinct score and use the
bucketed running sums of :mod:`foldwise.operators.cumulative`, never a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.cumulative import running_sums
from foldwise.operators.joins import null_safe_join

LOG_LOSS_EPS = 1e-15


def confusion_long(df: DataFrame, truth_col: str, pred_col: str,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*group_cols, F.col(truth_col).alias("actual"), F.col(pred_col).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))


def confusion_wide(conf: DataFrame, classes: Sequence[str], group_cols: Sequence[str] = (),
                   prefix: str = "pred_") -> DataFrame:
    """Pivot with the full class list: one column per class, zero filled.
    Without groups, classes never seen as ``actual`` get an all-zero row."""
    classes = list(classes)
    wide = (conf.groupBy(*group_cols, "actual").pivot("predicted", classes).agg(F.sum("n")))
    wide = wide.select(*group_cols, "actual",
                       *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"{prefix}{c}") for c in classes])
    if not group_cols:
        spark = conf.sparkSession
        # the class list is a fixed-size literal table
        cls = spark.createDataFrame([(c,) for c in classes], "actual string")
        wide = cls.join(wide, "actual", "left").select(
            "actual", *[F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)).cast("bigint").alias(f"{prefix}{c}")
                        for c in classes])
    return wide


def class_counts(conf: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., label, support, predicted, tp) over labels in truth or prediction."""
    # Both sides of a count come from one read of it: what makes the counts (often the scoring of all rows) runs once.
    as_truth = F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("pred_n"),
                        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    as_pred = F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("pred_n"),
                       F.lit(0).cast("bigint").alias("tp"))
    return (conf.select(*group_cols, F.inline(F.array(as_truth, as_pred))).groupBy(*group_cols, "label")
                    .agg(F.sum("support").alias("support"), F.sum("pred_n").alias("predicted"),
                         F.sum("tp").alias("tp")))


def _prf(tp: Column, support: Column, pred: Column) -> tuple[Column, Column, Column]:
    tp, support, pred = tp.cast("double"), support.cast("double"), pred.cast("double")
    precision = F.when(pred > 0, tp / pred).otherwise(0.0)
    recall = F.when(support > 0, tp / support).otherwise(0.0)
    f1 = F.when(support + pred > 0, 2 * tp / (support + pred)).otherwise(0.0)
    return precision, recall, f1


def class_report(conf: DataFrame, group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Per-class precision, recall, F1 and support (zero_division = 0)."""
    cc = class_counts(conf, group_cols)
    p, r, f = _prf(F.col("tp"), F.col("support"), F.col("predicted"))
    return cc.select(*group_cols, "label", F.round(p, digits).alias("precision"),
                     F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"),
                     F.col("support").cast("bigint").alias("support"))


def report_averages(conf: DataFrame, group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The averages rows of the class report: label ``accuracy``, ``macro avg`` and
    ``weighted avg`` with precision, recall, f1 and support (accuracy fills f1 only)."""
    cc = class_counts(conf, group_cols)
    p, r, f = _prf(F.col("tp"), F.col("support"), F.col("predicted"))
    per = cc.select(*group_cols, "tp", "support", p.alias("p"), r.alias("r"), f.alias("f"))
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    row = lambda label, cols: F.struct(F.lit(label).alias("label"), *[
        F.round(c, digits).alias(n) for n, c in zip(("precision", "recall", "f1"), cols)], F.col("n").alias("support"))
    agg = per.groupBy(*group_cols).agg(
        F.sum("support").cast("bigint").alias("n"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in "prf"], *[weighted(c).alias(f"w_{c}") for c in "prf"])
    none = F.lit(None).cast("double")
    return agg.select(*group_cols, F.inline(F.array(
        row("accuracy", (none, none, F.col("acc"))), row("macro avg", [F.col(f"m_{c}") for c in "prf"]),
        row("weighted avg", [F.col(f"w_{c}") for c in "prf"]))))


def summary_metrics(conf: DataFrame, group_cols: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """accuracy, macro-F1, weighted-F1, macro precision, macro recall, n."""
    cc = class_counts(conf, group_cols)
    p, r, f = _prf(F.col("tp"), F.col("support"), F.col("predicted"))
    per = cc.select(*group_cols, "tp", "support", p.alias("p"), r.alias("r"), f.alias("f"))
    agg = per.groupBy(*group_cols).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f").alias("macro_f1"),
        (F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.sum("support").cast("bigint").alias("n"))
    if digits is None:
        return agg
    return agg.select(*group_cols, *[F.round(c, digits).alias(c) for c in
                                     ["accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"]],
                      "n")


def sum_confusions(conf: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Aggregate confusion over folds (AGG-12)."""
    return conf.groupBy(*group_cols, "actual", "predicted").agg(F.sum("n").cast("bigint").alias("n"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax_index(arr: Column | str) -> Column:
    """0-based index of the first maximum of an array (ties -> first)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return bound(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def normalise(arr: Column | str, n: int | None = None) -> Column:
    """Divide an array by its sum; array and sum are computed once.  With a known
    length ``n`` the sum and the division are plain expressions, else lambdas."""
    a = F.col(arr) if isinstance(arr, str) else arr

    def by_sum(v):
        if n is not None:
            total = F.element_at(v, 1)
            for i in range(1, n):
                total = total + F.element_at(v, i + 1)
            return bound(total, lambda t: F.array(*[F.element_at(v, i + 1) / t for i in range(n)]))
        return bound(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), lambda t: F.transform(v, lambda x: x / t))

    return bound(a, by_sum)


def log_loss(df: DataFrame, prob_col: str, label_idx_col: str, group_cols: Sequence[str] = (),
             eps: float = LOG_LOSS_EPS, digits: int = 6) -> DataFrame:
    """Mean of -ln(clip(p[y])) with rows normalised to sum 1."""
    p = bound(F.col(prob_col), lambda v: F.element_at(v, F.col(label_idx_col) + 1) / F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x))
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*group_cols).agg(F.round(F.avg(-F.log(clipped)), digits).alias("log_loss"),
                                       F.count(F.lit(1)).alias("n"))


def _auc_from_scores(scores: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """scores: (group..., score, pos, neg) with one row per distinct score."""
    rs = running_sums(scores, group_cols, "score", ["neg"], inclusive=False)
    contrib = rs.select(*group_cols, (F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))).alias("c"),
                        "pos", "neg")
    return contrib.groupBy(*group_cols).agg(
        F.try_divide(F.sum("c"), F.sum("pos") * F.sum("neg")).alias("auc"),   # NULL with one class only
        F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"))


def score_table(df: DataFrame, truth: Column, score: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    t = truth.cast("int")
    return (df.groupBy(*group_cols, score.cast("double").alias("score"))
              .agg(F.sum(t).cast("bigint").alias("pos"), F.sum(1 - t).cast("bigint").alias("neg")))


def roc_auc(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (),
            digits: int = 6) -> DataFrame:
    """Binary ROC area (Mann-Whitney with ties counted half)."""
    st = score_table(df, F.col(label_col) == 1, F.col(score_col), group_cols)
    out = _auc_from_scores(st, group_cols)
    return out.select(*group_cols, F.round("auc", digits).alias("roc_auc"), "n_pos", "n_neg")


def roc_auc_ovr(df: DataFrame, label_idx_col: str, prob_col: str, n_classes: int,
                digits: int = 6) -> DataFrame:
    """One-vs-rest ROC area per class: (class, roc_auc, n_pos, n_neg).  A row
    with another number of scores than ``n_classes`` is an error."""
    scores = bound(F.col(prob_col), lambda v: F.when(F.size(v) == n_classes, v).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n_classes} class scores, got "), F.size(v).cast("string")))))
    exploded = df.select(F.col(label_idx_col).alias("__y"), F.posexplode(scores).alias("class", "score"))
    st = score_table(exploded, F.col("__y") == F.col("class"), F.col("score"), ["class"])
    out = _auc_from_scores(st, ["class"])
    return out.select(F.col("class").cast("int").alias("class"), F.round("auc", digits).alias("roc_auc"),
                      "n_pos", "n_neg")


def roc_auc_ovr_macro(df: DataFrame, label_idx_col: str, prob_col: str, n_classes: int,
                      digits: int = 6) -> DataFrame:
    per = roc_auc_ovr(df, label_idx_col, prob_col, n_classes, digits=15)
    return per.agg(F.round(F.avg("roc_auc"), digits).alias("roc_auc_macro"),
                   F.count(F.lit(1)).alias("n_classes"))


def pr_auc(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (),
           digits: int = 6) -> DataFrame:
    """Trapezoid area under the precision-recall curve of the positive class.

    Thresholds are the distinct scores, high to low; the curve starts at
    (recall 0, precision 1).  Each threshold's step needs only its own
    cumulative counts: the previous point is the same sums minus this score's
    rows, so no lag across the global order is required.
    """
    st = score_table(df, F.col(label_col) == 1, F.col(score_col), group_cols)
    rs = running_sums(st, group_cols, "score", ["pos", "neg"], descending=True, inclusive=True)
    tps, fps = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    ptp, pfp = tps - F.col("pos"), fps - F.col("neg")
    prec = tps / (tps + fps)
    prev = F.when(ptp + pfp > 0, ptp / (ptp + pfp)).otherwise(1.0)
    step = rs.select(*group_cols, "pos", "neg", (F.col("pos") * (prec + prev) / 2).alias("a"))
    return step.groupBy(*group_cols).agg(
        F.round(F.try_divide(F.sum("a"), F.sum("pos")), digits).alias("pr_auc"),   # NULL without positives
        F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"))


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over labels in truth or prediction (zero_division = 0).

    ``MulticlassClassificationEvaluator`` has no macro-F1 (its ``f1`` is
    support weighted), so this evaluator aggregates the confusion table.
    Also offers weighted F1 and accuracy via ``metricName``.
    """

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    metricName = Param(Params._dummy(), "metricName", "macro_f1 | weighted_f1 | accuracy",
                       TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction",
                 metricName: str = "macro_f1") -> None:
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", metricName="macro_f1")
        self._set(labelCol=labelCol, predictionCol=predictionCol, metricName=metricName)

    def _evaluate(self, dataset: DataFrame) -> float:
        conf = confusion_long(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.predictionCol))
        row = summary_metrics(conf, digits=None).first()
        return float(row[self.getOrDefault(self.metricName)])

    def isLargerBetter(self) -> bool:
        return True


def agreement_metrics(conf: DataFrame, group_cols: Sequence[str] = (), cost: DataFrame | None = None,
                      digits: int = 6) -> DataFrame:
    """Micro-F1, multiclass MCC, Cohen's kappa and mean misclassification cost.

    All four are functions of the per-class marginals of the confusion table:
    with c = correct, s = total, t_k = true count, p_k = predicted count,
    MCC = (c s - sum t_k p_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2)),
    kappa = (p_o - p_e) / (1 - p_e), p_o = c / s, p_e = sum t_k p_k / s^2.
    ``cost`` is an optional (actual, predicted, cost) table; default 0/1 cost.
    """
    cc = class_counts(conf, group_cols)
    marg = cc.groupBy(*group_cols).agg(
        F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_sum"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"))
    if cost is None:
        costs = conf.groupBy(*group_cols).agg(
            (F.sum(F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"))
            .alias("mean_cost"))
    else:
        cst = cost.select(F.col("actual").alias("__a"), F.col("predicted").alias("__p"), F.col("cost"))
        j = conf.join(cst, (conf["actual"] == cst["__a"]) & (conf["predicted"] == cst["__p"]), "left")
        costs = j.groupBy(*group_cols).agg(
            (F.sum(F.coalesce(F.col("cost"), F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("mean_cost"))
    c, s = F.col("c"), F.col("s")
    den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(den > 0, (c * s - F.col("tp_sum")) / den).otherwise(0.0)
    pe = F.col("tp_sum") / (s * s)
    kappa = F.when(pe < 1, (c / s - pe) / (1 - pe)).otherwise(0.0)
    if group_cols:
        out = null_safe_join(marg, costs, list(group_cols))
    else:
        out = marg.withColumn("mean_cost", costs.select("mean_cost").scalar())
    return out.select(*group_cols, F.round(c / s, digits).alias("micro_f1"), F.round(mcc, digits).alias("mcc"),
                      F.round(kappa, digits).alias("kappa"), F.round("mean_cost", digits).alias("mean_cost"))


def calibration(df: DataFrame, conf_col: str, correct_col: str, n_bins: int = 10,
                group_cols: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Expected (ECE), root-mean-square (RMSCE) and maximum (MCE) calibration
    error over equal-width confidence bins (bin = floor(conf * n_bins), the top
    edge joins the last bin)."""
    b = F.least(F.floor(F.col(conf_col) * n_bins), F.lit(n_bins - 1)).cast("int")
    bins = df.groupBy(*group_cols, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(correct_col).cast("double")).alias("acc"),
        F.avg(F.col(conf_col).cast("double")).alias("conf"))
    gap = F.abs(F.col("acc") - F.col("conf"))
    agg = bins.groupBy(*group_cols).agg(
        F.sum(F.col("n") * gap).alias("w"), F.sum(F.col("n") * gap * gap).alias("w2"),
        F.max(gap).alias("mce"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_bins"))
    return agg.select(*group_cols, F.round(F.col("w") / F.col("n"), digits).alias("ece"),
                      F.round(F.sqrt(F.col("w2") / F.col("n")), digits).alias("rmsce"),
                      F.round("mce", digits).alias("mce"), F.col("n").cast("bigint").alias("n"),
                      F.col("n_bins").cast("bigint").alias("n_bins"))
