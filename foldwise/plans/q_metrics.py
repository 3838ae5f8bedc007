"""Metric queries over rule-based predictions derived from the driver tables.

No model is needed for exact metric checks: a deterministic rule produces a
prediction per row (so DuckDB can recompute the same scores).
* events: truth = cleaned raw label, prediction = class number floor(value) mod 4
* embeddings: truth = label, probabilities = softmax(4 x sums of the dims by index modulo 10)
* documents + labels: truth = quality, score = n_chars
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import metrics as M
from foldwise.plans.catalog import query
from foldwise.plans.q_labels import clean_events
from foldwise.plans.sqlparts import EV_CLEAN, with_
from foldwise.session import read_table

# Class list of the cleaned events labels (sorted) and the full
# vocabulary including the dropped catch-all.
EVENT_CLASSES = ["click", "purchase", "signup", "view"]
ALL_EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
N_EMB_CLASSES = 10


def rule_predictions(spark, sf_dir):
    ev = clean_events(spark, sf_dir)
    cls = F.array(*[F.lit(c) for c in EVENT_CLASSES])
    pred = F.element_at(cls, (F.floor("value").cast("bigint") % 4 + 1).cast("int"))
    return ev.select("event_id", "home_id", F.col("activity").alias("y_true"), pred.alias("y_pred"))


_PRED_SQL = r"""
pr AS (SELECT event_id, home_id, activity AS y_true,
              ['click', 'purchase', 'signup', 'view'][CAST(floor(value) AS BIGINT) % 4 + 1] AS y_pred
       FROM ev_clean)"""

_CLASS_COUNTS_SQL = r"""
conf AS (SELECT {g} y_true AS actual, y_pred AS predicted, count(*) AS n FROM pr GROUP BY ALL),
cc AS (
  SELECT {g} label, sum(support) AS support, sum(pred_n) AS predicted, sum(tp) AS tp FROM (
    SELECT {g} actual AS label, n AS support, 0 AS pred_n, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp
    FROM conf
    UNION ALL
    SELECT {g} predicted, 0, n, 0 FROM conf) GROUP BY ALL),
prf AS (
  SELECT {g} label, tp, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r,
         CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f
  FROM cc)"""


def _emb_probs(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    total = lambda c: F.aggregate(F.filter("embedding", lambda x, i: i % N_EMB_CLASSES == c), F.lit(0.0),
                                  lambda a, x: a + x.cast("double"))
    e = F.array(*[F.exp(4 * total(c)) for c in range(N_EMB_CLASSES)])
    return emb.select("vec_id", "label", M.normalise(e, N_EMB_CLASSES).alias("prob"))


_EMB_SQL = r"""
e0 AS (SELECT vec_id, label, list_transform(range(1, 11), lambda c: exp(4 * list_sum(list_transform(
         range(c, len(embedding) + 1, 10), lambda j: CAST(embedding[j] AS DOUBLE))))) AS e
       FROM embeddings),
pe AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS prob FROM e0)"""


@query("confusion_long", with_(EV_CLEAN, _PRED_SQL, r"""
c AS (SELECT home_id, y_true AS actual, y_pred AS predicted, count(*) AS n FROM pr GROUP BY ALL)
SELECT * FROM c"""))
def q_confusion_long(spark, sf_dir):
    return M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred", ["home_id"])


@query("confusion_wide", with_(EV_CLEAN, _PRED_SQL, r"""
cls AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS actual),
c AS (SELECT y_true AS actual, y_pred AS predicted, count(*) AS n FROM pr GROUP BY ALL)
SELECT cls.actual,
""" + ",\n".join(f"  CAST(coalesce(sum(n) FILTER (WHERE predicted = '{k}'), 0) AS BIGINT) AS pred_{k}"
                 for k in ALL_EVENT_CLASSES) + r"""
FROM cls LEFT JOIN c USING (actual) GROUP BY cls.actual"""))
def q_confusion_wide(spark, sf_dir):
    conf = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred")
    return M.confusion_wide(conf, ALL_EVENT_CLASSES)


@query("confusion_sum_folds", with_(EV_CLEAN, _PRED_SQL, r"""
c AS (SELECT home_id, y_true AS actual, y_pred AS predicted, count(*) AS n FROM pr GROUP BY ALL)
SELECT actual, predicted, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL"""))
def q_confusion_sum_folds(spark, sf_dir):
    """Per-group (fold-shaped) confusions summed into one table."""
    per = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred", ["home_id"])
    return M.sum_confusions(per)


@query("class_report", with_(EV_CLEAN, _PRED_SQL, _CLASS_COUNTS_SQL.format(g=""), r"""
z AS (SELECT 1)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM prf"""))
def q_class_report(spark, sf_dir):
    conf = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred")
    return M.class_report(conf)


@query("class_report_averages", with_(EV_CLEAN, _PRED_SQL, _CLASS_COUNTS_SQL.format(g=""), r"""
z AS (SELECT 1)
SELECT 'accuracy' AS label, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, round(sum(tp) / sum(support), 6) AS f1,
       CAST(sum(support) AS BIGINT) AS support FROM prf
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf"""))
def q_class_report_averages(spark, sf_dir):
    """The averages rows of the class report."""
    return M.report_averages(M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred"))


@query("macro_metrics", with_(EV_CLEAN, _PRED_SQL, _CLASS_COUNTS_SQL.format(g="home_id,"), r"""
z AS (SELECT 1)
SELECT home_id, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1,
       round(sum(f * support) / sum(support), 6) AS weighted_f1, round(avg(p), 6) AS macro_precision,
       round(avg(r), 6) AS macro_recall, CAST(sum(support) AS BIGINT) AS n
FROM prf GROUP BY home_id"""))
def q_macro_metrics(spark, sf_dir):
    conf = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred", ["home_id"])
    return M.summary_metrics(conf, ["home_id"])


@query("log_loss", with_(_EMB_SQL, r"""
z AS (SELECT 1)
SELECT round(avg(-ln(least(greatest(prob[label + 1], 1e-15), 1 - 1e-15))), 6) AS log_loss, count(*) AS n FROM pe"""))
def q_log_loss(spark, sf_dir):
    return M.log_loss(_emb_probs(spark, sf_dir), "prob", "label")


@query("argmax_label", with_(_EMB_SQL, r"""
z AS (SELECT 1)
SELECT vec_id, label, CAST(list_position(prob, list_max(prob)) - 1 AS INTEGER) AS predicted,
       (list_position(prob, list_max(prob)) - 1) = label AS correct,
       round(list_max(prob), 6) AS confidence
FROM pe"""))
def q_argmax_label(spark, sf_dir):
    p = _emb_probs(spark, sf_dir)
    idx = M.argmax_index("prob")
    return p.select("vec_id", "label", idx.alias("predicted"), (idx == F.col("label")).alias("correct"),
                    F.round(F.array_max("prob"), 6).alias("confidence"))


_OVR_SQL = r"""
ex AS (SELECT label AS y, unnest(range(0, 10)) AS class, unnest(prob) AS score FROM pe),
st AS (SELECT class, score, sum(CASE WHEN y = class THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y = class THEN 0 ELSE 1 END) AS neg FROM ex GROUP BY 1, 2),
rs AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM st),
per AS (SELECT CAST(class AS INTEGER) AS class, sum(pos * (cneg + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc,
               CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM rs GROUP BY class)"""


@query("roc_auc_ovr", with_(_EMB_SQL, _OVR_SQL, r"""
z AS (SELECT 1)
SELECT class, round(auc, 6) AS roc_auc, n_pos, n_neg FROM per"""))
def q_roc_auc_ovr(spark, sf_dir):
    p = _emb_probs(spark, sf_dir)
    return M.roc_auc_ovr(p, "label", "prob", N_EMB_CLASSES)


@query("roc_auc_macro", with_(_EMB_SQL, _OVR_SQL, r"""
z AS (SELECT 1)
SELECT round(avg(round(auc, 15)), 6) AS roc_auc_macro, count(*) AS n_classes FROM per"""))
def q_roc_auc_macro(spark, sf_dir):
    p = _emb_probs(spark, sf_dir)
    return M.roc_auc_ovr_macro(p, "label", "prob", N_EMB_CLASSES)


_DOC_SQL = r"""
d AS (SELECT d.lang, l.quality, CAST(d.n_chars AS DOUBLE) AS score
      FROM documents d JOIN labels l USING (doc_id)),
st AS (SELECT lang, score, sum(quality) AS pos, sum(1 - quality) AS neg FROM d GROUP BY 1, 2)"""


def _doc_scores(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id")


@query("pr_auc", with_(_DOC_SQL, r"""
rs AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps FROM st
       WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT lang, pos, neg,
             pos * (tps / (tps + fps)
                    + CASE WHEN tps - pos + fps - neg > 0 THEN (tps - pos) / (tps - pos + fps - neg) ELSE 1.0 END
                   ) / 2 AS a
      FROM rs)
SELECT lang, round(sum(a) / nullif(sum(pos), 0), 6) AS pr_auc, CAST(sum(pos) AS BIGINT) AS n_pos,
       CAST(sum(neg) AS BIGINT) AS n_neg FROM a GROUP BY lang"""))
def q_pr_auc(spark, sf_dir):
    return M.pr_auc(_doc_scores(spark, sf_dir), "quality", "n_chars", ["lang"])


@query("roc_auc_binary", with_(_DOC_SQL, r"""
rs AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY score
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM st)
SELECT lang, round(sum(pos * (cneg + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM rs GROUP BY lang"""))
def q_roc_auc_binary(spark, sf_dir):
    return M.roc_auc(_doc_scores(spark, sf_dir), "quality", "n_chars", ["lang"])


@query("agreement_metrics", with_(EV_CLEAN, _PRED_SQL, _CLASS_COUNTS_SQL.format(g="home_id,"), r"""
marg AS (SELECT home_id, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support) AS DOUBLE) AS s,
                sum(CAST(support AS DOUBLE) * predicted) AS tp_sum, sum(CAST(predicted AS DOUBLE) * predicted) AS pp,
                sum(CAST(support AS DOUBLE) * support) AS tt
         FROM cc GROUP BY home_id),
costs AS (SELECT home_id, sum(CASE WHEN actual <> predicted THEN n ELSE 0 END) / sum(n) AS mean_cost
          FROM conf GROUP BY home_id),
m AS (SELECT *, sqrt((s * s - pp) * (s * s - tt)) AS den, tp_sum / (s * s) AS pe FROM marg JOIN costs USING (home_id))
SELECT home_id, round(c / s, 6) AS micro_f1,
       round(CASE WHEN den > 0 THEN (c * s - tp_sum) / den ELSE 0.0 END, 6) AS mcc,
       round(CASE WHEN pe < 1 THEN (c / s - pe) / (1 - pe) ELSE 0.0 END, 6) AS kappa,
       round(mean_cost, 6) AS mean_cost
FROM m"""))
def q_agreement_metrics(spark, sf_dir):
    """Micro-F1, MCC, Cohen's kappa and mean 0/1 misclassification cost per group."""
    conf = M.confusion_long(rule_predictions(spark, sf_dir), "y_true", "y_pred", ["home_id"])
    return M.agreement_metrics(conf, ["home_id"])


@query("calibration", with_(_EMB_SQL, r"""
c AS (SELECT list_max(prob) AS conf, (list_position(prob, list_max(prob)) - 1) = label AS correct FROM pe),
b AS (SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n,
             avg(CAST(correct AS DOUBLE)) AS acc, avg(conf) AS conf FROM c GROUP BY 1)
SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(sqrt(sum(n * abs(acc - conf) * abs(acc - conf)) / sum(n)), 6) AS rmsce,
       round(max(abs(acc - conf)), 6) AS mce, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins FROM b"""))
def q_calibration(spark, sf_dir):
    """Confidence calibration (ECE, RMSCE, MCE) of the argmax class, 10 bins."""
    p = _emb_probs(spark, sf_dir)
    scored = p.select(F.array_max("prob").alias("conf"), (M.argmax_index("prob") == F.col("label")).alias("correct"))
    return M.calibration(scored, "conf", "correct", 10)
