"""Quality classifier: document evidence combined with site posteriors.

A logistic regression on text features gives each document's own evidence.
Sites are nested levels (host, then path): each level's posterior mean of good
documents is shrunk towards that of the level above, the top level towards the
global mean, by a strength estimated from how much the sites of the level
differ (empirical Bayes).  A site's counts are its labels, and the expected
label where there is none, so they cover all documents; they are grouped
partial aggregates.  Document log-odds plus the site's log-odds over the global
ones give the score.

The regression is fitted on at most ``max_train_rows`` labelled rows (those
with the smallest hash of the id) and written out as one expression.

Defined cases: null text counts as empty; null site values are sites of their
own; without labels of both kinds every document's own evidence is that kind
(good, if there is no label); several labels of an id are averaged; repeated
rows get equal scores; extra columns pass through (columns named like a result
are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import join_by_group, let, order_hash, require, words
from foldwise.session import cut_lineage

MAX_TRAIN_ROWS = 20_000
KEEP_FROM = 0.5
FEATURES = ("log_words", "word_length", "distinct_share", "distinct_root", "repeated_neighbours", "short_words",
            "symbols", "marks", "upper", "digits", "repeated_lines")
RESULTS = ("p_document", "p_host", "p_path", "score", "kept")


def features(df: DataFrame, text_col: str) -> DataFrame:
    """Add the feature columns, measured once per row."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_chars = F.greatest(F.length(t), F.lit(1))
    share = lambda regex: (F.length(t) - F.length(F.regexp_replace(t, regex, ""))) / n_chars

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        twice = F.filter(w, lambda x, i: x == F.get(w, i + 1))
        return let(F.size(F.array_distinct(w)), lambda d: F.struct(
            F.log1p(F.size(w)).alias("log_words"), (F.length(F.array_join(w, "")) / n).alias("word_length"),
            (d / n).alias("distinct_share"), (F.log1p(d) / F.log1p(n)).alias("distinct_root"),
            (F.size(twice) / n).alias("repeated_neighbours"),
            (F.size(F.filter(w, lambda x: F.length(x) == 1)) / n).alias("short_words")))

    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    of_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)))
    row = let(let(words(t), of_words), lambda w: F.array(F.struct(
        *[w[f].alias(f) for f in FEATURES[:6]], share(r"[#*$%&|<>\[\]{}=~^_\\]+").alias("symbols"),
        share(r"[!?]+").alias("marks"), share(r"\p{Lu}+").alias("upper"), share(r"[0-9]+").alias("digits"),
        of_lines.alias("repeated_lines"))))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in FEATURES], F.inline(row))  # a fence, as in the rules


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def fit_document(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Column:
    """Probability of a good document as an expression over the features, from rows (key, y, features)."""
    counts = labelled.where("y is not null").agg(F.count("y"), F.sum((F.col("y") >= 0.5).cast("int"))).first()
    n, good = counts[0], counts[1] or 0
    if good in (0, n):
        return F.lit(0.0 if n and not good else 1.0)
    rows = labelled.where("y is not null")
    if n > max_rows:
        rows = rows.where(order_hash(F.col("key")) < int(max_rows / n * 2 ** 60))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        rows.withColumn("label", (F.col("y") >= 0.5).cast("double")))
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.0, maxIter=60).fit(data.select("features", "label"))
    margin = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients, strict=True):
        margin = margin + F.lit(float(weight)) * F.col(name)
    return 1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0))))


def strength(groups: DataFrame, of: str) -> float:
    """Prior strength of a level (pseudo-documents) by the method of moments: the
    spread of its group means ``of`` beyond what counting alone explains."""
    r = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("k"),
                   F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(of), 2)).alias("ss"),
                   F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["n"] or r["k"] < 2:
        return 100.0
    mean = r["good"] / r["n"]
    noise = mean * (1 - mean)
    spare = r["n"] - r["n2"] / r["n"]
    between = max(0.0, (r["ss"] - (r["k"] - 1) * noise) / spare) if spare > 0 else 0.0
    return min(1e6, max(1.0, noise / between - 1)) if between > 0 else 1e6


def site_posteriors(evidence: DataFrame, levels: Sequence[str]) -> tuple[float, DataFrame]:
    """(global mean, table of (levels.., p_0, p_1, ..)) from rows (levels.., y): the
    posterior mean of each nested level, shrunk towards the one above."""
    groups = cut_lineage(evidence.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")))
    total = groups.agg(F.sum("n"), F.sum("good")).first()
    mean = (1 + (total[1] or 0.0)) / (2 + (total[0] or 0))
    out = None
    for i in range(len(levels)):
        keys = list(levels[:i + 1])
        level = groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if out is None:
            level = level.withColumn("above", F.lit(mean))
        else:
            level = join_by_group(level, out, keys[:-1], F.col(keys[-1])).withColumn("above", F.col(f"p_{i - 1}"))
        level = cut_lineage(level)
        k = strength(level, "above")
        out = level.withColumn(f"p_{i}", (F.lit(k) * F.col("above") + F.col("good")) / (k + F.col("n"))) \
                   .drop("n", "good", "above")
    return mean, cut_lineage(out)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
             keep_from: float = KEEP_FROM, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Columns of ``docs`` plus p_document, p_host, p_path, score and kept."""
    require(docs, id_col, text_col, host_col, path_col)
    require(labels, id_col, label_col)
    keep = [c for c in docs.columns if c not in RESULTS]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(keep)])
    at = {c: f"c_{keep.index(c)}" for c in (id_col, text_col, host_col, path_col)}
    src = src.withColumns({"host": F.col(at[host_col]), "path": F.col(at[path_col])})

    measured = features(src.select(F.col(at[id_col]).alias("key"), F.col(at[text_col]).alias("t"), "host", "path"), "t").drop("t")
    known = labels.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("double").alias("y")) \
        .where("k is not null").groupBy("k").agg(F.avg("y").alias("y"))
    measured = cut_lineage(measured.join(known, F.col("key") == F.col("k"), "left").drop("k"))
    p_document = fit_document(measured, max_train_rows)
    evidence = measured.select("host", "path", F.coalesce("y", p_document).alias("y"))
    mean, sites = site_posteriors(evidence, ["host", "path"])

    scored = features(src, at[text_col]).withColumn("p_document", p_document).drop(*FEATURES)
    scored = join_by_group(scored, sites.withColumnsRenamed({"p_0": "p_host", "p_1": "p_path"}), ["host", "path"],
                           F.col(at[id_col]))
    margin = _logit(F.col("p_document")) + _logit(F.coalesce("p_path", F.lit(mean))) - math.log(mean / (1 - mean))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)], "p_document", "p_host", "p_path", "score",
                         (F.col("score") >= keep_from).alias("kept"))
