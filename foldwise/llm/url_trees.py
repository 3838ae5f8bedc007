"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled examples.  Spark's GBTClassifier is
fitted on a bounded sample of them, and its trees are written out as one
nested CASE expression, so judging is a projection inside code generation.
Features are lengths, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix (how many URLs have it, pre-aggregated).

Defined cases: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the model; without labelled rows of both
verdicts the model is the one verdict seen, or ``allow``; repeated urls get the
same verdict; extra columns pass through (columns named like a result are
replaced).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ascii_lower, count_chars, join_by_group, let, order_hash, require
from foldwise.session import cut_lineage

MAX_TRAIN_ROWS = 20_000  # bound of the labelled sample the trees are fitted on
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digits", "digit_ratio",
            "hyphens", "entropy", "parameters", "has_fragment", "is_https", "last_length", "extension_length",
            "first_segment_length", "suffix_length", "suffix_count")


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host with all its subdomains, where the path begins with the rule's."""

    verdict: str
    pattern: str  # host, then path from the first slash on

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


DEFAULT_RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to / ? # or the end, A-Z
    lower-cased; then what follows up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.length(host) + 1)


def match_rules(host: Column, path: Column, rules: Sequence[UrlRule] = DEFAULT_RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern = F.when(fits, F.lit(r.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def suffix(host: Column) -> Column:
    """Last label of the host."""
    return F.substring_index(host, ".", -1)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text."""
    def of(chars: Column) -> Column:
        n = F.size(chars)
        terms = F.transform(F.array_distinct(chars), lambda c: let(
            F.size(F.filter(chars, lambda x: x == c)) / n, lambda p: -p * F.log2(p)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.length(text) > 0, let(F.split(text, ""), of)).otherwise(F.lit(0.0))


def features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path and the lexical features; the statistics of suffixes cover all rows."""
    require(df, url_col)
    keep = [c for c in df.columns if c not in (*FEATURES, "host", "path")]
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = split_url(F.col(f"`{url_col}`"))
    df = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), url.alias("__u"))
    df = df.withColumn("__suffix", suffix(F.col("host")))
    seen = cut_lineage(df.groupBy("__suffix").agg(F.log1p(F.count(F.lit(1))).alias("suffix_count")))
    df = join_by_group(df, seen, ["__suffix"], F.col("__u"))
    u, h, p = F.col("__u"), F.col("host"), F.col("path")
    query = F.when(F.instr(u, "?") > 0, F.substring_index(F.substr(u, F.instr(u, "?") + 1), "#", 1)).otherwise("")
    last = F.substring_index(p, "/", -1)
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]+", ""))
    cols = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p),
        "query_length": F.length(query), "depth": count_chars(p, "/"), "host_labels": count_chars(h, ".") + 1,
        "digits": digits, "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)),
        "hyphens": count_chars(u, "-"), "entropy": _entropy(u),
        "parameters": F.when(query == "", 0).otherwise(count_chars(query, "&") + 1),
        "has_fragment": F.instr(u, "#") > 0, "is_https": u.startswith("https://"),
        "last_length": F.length(last),
        "extension_length": F.when(F.instr(last, ".") > 0, F.length(F.substring_index(last, ".", -1))).otherwise(0),
        "first_segment_length": F.length(F.split_part(p, F.lit("/"), F.lit(2))),
        "suffix_length": F.length("__suffix"), "suffix_count": F.col("suffix_count"),
    }
    return df.select(*[F.col(f"`{c}`") for c in keep], "host", "path",
                     *[c.cast("double").alias(k) for k, c in cols.items()])


def trees_to_column(model) -> Column:
    """The margin of a fitted GBT model as one expression over its feature columns."""
    def node(n) -> Column:
        if n.numDescendants() == 0:
            return F.lit(float(n.prediction()))
        split = n.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())),
                      node(n.leftChild())).otherwise(node(n.rightChild()))
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        margin = margin + F.lit(float(weight)) * node(tree._call_java("rootNode"))
    return margin


def fit(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, trees: int = 12, depth: int = 4, seed: int = 7) -> Column:
    """Probability of ``block`` as an expression, learned from rows (features,
    label: 1 blocked, 0 allowed, key).  The fit sees the ``max_rows`` rows with
    the smallest hash of their key, or all of them if there are fewer."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return F.lit(float(next(iter(counts), 0.0)))
    share = max_rows / sum(counts.values())
    if share < 1:
        labelled = labelled.where(order_hash(F.col("key")) < int(share * 2 ** 60))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, maxBins=32)
    margin = trees_to_column(gbt.fit(data.select("features", "label")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def judge(df: DataFrame, url_col: str = "url", rules: Sequence[UrlRule] = DEFAULT_RULES,
          max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Columns of ``df`` plus host, path, rule, score (probability of block) and verdict."""
    keep = [c for c in df.columns if c not in (*FEATURES, "host", "path", "rule", "score", "verdict")]
    featured = features(df.select(*[F.col(f"`{c}`") for c in keep]), url_col)
    pattern, verdict = match_rules(F.col("host"), F.col("path"), rules)
    featured = featured.withColumns({"rule": pattern, "__rule_verdict": verdict})
    labelled = featured.where("rule is not null").select(
        *FEATURES, (F.col("__rule_verdict") == "block").cast("double").alias("label"),
        F.col(f"`{url_col}`").alias("key"))
    score = fit(cut_lineage(labelled), max_train_rows)
    return featured.withColumn("score", score).select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "score",
        F.coalesce("__rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
