"""Class-balance and label-coverage profiling.

All tables derive from one partial+final hash aggregate of the labelled data;
later steps only touch the aggregated (label, n) rows, whose size is the
class vocabulary, not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rarity thresholds of the reference's label exploration.
RARITY_THRESHOLDS: tuple[int, ...] = (100, 500, 1000, 5000)


def label_counts(df: DataFrame, label_col: str, out_label: str = "label") -> DataFrame:
    """Rows per label (``value_counts``)."""
    return df.groupBy(F.col(label_col).alias(out_label)).agg(F.count(F.lit(1)).alias("n"))


def label_counts_both(df: DataFrame, raw_col: str, general_col: str) -> DataFrame:
    """Counts in both label spaces, long format (label_space, label, n): rows are
    counted by pair once, grouping sets run over that small table."""
    gs = (pair_counts(df, raw_col, general_col).groupingSets([[raw_col], [general_col]], raw_col, general_col)
            .agg(F.grouping_id(raw_col, general_col).alias("__g"), F.sum("n").alias("n")))
    raw = F.col("__g") == 1
    return gs.select(F.when(raw, F.lit("raw")).otherwise(F.lit("general")).alias("label_space"),
                     F.when(raw, F.col(raw_col)).otherwise(F.col(general_col)).alias("label"), "n")


def pair_counts(df: DataFrame, parent_col: str, child_col: str) -> DataFrame:
    """Rows per (parent, child) pair."""
    return df.groupBy(parent_col, child_col).agg(F.count(F.lit(1)).alias("n"))


def label_grouping_sets(df: DataFrame, raw_col: str, general_col: str) -> DataFrame:
    """Specific, general and total counts: GROUPING SETS over the counts of pairs."""
    return (pair_counts(df, raw_col, general_col).groupingSets([[raw_col], [general_col], []], raw_col, general_col)
              .agg(F.grouping_id(raw_col, general_col).cast("int").alias("grouping_id"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def label_index_table(df: DataFrame, label_col: str, out_label: str = "label") -> DataFrame:
    """Label -> 0-based index in alphabetical order (StringIndexer alphabetAsc)."""
    c = label_counts(df, label_col, out_label)
    # one row per class: the window runs over the class vocabulary only
    return c.select(out_label,
                    (F.row_number().over(Window.orderBy(out_label)) - 1).cast("int").alias("label_index"),
                    "n")


def summarize_counts(counts: DataFrame, group_cols: Sequence[str] = (), n_col: str = "n",
                     digits: int = 6) -> DataFrame:
    """n, total, min, p25, median, mean, max, max/min of a count column (exact)."""
    n = F.col(n_col)
    aggs = [
        F.count(F.lit(1)).alias("n_labels"),
        F.sum(n).cast("bigint").alias("total"),
        F.min(n).cast("bigint").alias("min_n"),
        F.round(F.percentile(n, 0.25), digits).alias("p25"),
        F.round(F.percentile(n, 0.5), digits).alias("median"),
        F.round(F.avg(n), digits).alias("mean"),
        F.max(n).cast("bigint").alias("max_n"),
        F.round(F.max(n) / F.min(n), digits).alias("max_min_ratio"),
    ]
    return counts.groupBy(*group_cols).agg(*aggs)


def rarity_table(counts: DataFrame, group_cols: Sequence[str] = (), n_col: str = "n",
                 thresholds: Sequence[int] = RARITY_THRESHOLDS) -> DataFrame:
    """Labels with fewer than t rows, for each threshold t (long format)."""
    wide = counts.groupBy(*group_cols).agg(*[
        F.count(F.when(F.col(n_col) < t, 1)).alias(f"t{t}") for t in thresholds])
    return (wide.unpivot(list(group_cols), [f"t{t}" for t in thresholds], "threshold", "n_below")
                .withColumn("threshold", F.regexp_replace("threshold", "^t", "").cast("int")))


def labels_below(counts: DataFrame, threshold: int, n_col: str = "n") -> DataFrame:
    """Count-threshold predicate (FLT-4)."""
    return counts.filter(F.col(n_col) < threshold)


def label_group_coverage(df: DataFrame, label_col: str, group_col: str) -> DataFrame:
    """Per label: number of distinct groups carrying it and its rows (exact)."""
    return (df.groupBy(F.col(label_col).alias("label"))
              .agg(F.countDistinct(group_col).alias("n_groups"), F.count(F.lit(1)).alias("n_rows")))


def bucket_coherence(df: DataFrame, parent_col: str, child_col: str, digits: int = 6) -> DataFrame:
    """Per parent bucket: children, rows, largest child (name, rows, share).

    Largest child = most rows, ties to the smallest name (``min`` over a
    struct, never an order-dependent ``first``).
    """
    pairs = pair_counts(df, parent_col, child_col)
    agg = pairs.groupBy(parent_col).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.sum("n").alias("total"),
        F.max("n").alias("top_n"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col(child_col).alias("name"))).alias("top"))
    return agg.select(parent_col, "n_children", F.col("total").cast("bigint").alias("total"),
                      F.col("top_n").cast("bigint").alias("top_n"), F.col("top.name").alias("top_child"),
                      F.round(F.col("top_n") / F.col("total"), digits).alias("top_share"))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6,
                     quartiles: bool = True) -> DataFrame:
    """count / nulls / mean / std / min / 25% / 50% / 75% / max per numeric column.

    The moments are mergeable aggregates (one partial + final aggregation);
    the quartiles are exact (linear interpolation) via bucketed selection,
    never by gathering a column into one task.
    """
    from pyspark.sql.types import NumericType
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                  if isinstance(f.dataType, NumericType)]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}__count"),
                 F.sum(F.when(x.isNull(), 1).otherwise(0)).cast("double").alias(f"{c}__nulls"),
                 F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    stats = ["count", "nulls", "mean", "std", "min", "max"]
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols])
    out = wide.select(F.inline(rows))
    out = out.select("column", F.col("count").cast("bigint").alias("count"),
                     F.col("nulls").cast("bigint").alias("null_count"),
                     *[F.round(s, digits).alias(s) for s in ["mean", "std", "min", "max"]])
    if not quartiles:
        return out
    from foldwise.operators.cumulative import exact_quantiles
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), digits).alias(name)
                                   for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return out.join(qw, "column", "left")
