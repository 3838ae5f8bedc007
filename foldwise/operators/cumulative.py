"""Exact running sums and quantiles over a sort order, without a single-partition window.

``Window.orderBy(score)`` without a partition moves every row to one task, and
a window per group does so for a hot group.  Here rows are range-partitioned
by (group, order), which Spark balances from a sample whatever the values
are; sums per (group, range) give each range its starting offset, and a
window inside the range finishes the exact running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import null_safe_join
from foldwise.session import cut_lineage


def in_ranges(df: DataFrame, order: Sequence[Column], out_col: str = "__rb") -> DataFrame:
    """Rows with the number of their range in the given total order.  The table
    is written to the shared folder, so the ranges stay as they are."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(out_col, F.spark_partition_id()))


def running_sums(df: DataFrame, part_cols: Sequence[str], order_col: str, sum_cols: Sequence[str],
                 descending: bool = False, inclusive: bool = True) -> DataFrame:
    """For each row add ``cum_<c>`` = sum of ``c`` over rows of the same
    partition ordered before it (and itself when ``inclusive``).

    ``order_col`` must be unique within a partition (aggregate ties first).
    """
    part_cols = list(part_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    b = in_ranges(df, [*[F.col(c) for c in part_cols], order])
    tot = b.groupBy(*part_cols, "__rb").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    # one row per (partition, range); a partition meets only the ranges it lies in
    before = Window.partitionBy(*part_cols).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part_cols, "__rb", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}")
                                           for c in sum_cols])
    joined = null_safe_join(b, offs, part_cols + ["__rb"])
    w = Window.partitionBy(*part_cols, "__rb").orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = joined.withColumns({f"cum_{c}": F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))
                              for c in sum_cols})
    return out.drop("__rb", *[f"__o_{c}" for c in sum_cols])


SKETCH = 10_000   # rank error of the bracketing sketch: 1 / SKETCH of the rows


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (``quantile_cont``) of several
    columns: one row per (column, p) with ``value``.  NULL / NaN are ignored.

    A sketch brackets each quantile by two values it is certain to lie between
    (its rank error is bounded).  One aggregation then counts the rows below
    the bracket and each distinct value inside it, a few rows in ``SKETCH``;
    running sums over these locate the two order statistics.  All of it stays
    in DataFrames; outliers and infinities are values like any other.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    src = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    slack = 2 / SKETCH
    edges = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = src.agg(*[x for c in cols for x in (
        F.count(c).alias(f"n_{c}"), F.percentile_approx(c, edges, SKETCH).alias(f"e_{c}"))])
    need = sketch.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"), F.col(f"n_{c}").alias("n"),
                 F.get(f"e_{c}", F.lit(2 * i)).alias("lo"), F.get(f"e_{c}", F.lit(2 * i + 1)).alias("hi"))
        for c in cols for i, p in enumerate(probs)])))
    pos = F.col("p") * (F.col("n") - 1)
    need = cut_lineage(need.withColumns({"r0": F.floor(pos), "r1": F.ceil(pos), "frac": pos - F.floor(pos)}))
    # len(cols) * len(probs) rows, whatever the data
    long = src.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols]))) \
        .where("v is not null")
    held = long.join(F.broadcast(need.select("column", "p", "lo", "hi")), F.col("c") == F.col("column")).where("v <= hi")
    counts = held.groupBy("column", "p", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")) \
        .agg(F.count(F.lit(1)).alias("m"))   # v is null for all rows below the bracket, first in order
    ranked = running_sums(counts, ["column", "p"], "v", ["m"], inclusive=False)
    j = ranked.join(F.broadcast(need.select(F.col("column").alias("c"), F.col("p").alias("q"), "r0", "r1")),
                    (F.col("column") == F.col("c")) & (F.col("p") == F.col("q")))
    at = lambda r: F.max(F.when((F.col("cum_m") <= F.col(r)) & (F.col(r) < F.col("cum_m") + F.col("m")), F.col("v")))
    found = j.groupBy("column", "p").agg(at("r0").alias("v0"), at("r1").alias("v1"))
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac"))
    return null_safe_join(need, found, ["column", "p"], "left").select("column", "p", value.alias("value"))
