"""Connected components of an edge table by alternating large and small stars.

Every step is a partial aggregate (the least neighbour of a node) and a join
on the node, so a node with very many edges is never gathered; the table is
checkpointed after each round, until it no longer changes.  A round's table is
kept in as many partitions as its rows ask for, so that the rounds over a
small table do not write a file for every pair of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import cut_lineage

PART_ROWS = 200_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """The table in a partition for every ``PART_ROWS`` rows, if it has more; no shuffle."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: equal only if the table is."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; root is the least
    node of the component.  Null ends and loops are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut_lineage(e.where("u != v").distinct())
    seen = _print(e)
    while seen[0]:
        e = compact(e, seen[0])
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(compact(small.union(least.select("k", "m")).distinct(), 2 * seen[0]))
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
