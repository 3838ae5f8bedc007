"""Exact-size, reproducible samples.

``fraction`` of each group (or of the whole table) is drawn without
replacement: the ``floor(fraction * n)`` rows with the smallest
``md5(seed|group|id)`` key.  Unlike ``sampleBy`` (Bernoulli) the size is exact,
and unlike one window per group no task holds more than one key bucket of a
group, so a group holding a third of the table is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ranking import exact_top_k_per_group, hash_key


def _check_fraction(fraction: float) -> None:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")


def exact_group_sample(df: DataFrame, group_col: str, id_col: str, fraction: float,
                       seed: int = 42) -> DataFrame:
    """Per group: the floor(fraction * n_group) rows first in md5(seed|group|id) order."""
    _check_fraction(fraction)
    keyed = df.withColumn("__key", hash_key(seed, group_col, id_col))
    k = F.floor(F.lit(float(fraction)) * F.col("__group_n")).cast("bigint")
    return exact_top_k_per_group(keyed, [group_col], "__key", k, tie_cols=[id_col]).drop("__key")


def exact_global_sample(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """floor(fraction * n) rows first in md5(seed|id) order, over the whole table."""
    _check_fraction(fraction)
    keyed = df.withColumn("__key", hash_key(seed, id_col))
    k = F.floor(F.lit(float(fraction)) * F.col("__group_n")).cast("bigint")
    return exact_top_k_per_group(keyed, [], "__key", k, tie_cols=[id_col]).drop("__key")


def quick_subset(df: DataFrame, group_col: str, n_groups: int | None = None,
                 groups: list | None = None, fraction: float | None = None,
                 id_col: str | None = None, seed: int = 42) -> DataFrame:
    """Quick-run subset: an explicit group list or the first ``n_groups`` groups
    in sorted order, then optionally an exact global sample.

    ``fraction`` of 0 or None means "no sampling", like the reference's
    ``override or default``.
    """
    out = df
    if groups is not None:
        out = out.filter(F.col(group_col).isin(list(groups)))
    elif n_groups is not None:
        # at most n_groups rows (the limit is the size proof)
        first = (df.select(group_col).distinct().orderBy(group_col).limit(int(n_groups)))
        out = out.join(F.broadcast(first), group_col, "left_semi")
    if fraction:
        if id_col is None:
            raise ValueError("id_col is needed to sample")
        out = exact_global_sample(out, id_col, fraction, seed)
    return out
