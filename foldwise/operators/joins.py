"""Joins that keep rows with NULL keys.

The strategy is left to adaptive execution, which knows the measured bytes of
both sides: it broadcasts a lookup table that turns out small and splits the
hot partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named columns where NULL equals NULL; the left side's key columns stay."""
    keys = [on] if isinstance(on, str) else list(on)
    right = right.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__j_{k}`"))
    return left.join(right, same, how).drop(*[f"__j_{k}" for k in keys])


join_lookup = null_safe_join
