"""Report formatting as column expressions (run tables, leaderboard)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.functions.labels import EXPECTED_CLASS_COUNTS, map_literal

NA = "N/A"
RUN_TS_FORMAT = "yyyyMMdd_HHmmss"

# Display titles of targets and APIs.
TARGET_TITLES: dict[str, str] = {"activity_general": "Generalized activities", "activity": "Specific activities"}
API_TITLES: dict[str, str] = {"native": "XGBoost native", "sklearn": "XGBoost sklearn"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_run_timestamp(x: Column | str) -> Column:
    """``yyyyMMdd_HHmmss`` -> timestamp; NULL when it does not parse."""
    return F.try_to_timestamp(_c(x).cast("string"), F.lit(RUN_TS_FORMAT))


def _finite(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def fmt_float(x: Column | str, ndigits: int = 4) -> Column:
    """NULL / NaN / inf / unparsable -> "N/A", else fixed ``ndigits`` decimals."""
    d = _c(x).try_cast("double")
    return F.when(_finite(d), F.format_string(f"%.{ndigits}f", d)).otherwise(F.lit(NA))


def fmt_int(x: Column | str) -> Column:
    d = _c(x).try_cast("double")
    return F.when(_finite(d), d.cast("bigint").cast("string")).otherwise(F.lit(NA))


def fmt_fraction(x: Column | str) -> Column:
    """Three decimals with trailing zeros and a trailing dot removed."""
    d = _c(x).try_cast("double")
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", d), "0+$", ""), r"\.$", "")
    return F.when(_finite(d), s).otherwise(F.lit(NA))


def pretty_api(api: Column | str) -> Column:
    a = _c(api).cast("string")
    return F.coalesce(F.element_at(map_literal(API_TITLES), a), a, F.lit("Unknown"))


def pretty_target(target: Column | str, n_classes: Column | str) -> Column:
    t = _c(target).cast("string")
    label = F.coalesce(F.element_at(map_literal(TARGET_TITLES), t), t, F.lit("Unknown target"))
    n = fmt_int(n_classes)
    return F.when(n != F.lit(NA), F.concat(label, F.lit(" ("), n, F.lit(" classes)"))).otherwise(label)


def expected_class_count(target: Column | str) -> Column:
    """Target -> expected class count (NULL when unknown)."""
    m = F.create_map(*[v for k, n in sorted(EXPECTED_CLASS_COUNTS.items()) for v in (F.lit(k), F.lit(n))])
    return F.element_at(m, _c(target).cast("string"))


def first_present(*cols: Column) -> Column:
    """Python ``a or b``: the first value that is neither NULL nor zero/empty."""
    out = None
    for c in reversed(cols):
        truthy = c.isNotNull() & (c.cast("string") != F.lit("0")) & (c.cast("string") != F.lit(""))
        out = F.when(truthy, c) if out is None else F.when(truthy, c).otherwise(out)
    return out
