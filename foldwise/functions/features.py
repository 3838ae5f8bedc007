"""Derived window features as one projection (``withColumns``).

All expressions are built-in column functions, so the whole block stays in
one whole-stage-codegen span next to the scan.  Location names are
parameters; the defaults are the reference's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foldwise.schema import CONSTANT_FEATURES

# Location roles of the reference's interaction features.
KEY_LOCATIONS: list[str] = ["Kitchen", "Bedroom", "Bathroom", "LivingRoom", "OutsideDoor"]
MAIN_LOCATIONS: list[str] = ["Kitchen", "Bedroom", "Bathroom", "LivingRoom"]
DOMINANCE_LOCATIONS: list[str] = ["Kitchen", "Bedroom"]
ELAPSED_LOCATIONS: list[str] = ["Bathroom", "Bedroom", "Kitchen", "LivingRoom", "OutsideDoor"]
RECENT_SECONDS = 300
# day parts: morning [6,12), afternoon [12,18), evening [18,22), night >= 22 or < 6; weekend dow >= 5
DAY_PARTS = {"is_morning": (6, 12), "is_afternoon": (12, 18), "is_evening": (18, 22)}

HOUR, SECONDS, DOW = "lastSensorEventHours", "lastSensorEventSeconds", "lastSensorDayOfWeek"
DURATION, RECENCY = "windowDuration", "timeSinceLastSensorEvent"


def drop_constant_features(df: DataFrame, cols: Sequence[str] = CONSTANT_FEATURES) -> DataFrame:
    """Drop known constant columns; fails if one is absent (Spark's drop would ignore it)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def cyclic_time_columns(hour: str = HOUR, dow: str = DOW) -> dict[str, Column]:
    h = F.col(hour) * 2 * math.pi / 24
    d = F.col(dow) * 2 * math.pi / 7
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "dow_sin": F.sin(d), "dow_cos": F.cos(d)}


def add_cyclic_time_features(df: DataFrame, hour: str = HOUR, dow: str = DOW) -> DataFrame:
    return df.withColumns(cyclic_time_columns(hour, dow))


def interaction_columns(key_locations: Sequence[str] = KEY_LOCATIONS,
                        main_locations: Sequence[str] = MAIN_LOCATIONS,
                        dominance: Sequence[str] = DOMINANCE_LOCATIONS,
                        count_prefix: str = "sensorCount-", hour: str = HOUR, dow: str = DOW,
                        recency: str = RECENCY, duration: str = DURATION,
                        complexity: str = "complexity", transitions: str = "areaTransitions",
                        motion: str = "lastMotionLocation", sensor_loc: str = "lastSensorLocation") -> dict[str, Column]:
    cols: dict[str, Column] = {}
    for loc in key_locations:
        c = F.col(f"{count_prefix}{loc}")
        cols[f"{loc}_x_hour"] = c * F.col(hour)
        cols[f"{loc}_x_recency"] = c * F.col(recency)
    cols["complexity_x_duration"] = F.col(complexity) * F.col(duration)
    cols["transitions_x_complexity"] = F.col(transitions) * F.col(complexity)
    h = F.col(hour)
    for name, (lo, hi) in DAY_PARTS.items():
        cols[name] = ((h >= lo) & (h < hi)).cast("int")
    cols["is_night"] = ((h >= 22) | (h < 6)).cast("int")
    cols["is_weekend"] = (F.col(dow) >= 5).cast("int")
    total = None
    for loc in main_locations:
        c = F.col(f"{count_prefix}{loc}")
        total = c if total is None else total + c
    cols["total_main_activity"] = total
    for loc in dominance:
        # denominator is >= 1 for non-negative counts; try_divide keeps ANSI mode from raising otherwise
        cols[f"{loc.lower()}_dominance"] = F.try_divide(F.col(f"{count_prefix}{loc}"), total + 1)
    cols["has_motion"] = (F.col(motion) != -1).cast("int")
    cols["motion_matches_sensor"] = (F.col(motion) == F.col(sensor_loc)).cast("int")
    return cols


def add_feature_interactions(df: DataFrame, **kw) -> DataFrame:
    return df.withColumns(interaction_columns(**kw))


def elapsed_columns(locations: Sequence[str] = ELAPSED_LOCATIONS, prefix: str = "sensorElTime-",
                    recent_seconds: float = RECENT_SECONDS) -> dict[str, Column]:
    cs = [F.col(f"{prefix}{loc}") for loc in locations]
    recent = None
    for c in cs:
        # NULL counts as not recent (horizontal sums ignore NULL)
        term = F.coalesce((c < recent_seconds).cast("int"), F.lit(0))
        recent = term if recent is None else recent + term
    return {"min_elapsed_time": F.least(*cs), "recent_active_locations": recent}


def add_elapsed_time_features(df: DataFrame, **kw) -> DataFrame:
    return df.withColumns(elapsed_columns(**kw))


def preprocess_features(df: DataFrame, include_cyclic: bool = True, include_interactions: bool = True,
                        drop_constants: bool = True, grouping: bool = True) -> DataFrame:
    """Label grouping, constant drop, cyclic time, interactions, elapsed block."""
    from foldwise.functions.labels import apply_activity_grouping
    out = df
    if grouping:
        out = apply_activity_grouping(out)
    if drop_constants:
        out = drop_constant_features(out)
    cols: dict[str, Column] = {}
    if include_cyclic:
        cols.update(cyclic_time_columns())
    if include_interactions:
        cols.update(interaction_columns())
        cols.update(elapsed_columns())
    return out.withColumns(cols) if cols else out


def numeric_feature_columns(df: DataFrame, exclude: Sequence[str] = (), required: bool = True) -> list[str]:
    """Feature columns = numeric dtype minus the exclusion set (PRJ-4)."""
    excl = set(exclude)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in excl]
    if required and not cols:
        raise ValueError(f"none of the {len(df.columns)} columns is a numeric feature")
    return cols


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns added by a transform (schema set difference, metadata only)."""
    seen = set(before.columns)
    return [c for c in after.columns if c not in seen]
