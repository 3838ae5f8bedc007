"""Driver tables seen through the reference's data model.

The reference works on labelled window rows: a group (home), a raw activity
label, time-of-day columns and numeric features.  The driver ships no sensor
CSV, so the same operators run over ``events``:

* group ``home_id``   = ``user_id``
* raw label ``activity`` = ``event_type``, with a resident prefix on some rows
  (``r1.`` when ``event_id % 10 = 0``, ``r2.`` when ``= 5``) so the prefix
  cleanup has work to do; every row is kept
* catch-all label = ``error``; general map: click, view -> browse;
  purchase, signup -> convert
* hour / day-of-week (Monday = 0) from ``ts``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import read_table

# Fixed values of the events mapping (mirrored in the oracle SQL).
EVENTS_GENERAL_MAP: dict[str, str] = {
    "click": "browse",
    "view": "browse",
    "purchase": "convert",
    "signup": "convert",
}
EVENTS_CATCH_ALL = "error"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def raw_activity(event_id: str = "event_id", event_type: str = "event_type"):
    m = F.col(event_id) % 10
    return (F.when(m == 0, F.concat(F.lit("r1."), F.col(event_type)))
             .when(m == 5, F.concat(F.lit("r2."), F.col(event_type)))
             .otherwise(F.col(event_type)))


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (event_id, ts, home_id, activity, value, props, hour, dow)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts",
        F.col("user_id").alias("home_id"),
        raw_activity().alias("activity"),
        "value", "props",
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("dow"),
    )
