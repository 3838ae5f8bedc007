"""Feature queries: cyclic time, event-window features, interaction block."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import features as FE
from foldwise.functions.labels import map_labels
from foldwise.operators.windows import event_window_features
from foldwise.plans.catalog import query
from foldwise.plans.views import EVENT_TYPES, EVENTS_GENERAL_MAP, labelled_events
from foldwise.session import read_table

# Roles of event types in the interaction block (location -> event type).
ROLE_KEY = ["purchase", "view", "click", "signup", "error"]      # Kitchen, Bedroom, Bathroom, LivingRoom, OutsideDoor
ROLE_MAIN = ["purchase", "view", "click", "signup"]
ROLE_DOMINANCE = ["purchase", "view"]
ROLE_ELAPSED = ["click", "view", "purchase", "signup", "error"]  # Bathroom, Bedroom, Kitchen, LivingRoom, OutsideDoor
MOTION_TYPE = "click"


@query("cyclic_time", r"""
SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dow,
       round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos,
       round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS dow_sin,
       round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS dow_cos
FROM events""")
def q_cyclic_time(spark, sf_dir):
    ev = labelled_events(spark, sf_dir).select("event_id", "hour", "dow")
    cols = FE.cyclic_time_columns("hour", "dow")
    # "+ 0.0" turns a rounded -0.0 into 0.0 (same in the oracle)
    return ev.select("event_id", "hour", "dow", *[(F.round(v, 6) + F.lit(0.0)).alias(k) for k, v in cols.items()])


def window_features(spark, sf_dir, chunk_rows: int = 4096):
    ev = read_table(spark, sf_dir, "events").withColumn("general", map_labels("event_type", EVENTS_GENERAL_MAP))
    return event_window_features(ev.withColumnRenamed("user_id", "home_id"), "home_id", "ts", "event_id",
                                 "event_type", EVENT_TYPES, window_rows=30, chunk_rows=chunk_rows,
                                 motion_type=MOTION_TYPE, activity_col="general")


def window_features_sql(types=EVENT_TYPES, W=30, motion=MOTION_TYPE) -> str:
    counts = ",\n".join(f"    sum(CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END) OVER fr AS c_{i}"
                        for i, x in enumerate(types))
    lasts = ",\n".join(f"    max(CASE WHEN event_type = '{x}' THEN ts END) OVER up AS l_{i}"
                       for i, x in enumerate(types))
    cs = ", ".join(f"c_{i}" for i in range(len(types)))
    nsum = " + ".join(f"c_{i}" for i in range(len(types)))
    ent = " + ".join(f"CASE WHEN c_{i} > 0 THEN -(c_{i} / ({nsum})) * ln(c_{i} / ({nsum})) ELSE 0.0 END"
                     for i in range(len(types)))
    type_list = "[" + ", ".join(f"'{x}'" for x in types) + "]"
    mi = types.index(motion)
    cols = ",\n".join(
        [f'  CAST(c_{i} AS DOUBLE) AS "sensorCount-{x}"' for i, x in enumerate(types)]
        + [f'  coalesce(least((epoch_us(ts) - epoch_us(l_{i})) / 1e6, 86400.0), 86400.0) AS "sensorElTime-{x}"'
           for i, x in enumerate(types)])
    return rf"""
e AS (SELECT user_id AS home_id, event_id, ts, event_type, CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse'
  WHEN 'purchase' THEN 'convert' WHEN 'signup' THEN 'convert' ELSE event_type END AS general FROM events),
w1 AS (
  SELECT *,
{counts},
{lasts},
    min(ts) OVER fr AS first_ts,
    lag(ts) OVER o AS prev_ts,
    CASE WHEN lag(event_type) OVER o IS NOT NULL AND lag(event_type) OVER o <> event_type THEN 1 ELSE 0 END AS changed,
    CASE WHEN lag(general) OVER o IS NOT NULL AND lag(general) OVER o <> general THEN 1 ELSE 0 END AS switched
  FROM e
  WINDOW o AS (PARTITION BY home_id ORDER BY ts, event_id),
         fr AS (PARTITION BY home_id ORDER BY ts, event_id ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW),
         up AS (PARTITION BY home_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wd AS (SELECT *, list_position([{cs}], greatest({cs})) - 1 AS dominant FROM w1),
w2 AS (SELECT *, sum(changed) OVER s AS transitions, sum(switched) OVER s AS switches,
    lag(dominant) OVER o AS d1, lag(dominant, 2) OVER o AS d2 FROM wd
  WINDOW o AS (PARTITION BY home_id ORDER BY ts, event_id),
         s AS (PARTITION BY home_id ORDER BY ts, event_id ROWS BETWEEN {W - 2} PRECEDING AND CURRENT ROW)),
wf AS (
SELECT home_id, event_id, ts, event_type,
  hour(ts) AS "lastSensorEventHours",
  CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INTEGER) AS "lastSensorEventSeconds",
  isodow(ts) - 1 AS "lastSensorDayOfWeek",
  (epoch_us(ts) - epoch_us(first_ts)) / 1e6 AS "windowDuration",
  coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0.0) AS "timeSinceLastSensorEvent",
  CAST(list_position({type_list}, event_type) - 1 AS INTEGER) AS "lastSensorLocation",
  {ent} AS complexity,
  CAST(transitions AS DOUBLE) AS "areaTransitions",
  CAST(CASE WHEN c_{mi} > 0 THEN {mi} ELSE -1 END AS INTEGER) AS "lastMotionLocation",
  CAST(coalesce(d1, -1) AS INTEGER) AS "prevDominantSensor1", CAST(coalesce(d2, -1) AS INTEGER) AS "prevDominantSensor2",
  event_type AS "lastSensorID", CAST(switches > 0 AS INTEGER) AS "activityChange",
{cols}
FROM w2)"""


def _round_select(df, keep, digits=6):
    from pyspark.sql.types import DoubleType
    return df.select(*keep, *[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                              else F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in keep])


def _round_sql_cols(names_double, names_other):
    return ", ".join([f'"{c}"' for c in names_other] + [f'round("{c}", 6) AS "{c}"' for c in names_double])


_WF_DOUBLE = (["windowDuration", "timeSinceLastSensorEvent", "complexity", "areaTransitions"]
              + [f"sensorCount-{x}" for x in EVENT_TYPES] + [f"sensorElTime-{x}" for x in EVENT_TYPES])
_WF_OTHER = ["home_id", "event_id", "event_type", "lastSensorEventHours", "lastSensorEventSeconds",
             "lastSensorDayOfWeek", "lastSensorLocation", "lastMotionLocation", "prevDominantSensor1", "prevDominantSensor2",
             "lastSensorID", "activityChange"]


@query("window_features", "WITH " + window_features_sql().strip() + "\nSELECT "
       + _round_sql_cols(_WF_DOUBLE, _WF_OTHER) + " FROM wf")
def q_window_features(spark, sf_dir):
    """Last-30-event features per event: counts per type, seconds since each
    type (capped at one day), window span, gap, entropy, transitions."""
    wf = window_features(spark, sf_dir).drop("ts")
    return _round_select(wf, _WF_OTHER)


def _interaction_kw():
    return dict(key_locations=ROLE_KEY, main_locations=ROLE_MAIN, dominance=ROLE_DOMINANCE)


def _interaction_sql() -> str:
    parts = []
    for loc in ROLE_KEY:
        parts.append(f'"sensorCount-{loc}" * "lastSensorEventHours" AS "{loc}_x_hour"')
        parts.append(f'"sensorCount-{loc}" * "timeSinceLastSensorEvent" AS "{loc}_x_recency"')
    parts += ['complexity * "windowDuration" AS complexity_x_duration',
              '"areaTransitions" * complexity AS transitions_x_complexity',
              'CAST("lastSensorEventHours" >= 6 AND "lastSensorEventHours" < 12 AS INTEGER) AS is_morning',
              'CAST("lastSensorEventHours" >= 12 AND "lastSensorEventHours" < 18 AS INTEGER) AS is_afternoon',
              'CAST("lastSensorEventHours" >= 18 AND "lastSensorEventHours" < 22 AS INTEGER) AS is_evening',
              'CAST("lastSensorEventHours" >= 22 OR "lastSensorEventHours" < 6 AS INTEGER) AS is_night',
              'CAST("lastSensorDayOfWeek" >= 5 AS INTEGER) AS is_weekend']
    total = " + ".join(f'"sensorCount-{x}"' for x in ROLE_MAIN)
    parts.append(f"{total} AS total_main_activity")
    for x in ROLE_DOMINANCE:
        parts.append(f'"sensorCount-{x}" / ({total} + 1) AS {x}_dominance')
    parts += ['CAST("lastMotionLocation" <> -1 AS INTEGER) AS has_motion',
              'CAST("lastMotionLocation" = "lastSensorLocation" AS INTEGER) AS motion_matches_sensor',
              "least(" + ", ".join(f'"sensorElTime-{x}"' for x in ROLE_ELAPSED) + ") AS min_elapsed_time",
              " + ".join(f'CAST("sensorElTime-{x}" < 300 AS INTEGER)' for x in ROLE_ELAPSED)
              + " AS recent_active_locations"]
    return ",\n  ".join(parts)


_FI_INT = ["is_morning", "is_afternoon", "is_evening", "is_night", "is_weekend", "has_motion",
           "motion_matches_sensor", "recent_active_locations"]


def _fi_names():
    names = []
    for loc in ROLE_KEY:
        names += [f"{loc}_x_hour", f"{loc}_x_recency"]
    names += ["complexity_x_duration", "transitions_x_complexity", "is_morning", "is_afternoon", "is_evening",
              "is_night", "is_weekend", "total_main_activity"] + [f"{x}_dominance" for x in ROLE_DOMINANCE] + [
        "has_motion", "motion_matches_sensor", "min_elapsed_time", "recent_active_locations"]
    return names


@query("feature_interactions", "WITH " + window_features_sql().strip() + ",\nfi AS (SELECT home_id, event_id,\n  "
       + _interaction_sql() + "\nFROM wf)\nSELECT " + _round_sql_cols(
           [n for n in _fi_names() if n not in _FI_INT], ["home_id", "event_id"] + _FI_INT) + " FROM fi")
def q_feature_interactions(spark, sf_dir):
    wf = window_features(spark, sf_dir)
    cols = FE.interaction_columns(**_interaction_kw())
    cols.update(FE.elapsed_columns(locations=ROLE_ELAPSED))
    out = wf.select("home_id", "event_id", *[v.alias(k) for k, v in cols.items()])
    return _round_select(out, ["home_id", "event_id"] + _FI_INT)
