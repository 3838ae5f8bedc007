"""Sliding-window features built from raw events (the input the reference's
feature files were made from: one row per event, describing the last
``window_rows`` events of its group).

Skew: a window partitioned by group alone would put a hot group (say a third
of all events, or all of them within one minute) in one task.  Instead rows are
range-partitioned by (group, time, id), which Spark balances from a sample, and
written; every range also receives the rows just before it (a halo of a window
and two rows), even when those span several earlier ranges.  Row frames inside
a range then see exactly the rows a whole-group window would.  "Time since type
t" reaches back past the halo through a table of one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import cut_lineage

DEFAULT_WINDOW = 30
DEFAULT_CHUNK = 200_000
ELAPSED_CAP = 86400.0


def _seconds_between(later: Column, earlier: Column) -> Column:
    # timestamp_diff on TIMESTAMP_NTZ ignores the session time zone, so a
    # daylight-saving change never adds or removes an hour
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def event_window_features(df: DataFrame, group_col: str, ts_col: str, id_col: str, type_col: str,
                          types: Sequence[str], window_rows: int = DEFAULT_WINDOW,
                          chunk_rows: int = DEFAULT_CHUNK, cap_seconds: float = ELAPSED_CAP,
                          motion_type: str | None = None, count_prefix: str = "sensorCount-",
                          eltime_prefix: str = "sensorElTime-", bucket_format: str | None = None,
                          activity_col: str | None = None, sensor_col: str | None = None) -> DataFrame:
    """Per event: the last ``window_rows`` events of its group (ordered by
    time, then id) summarised as counts per type, span, gap, entropy and type
    changes, plus seconds since each type was last seen (capped); the most
    frequent type of the two windows before it (``prevDominantSensor1`` and
    ``2``: the place in ``types``, the first of equal ones, -1 without a
    window), the last sensor (``sensor_col``, the type if not given) and, with
    ``activity_col``, whether the activity changed inside the window.

    Plan: rows are range-partitioned into ranges of at most about
    ``chunk_rows`` rows, and no fewer than the shuffle's partitions.  Tables of
    one row per range hold its size, the ranges its last rows are context for,
    and, for the group it begins inside, the latest time of each type before.
    One shuffle by (range, group) evaluates the row frames, so no task holds
    more than one range and its halo.  ``bucket_format`` is accepted for
    earlier callers; ranges need no time buckets.
    """
    types = list(types)
    W, H = window_rows, window_rows + 1
    t, ts = F.col(type_col), F.col(ts_col)
    spark = df.sparkSession
    extra = {"__activity": activity_col, "__sensor": sensor_col}
    base = df.select(group_col, id_col, ts_col, type_col, *[F.col(c).alias(k) for k, c in extra.items() if c])
    order = [group_col, ts_col, id_col]
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // max(1, chunk_rows)))
    ranged = cut_lineage(base.repartitionByRange(n_ranges, *order).withColumn("__rb", F.spark_partition_id()))

    # ---- tables of ranges ----
    per = cut_lineage(ranged.groupBy(group_col, "__rb").agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(F.when(t == x, ts)).alias(f"__m_{i}") for i, x in enumerate(types)]))
    earlier = Window.partitionBy(group_col).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a range can have rows in earlier ranges: at most one row a range
    carry = per.select(F.col("__rb").alias("__c_rb"), F.col(group_col).alias("__c_group"), F.count(F.lit(1)).over(earlier).alias("__seen"),
                       *[F.max(f"__m_{i}").over(earlier).alias(f"__k_{i}") for i in range(len(types))]).filter("__seen > 0").drop("__seen")
    in_order = Window.orderBy("__rb")       # a row a range
    sizes = per.groupBy("__rb").agg(F.sum("__n").alias("__n")).withColumn(
        "__end", F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # a range holds at least one row, so what follows within H rows lies in the next H ranges
    ahead = F.collect_list(F.struct((F.col("__end") - F.col("__n")).alias("s"), F.col("__rb").alias("r"))).over(in_order.rowsBetween(1, H))
    targets = sizes.select("__rb", F.transform(F.filter(ahead, lambda x: x["s"] - F.col("__end") < H),
                                               lambda x: F.struct(x["r"].alias("r"), (x["s"] - F.col("__end")).alias("gap"))).alias("__to"))

    # ---- rows with their halos, one shuffle ----
    back = Window.partitionBy("__rb").orderBy(*[F.col(c).desc() for c in order])
    tails = ranged.withColumn("__j", F.row_number().over(back)).filter(F.col("__j") <= H)
    halo = tails.join(F.broadcast(targets), "__rb").withColumn("__x", F.explode("__to")).filter(F.col("__j") + F.col("__x.gap") <= H)
    columns = [c for c in ranged.columns if c != "__rb"]
    rows = ranged.select(*columns, F.col("__rb").alias("__part"), F.lit(True).alias("__own")).unionByName(
        halo.select(*columns, F.col("__x.r").alias("__part"), F.lit(False).alias("__own")))
    w = Window.partitionBy("__part", group_col).orderBy(ts_col, id_col)
    frame = w.rowsBetween(-(W - 1), 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    changed = lambda c: F.when(F.lag(c, 1).over(w).isNotNull() & (F.lag(c, 1).over(w) != c), 1).otherwise(0)
    stage1 = rows.withColumns({
        "__changed": changed(t),
        **({"__switched": changed(F.col("__activity"))} if activity_col else {}),
        "__first_ts": F.min(ts_col).over(frame),
        "__prev_ts": F.lag(ts_col, 1).over(w),
        **{f"__c_{i}": F.sum(F.when(t == x, 1).otherwise(0)).over(frame) for i, x in enumerate(types)},
        **{f"__l_{i}": F.max(F.when(t == x, ts)).over(upto) for i, x in enumerate(types)},
    })
    counts = F.array(*[F.col(f"__c_{i}") for i in range(len(types))])
    stage2 = stage1.withColumn("__dominant", (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))
    last_steps = w.rowsBetween(-(W - 2), 0) if W > 1 else w.rowsBetween(0, 0)
    stage2 = stage2.withColumns({
        "__transitions": F.sum("__changed").over(last_steps),
        **({"__switches": F.sum("__switched").over(last_steps)} if activity_col else {}),
        "__d1": F.lag("__dominant", 1).over(w), "__d2": F.lag("__dominant", 2).over(w)})
    own = stage2.filter("__own").join(F.broadcast(carry), (F.col("__part") == F.col("__c_rb")) &
                                      F.col(group_col).eqNullSafe(F.col("__c_group")), "left")

    n_frame = None
    for i in range(len(types)):
        n_frame = F.col(f"__c_{i}") if n_frame is None else n_frame + F.col(f"__c_{i}")
    entropy = None
    for i in range(len(types)):
        p = F.col(f"__c_{i}") / n_frame
        term = F.when(F.col(f"__c_{i}") > 0, -p * F.log(p)).otherwise(0.0)
        entropy = term if entropy is None else entropy + term
    cols: dict[str, Column] = {
        "lastSensorEventHours": F.hour(ts),
        "lastSensorEventSeconds": (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int"),
        "lastSensorDayOfWeek": F.weekday(ts),
        "windowDuration": _seconds_between(ts, F.col("__first_ts")),
        "timeSinceLastSensorEvent": F.coalesce(_seconds_between(ts, F.col("__prev_ts")), F.lit(0.0)),
        "lastSensorLocation": (F.array_position(F.array(*[F.lit(x) for x in types]), t) - 1).cast("int"),
        "complexity": entropy,
        "areaTransitions": F.col("__transitions").cast("double"),
        "prevDominantSensor1": F.coalesce("__d1", F.lit(-1)),
        "prevDominantSensor2": F.coalesce("__d2", F.lit(-1)),
        "lastSensorID": F.col("__sensor") if sensor_col else t,
    }
    if activity_col:
        cols["activityChange"] = (F.col("__switches") > 0).cast("int")
    if motion_type is not None:
        mi = types.index(motion_type)
        cols["lastMotionLocation"] = F.when(F.col(f"__c_{mi}") > 0, F.lit(mi)).otherwise(F.lit(-1)).cast("int")
    for i, x in enumerate(types):
        cols[f"{count_prefix}{x}"] = F.col(f"__c_{i}").cast("double")
        last = F.greatest(F.col(f"__l_{i}"), F.col(f"__k_{i}"))
        cols[f"{eltime_prefix}{x}"] = F.coalesce(F.least(_seconds_between(ts, last), F.lit(cap_seconds)),
                                                 F.lit(cap_seconds))
    return own.select(group_col, id_col, ts_col, type_col, *[v.alias(k) for k, v in cols.items()])
