import os
import shutil

from pyspark.sql import functions as F

from foldwise.operators.windows import event_window_features
from foldwise.plans.views import EVENT_TYPES
from foldwise.streaming.window_state import stream_window_features

SF = "/root/testdata/sf0.001/events.parquet"


def _ev(spark):
    return spark.read.parquet(SF).withColumnRenamed("user_id", "home_id")


def _feat(spark, chunk):
    return event_window_features(_ev(spark), "home_id", "ts", "event_id", "event_type", EVENT_TYPES,
                                 window_rows=5, chunk_rows=chunk, motion_type="click")


def test_chunked_equals_unchunked(spark):
    a = _feat(spark, 6)      # many chunks and halos per group
    b = _feat(spark, 100000)  # one chunk per group
    assert a.count() == b.count() == _ev(spark).count()
    assert a.exceptAll(b).count() == 0


def test_stream_matches_batch(spark, tmpdir_path):
    ev = _ev(spark)
    src = f"{tmpdir_path}/events_stream"
    # three time-ordered slices arrive as three micro-batches
    bounds = ev.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.66])
                       .alias("q")).first().q
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [ev.filter(us <= bounds[0]), ev.filter((us > bounds[0]) & (us <= bounds[1])), ev.filter(us > bounds[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{src}/part{i}")
        for f in os.listdir(f"{src}/part{i}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{src}/part{i}/{f}", f"{src}/batch_{i}.parquet")
    stream_in = f"{src}/in"
    os.makedirs(stream_in)
    for i in range(3):
        shutil.copy(f"{src}/batch_{i}.parquet", f"{stream_in}/batch_{i}.parquet")
    sdf = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(stream_in)
    out = stream_window_features(sdf, "home_id", "ts", "event_id", "event_type", EVENT_TYPES, window_rows=5)
    q = (out.writeStream.format("memory").queryName("wf_stream").outputMode("append")
         .option("checkpointLocation", f"{src}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("wf_stream")
    batch = _feat(spark, 100000).select(*got.columns)
    cols = [F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in got.dtypes]
    g = got.select(*cols)
    b = batch.select(*cols)
    assert g.count() == b.count()
    assert g.exceptAll(b).count() == 0


def test_huge_bucket_makes_tiny_chunks(spark):
    # one hour-sized bucket holds many rows, so chunks right after it are tiny
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = []
    eid = 0
    for m in range(40):
        n = 25 if m == 3 else 1
        for j in range(n):
            rows.append((eid, base + dt.timedelta(minutes=m, seconds=j), 1, ["a", "b", "c"][eid % 3]))
            eid += 1
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, home_id bigint, event_type string")
    a = event_window_features(df, "home_id", "ts", "event_id", "event_type", ["a", "b", "c"], window_rows=6,
                              chunk_rows=6)
    b = event_window_features(df, "home_id", "ts", "event_id", "event_type", ["a", "b", "c"], window_rows=6,
                              chunk_rows=100000)
    assert a.count() == b.count() == len(rows)
    assert a.exceptAll(b).count() == 0


def test_auto_bucket_matches_minute_bucket(spark):
    a = event_window_features(_ev(spark), "home_id", "ts", "event_id", "event_type", EVENT_TYPES,
                              window_rows=5, chunk_rows=6, motion_type="click", bucket_format=None)
    b = _feat(spark, 100000)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_all_events_within_seconds_and_null_groups(spark):
    import datetime as dt
    import random
    r = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i % 4), r.choice(["hot", "hot", "hot", None, "cold"]), r.choice("abc"), r.choice("xy")) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, home_id string, event_type string, activity string")
    W, types = 6, ["a", "b", "c"]
    got = {x["event_id"]: x for x in event_window_features(df, "home_id", "ts", "event_id", "event_type", types, window_rows=W, chunk_rows=7,
                                                           activity_col="activity", sensor_col="activity").collect()}
    assert len(got) == len(rows)
    for home in ("hot", "cold", None):
        seq = sorted((x for x in rows if x[2] == home), key=lambda x: (x[1], x[0]))
        dominant = []
        for i, x in enumerate(seq):
            window, out = seq[max(0, i - W + 1):i + 1], got[x[0]]
            n = [sum(y[3] == t for y in window) for t in types]
            assert [out[f"sensorCount-{t}"] for t in types] == n
            assert out["prevDominantSensor1"] == (dominant[-1] if i else -1) and out["prevDominantSensor2"] == (dominant[-2] if i > 1 else -1)
            assert out["activityChange"] == int(any(a[4] != b[4] for a, b in zip(window, window[1:]))) and out["lastSensorID"] == x[4]
            for t in types:
                seen = [y[1] for y in seq[:i + 1] if y[3] == t]
                assert out[f"sensorElTime-{t}"] == ((x[1] - seen[-1]).total_seconds() if seen else 86400.0)
            dominant.append(n.index(max(n)))


def test_late_events_string_homes_and_idle_homes(spark, tmpdir_path):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    kinds = ["a", "b", "c"]
    row = lambda i, m, home: (f"e{i:03d}", at(m), home, kinds[i % 3])
    batches = [[row(i, i, "h1") for i in range(0, 10)] + [row(20, 1, "idle")],
               [row(10, 12, "h1"), row(11, 7, "h1"), row(12, 6.5, "h1")],           # two come late, within the delay
               [row(13, 40, "h1"), row(21, 41, "h2")],                              # moves the watermark on
               [row(14, 15, "h1"), row(15, 300, "h1")],                             # the first is too late and is dropped
               [row(16, 600, "h1")]]
    schema = "event_id string, ts timestamp, home_id string, event_type string"
    src, q = f"{tmpdir_path}/in", None
    os.makedirs(src)
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_window_features(sdf, "home_id", "ts", "event_id", "event_type", kinds, window_rows=4, watermark="10 minutes", expire_seconds=3600)
    q = out.writeStream.format("memory").queryName("wf_late").outputMode("append").option("checkpointLocation", f"{tmpdir_path}/ckpt").start()
    held = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmpdir_path}/b{i}")
        name = next(f for f in os.listdir(f"{tmpdir_path}/b{i}") if f.endswith(".parquet"))
        shutil.copy(f"{tmpdir_path}/b{i}/{name}", f"{src}/b{i}.parquet")
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert held[0] == 2 and held[-1] == 1       # idle homes are forgotten
    seen = [r for b in batches for r in b if r[0] not in ("e014", "e016")]       # dropped; not passed by the watermark yet
    got = spark.table("wf_late")
    df = spark.createDataFrame(seen, schema)
    batch = event_window_features(df, "home_id", "ts", "event_id", "event_type", kinds, window_rows=4).select(*got.columns)
    cols = [F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in got.dtypes]
    g, b = (sorted(map(tuple, x.select(*cols).collect())) for x in (got, batch))
    assert [r[:3] for r in g] == [r[:3] for r in b] and g == b
