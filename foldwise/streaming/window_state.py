"""Event-window features on a stream (stateful, per group).

``rowsBetween`` frames are not supported on streaming DataFrames, so the
window is kept as state: per group the last ``window_rows - 1`` events (the
context the next micro-batch needs) and the last time each event type was
seen.  ``applyInPandasWithState`` hands each group's new rows as pandas
frames; the features are computed vectorised (rolling sums over one-hot
types, forward fill of last-seen times), never row by row.  Output rows equal
:func:`foldwise.operators.windows.event_window_features` on the same events
when each group's events arrive in time order, or late within a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldwise.operators.windows import DEFAULT_WINDOW, ELAPSED_CAP

def state_schema(id_type: str) -> str:
    """Context and last-seen times of a group, and events that wait for the watermark."""
    return (f"buf_ts array<bigint>, buf_type array<string>, buf_id array<{id_type}>, last_ts array<bigint>, "
            f"wait_ts array<bigint>, wait_type array<string>, wait_id array<{id_type}>")


def output_schema(group_col: str, id_col: str, type_col: str, types: Sequence[str], group_type: str = "bigint",
                  id_type: str = "bigint") -> str:
    cols = [f"`{group_col}` {group_type}", f"`{id_col}` {id_type}", f"`{type_col}` string",
            "windowDuration double", "timeSinceLastSensorEvent double", "complexity double",
            "areaTransitions double"]
    cols += [f"`sensorCount-{t}` double" for t in types]
    cols += [f"`sensorElTime-{t}` double" for t in types]
    return ", ".join(cols)


def _features(frame: pd.DataFrame, n_ctx: int, types: Sequence[str], last0: np.ndarray, W: int,
              cap: float, ts_col: str, type_col: str) -> tuple[pd.DataFrame, np.ndarray]:
    ts = frame["__us"].to_numpy(dtype="int64")
    ty = frame[type_col].to_numpy()
    onehot = np.stack([(ty == t).astype("int64") for t in types], axis=1)
    counts = pd.DataFrame(onehot).rolling(W, min_periods=1).sum().to_numpy()
    first = pd.Series(ts).rolling(W, min_periods=1).min().to_numpy()
    prev = pd.Series(ts).shift(1).to_numpy()
    prev_ty = pd.Series(ty).shift(1)
    changed = (prev_ty.notna() & (prev_ty.to_numpy() != ty)).astype("int64")
    trans = pd.Series(changed).rolling(W - 1, min_periods=1).sum().to_numpy()
    n = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / n
        ent = np.where(counts > 0, -p * np.log(p), 0.0).sum(axis=1)
    out = {"windowDuration": (ts - first) / 1e6,
           "timeSinceLastSensorEvent": np.where(np.isnan(prev), 0.0, (ts - np.nan_to_num(prev)) / 1e6),
           "complexity": ent, "areaTransitions": trans.astype("float64")}
    last = np.empty((len(ts), len(types)))
    new_last = last0.copy()
    for j, t in enumerate(types):
        seen = pd.Series(np.where(ty == t, ts, np.nan)).ffill().to_numpy()
        seen = np.where(np.isnan(seen), np.where(last0[j] >= 0, last0[j], np.nan), seen)
        last[:, j] = seen
        if len(seen) and not np.isnan(seen[-1]):
            new_last[j] = int(seen[-1])
    for j, t in enumerate(types):
        out[f"sensorCount-{t}"] = counts[:, j].astype("float64")
        el = (ts - last[:, j]) / 1e6
        out[f"sensorElTime-{t}"] = np.where(np.isnan(el), cap, np.minimum(el, cap))
    res = pd.DataFrame(out).iloc[n_ctx:].reset_index(drop=True)
    return res, new_last


def stream_window_features(events: DataFrame, group_col: str, ts_col: str, id_col: str, type_col: str,
                           types: Sequence[str], window_rows: int = DEFAULT_WINDOW,
                           cap_seconds: float = ELAPSED_CAP, watermark: str | None = None,
                           expire_seconds: float | None = None) -> DataFrame:
    """Streaming (or batch) DataFrame of events -> per-event window features.  Groups and ids may be of any type.

    Without ``watermark`` events are taken in the order of the micro-batches.  With one (such as "10 minutes") an
    event waits in the state until the watermark has passed it, so events that come late, but within the delay, take
    their place in time; an event-time timer releases what waits when no further event of the group comes.  Later ones
    are dropped by Spark.  ``expire_seconds`` (with a watermark) forgets a group that long after its last event; it
    starts anew when it comes back, which only an expiry of at least ``cap_seconds`` leaves elapsed times unaffected by.
    """
    types = list(types)
    W = window_rows
    if expire_seconds is not None and watermark is None:
        raise ValueError("expiry needs a watermark")
    group_type, id_type = (events.schema[c].dataType.simpleString() for c in (group_col, id_col))

    def table(ts, kinds, ids) -> pd.DataFrame:
        return pd.DataFrame({"__us": pd.Series(list(ts), dtype="int64"), type_col: pd.Series(list(kinds), dtype=object),
                             id_col: pd.Series(list(ids), dtype=object)})

    def lists(frame: pd.DataFrame) -> tuple[list, list, list]:
        ids = [x.item() if hasattr(x, "item") else x for x in frame[id_col]]
        return frame["__us"].astype("int64").tolist(), frame[type_col].astype(str).tolist(), ids

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            buf_ts, buf_type, buf_id, last_ts, *wait = state.get
            ctx, waiting, last0 = table(buf_ts, buf_type, buf_id), table(*wait), np.array(last_ts, dtype="float64")
        else:
            ctx, waiting, last0 = table([], [], []), table([], [], []), np.full(len(types), -1.0)
        new = [table(pd.to_datetime(p[ts_col]).astype("datetime64[us]").astype("int64"), p[type_col], p[id_col]) for p in pdfs]
        events_ = pd.concat([waiting, *new], ignore_index=True).sort_values(["__us", id_col], kind="stable").reset_index(drop=True)
        passed = len(events_)
        if watermark is not None:
            now = state.getCurrentWatermarkMs()
            passed = int((events_["__us"] <= now * 1000).sum())
        ready, waiting = events_.iloc[:passed].reset_index(drop=True), events_.iloc[passed:]
        frame = pd.concat([ctx, ready], ignore_index=True)
        if passed:
            feats, last0 = _features(frame, len(ctx), types, last0, W, cap_seconds, ts_col, type_col)
        tail = frame.iloc[-(W - 1):] if W > 1 else frame.iloc[0:0]
        latest = int(max([*events_["__us"], *ctx["__us"], *[x for x in last0 if x >= 0]], default=0))
        gone = expire_seconds is not None and not len(waiting) and now * 1000 >= latest + expire_seconds * 1e6
        if gone:
            state.remove()
        else:
            state.update((*lists(tail), [int(x) for x in last0], *lists(waiting)))
            if len(waiting):
                state.setTimeoutTimestamp(max(now + 1, -(-int(waiting["__us"].iloc[0]) // 1000)))
            elif expire_seconds is not None:
                state.setTimeoutTimestamp(max(now + 1, int(latest // 1000 + expire_seconds * 1000)))
        if passed:
            head = pd.DataFrame({group_col: [key[0]] * passed, id_col: ready[id_col].to_numpy(), type_col: ready[type_col].to_numpy()})
            yield pd.concat([head, feats], axis=1)

    rows = events.select(group_col, ts_col, id_col, type_col)
    timeout = GroupStateTimeout.NoTimeout
    if watermark is not None:
        rows, timeout = rows.withWatermark(ts_col, watermark), GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(group_col).applyInPandasWithState(
        step, output_schema(group_col, id_col, type_col, types, group_type, id_type), state_schema(id_type), "append", timeout)
