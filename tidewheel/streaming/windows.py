"""Structured Streaming counterparts of resampling, drive splitting and compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.functions.dates import micros


def resampled(stream: DataFrame, time_col: str, freq: str, aggs: dict[str, Column], keys: list[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows; rows later than `late` are dropped by the watermark."""
    at = F.window(time_col, freq, slide) if slide else F.window(time_col, freq)
    out = stream.withWatermark(time_col, late).groupBy(at, *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("bin"), *keys, *aggs)


def sessions(stream: DataFrame, time_col: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row per key and session, closed after a gap without rows."""
    out = stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def compressed(stream: DataFrame, key: str, time_col: str, value: str, dev: float, idle_seconds: float | None = None, late: str = "10 minutes") -> DataFrame:
    """Swinging-door compression over a stream: key, t (microseconds), v of kept points; the open door is the state.

    Rows of a key are put in order within each micro-batch; later ones than the door's last point are skipped. With
    idle_seconds a key that has no rows for that time of the stream (its watermark, `late` behind the newest row) ends:
    its last point is kept and its state dropped, and a row after that begins a new series.
    """
    idle_ms = None if idle_seconds is None else int(idle_seconds * 1000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            t0, _, t1, v1, _, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "t": [t1], "v": [float(v1)]}).iloc[: int(t1 > t0)]
            return
        rows = pd.concat(list(frames)).dropna(subset=["t", "v"]).sort_values("t", kind="stable")
        t0, v0, t1, v1, hi, lo = state.get if state.exists else (None, None, None, None, -np.inf, np.inf)
        kept = []
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
            if t0 is None:
                t0, v0, t1, v1 = t, v, t, v
                kept.append((t, v))
            elif t > t1:
                a, b = (v - v0 - dev) / (t - t0), (v - v0 + dev) / (t - t0)
                hi, lo = max(hi, a), min(lo, b)
                if hi > lo:
                    if t1 > t0:
                        kept.append((t1, v1))
                    t0, v0 = t1, v1
                    hi, lo = (v - v0 - dev) / (t - t0), (v - v0 + dev) / (t - t0)
                t1, v1 = t, v
        if t0 is not None:
            state.update((t0, v0, t1, v1, float(hi), float(lo)))
            if idle_ms is not None:
                state.setTimeoutTimestamp(max(t1 // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [group[0]] * len(kept), "t": [k[0] for k in kept], "v": [float(k[1]) for k in kept]})

    timed = stream if idle_ms is None else stream.withWatermark(time_col, late)
    rows = timed.select(key, *([time_col] if idle_ms is not None else []), micros(F.col(time_col)).alias("t"), F.col(value).cast("double").alias("v"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t long, v double", "t0 long, v0 double, t1 long, v1 double, hi double, lo double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout)
