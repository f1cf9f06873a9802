"""Swinging-door compression of long series: chunks run at once on guessed states, and again only where the guess was wrong.

The state that a chunk needs is a pivot, two slopes and the row before; a wrong one is forgotten at the first point that
both runs keep. So every chunk starts as if it were the series' first, then takes over the state that its predecessor
ends with, round by round, until no chunk's start changes: two or three rounds for most data, as many as chunks at worst.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import micros
from tidewheel.operators import chunks
from tidewheel.operators.blocks import saved

STATE = "array<double>"  # pivot's time and value, upper and lower slope, whether the row before is the pivot, its time, value and number


def run_doors(t: np.ndarray, v: np.ndarray, k: np.ndarray, dev: float, state: list[float] | None) -> tuple[list[int], list[float]]:
    """Numbers of the rows kept, and the state after the last row; without a state the first row begins a series."""
    kept: list[int] = []
    if state is None:
        kept.append(int(k[0]))
        pt, pv, hi, lo, fresh, bt, bv, bk = t[0], v[0], -np.inf, np.inf, True, t[0], v[0], int(k[0])
        t, v, k = t[1:], v[1:], k[1:]
    else:
        pt, pv, hi, lo, fresh, bt, bv, bk = *state[:4], bool(state[4]), state[5], state[6], int(state[7])
    for a, x, n in zip(t.tolist(), v.tolist(), k.tolist(), strict=True):
        dt = a - pt
        if dt:
            hi, lo = max(hi, (x - pv - dev) / dt), min(lo, (x - pv + dev) / dt)
            if hi > lo:
                if not fresh:
                    kept.append(bk)
                pt, pv = bt, bv
                dt = a - pt
                hi, lo = ((x - pv - dev) / dt, (x - pv + dev) / dt) if dt else (-np.inf, np.inf)
        fresh, bt, bv, bk = False, a, x, n
    return kept, [float(z) for z in (pt, pv, hi, lo, fresh, bt, bv, bk)]


def deviations(rows: DataFrame, mode: str) -> DataFrame:
    """_s, _dev: the deviation that series.deviation takes from each series' slopes, over chunks."""
    c = chunks.Chunks(["_s"])
    here = F.struct("_t", "_v")
    rows = c.carried(rows, {"_tail": chunks.first_last(here, True)}, {"_before": F.lag("_tail").over(c.next_to)})
    before = F.coalesce(F.lag(here).over(c.rows), F.col("_before"))
    rows = rows.withColumn("_b", before).where("_b is not null")
    slope = F.abs(F.coalesce(F.try_divide(F.col("_v") - F.col("_b._v"), F.col("_t") - F.col("_b._t")), F.lit(0.0)))
    slopes = rows.select("_s", "_k", slope.alias("_d"))
    ways = {
        "zmean": F.avg(F.when(F.col("_d") != 0, F.col("_d"))),
        "range": (F.max("_d") + F.min("_d")) / 2,
        "second": F.min_by("_d", F.when(F.col("_k") > F.col("_first"), F.col("_k"))),
        "mean": F.avg("_d"),
    }
    if mode == "second":
        first = slopes.groupBy("_s").agg(F.min("_k").alias("_first"))
        slopes = slopes.join(first, "_s")
    return slopes.groupBy("_s").agg(F.coalesce(ways.get(mode, ways["mean"]), F.lit(0.0)).alias("_dev"))


def compress_long(df: DataFrame, keys: list[str], time_col: str, value: str, mode: str = "zmean", dev: float | None = None, keep_last: bool = False, ties: list[str] = ()) -> DataFrame:
    """series.compress over chunks."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.withColumn("_s", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    base = chunks.numbered(rows, ["_s"], time_col, *ties)
    timed = dict(df.dtypes)[time_col].startswith(("timestamp", "date"))
    at = micros(F.col(time_col)) if timed else F.col(time_col).cast("double")
    since = base.groupBy("_s").agg(F.min(at).alias("_t0"))
    lean = base.join(since, "_s").select("_s", "_chunk", "_k", ((at - F.col("_t0")) / 1e6 if timed else at).alias("_t"), F.col(value).cast("double").alias("_v"))
    lean = lean.withColumn("_dev", F.lit(float(dev))) if dev is not None else lean.join(deviations(lean, mode), "_s", "left").withColumn("_dev", F.coalesce("_dev", F.lit(0.0)))
    lean = saved(lean, "doors")
    schema = f"_s string, _chunk int, used {STATE}, kept array<bigint>, out {STATE}"

    def run(key: tuple, part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(start):
            return pd.DataFrame([], columns=["_s", "_chunk", "used", "kept", "out"])
        part, used = part.sort_values("_k"), start["used"].iloc[0]
        used = None if used is None else [float(x) for x in used]
        kept, out = run_doors(part["_t"].to_numpy(), part["_v"].to_numpy(), part["_k"].to_numpy(), float(part["_dev"].iloc[0]), used)
        return pd.DataFrame({"_s": [key[0]], "_chunk": [key[1]], "used": [used], "kept": [kept], "out": [out]})

    def judged(starts: DataFrame) -> DataFrame:
        asked = lean.join(starts.select("_s", "_chunk"), ["_s", "_chunk"], "left_semi")
        starts = starts.select(*(F.col(c).alias(c) for c in starts.columns))
        return asked.groupBy("_s", "_chunk").cogroup(starts.groupBy("_s", "_chunk")).applyInPandas(run, schema)

    done = saved(judged(lean.select("_s", "_chunk").distinct().withColumn("used", F.lit(None).cast(STATE))), "door-states")
    while True:
        before = F.lag("out").over(Window.partitionBy("_s").orderBy("_chunk"))  # a row per chunk
        wrong = done.withColumn("_want", before).where(~F.col("_want").eqNullSafe(F.col("used"))).select("_s", "_chunk", F.col("_want").alias("used"))
        if not wrong.head(1):
            break
        again = saved(judged(saved(wrong, "door-starts")), "door-again")
        done = saved(done.join(again.select("_s", "_chunk"), ["_s", "_chunk"], "left_anti").unionByName(again), "door-states")
    kept = done.select(F.explode("kept").alias("_k"))
    if keep_last:
        kept = kept.unionByName(lean.groupBy("_s").agg(F.max("_k").alias("_k")).select("_k"))
    return base.join(kept.distinct(), "_k", "left_semi").select(*df.columns)
