"""Algorithms that walk a series in order: compression, smoothing, decomposition, adaptive binning.

Each takes one series per group to one Arrow batch (applyInPandas); a series is an asset, a drive, a sensor,
so it has to fit in a task; impute_pattern alone deals gaps. Cut longer ones by session (operators.events.sessions) first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import micros
from tidewheel.operators import chunks
from tidewheel.operators.blocks import saved


def deviation(t: np.ndarray, v: np.ndarray, mode: str = "zmean") -> float:
    """Compression deviation from absolute slopes: mean, zmean (mean of those not 0), range (mid-range), second (the second slope)."""
    dt = np.diff(t)
    slope = np.abs(np.divide(np.diff(v), dt, out=np.zeros(len(dt)), where=dt != 0))
    if not len(slope):
        return 0.0
    if mode == "zmean":
        slope = slope[slope != 0]
        return float(slope.mean()) if len(slope) else 0.0
    if mode == "range":
        return float((slope.max() + slope.min()) / 2)
    if mode == "second":
        return float(slope[1]) if len(slope) > 1 else 0.0
    return float(slope.mean())


def swinging_door(t: np.ndarray, v: np.ndarray, dev: float, last: bool = False) -> np.ndarray:
    """Indices kept: the first point, and the last one before the doors from the pivot open wider than parallel."""
    if not len(t):
        return np.zeros(0, np.int64)
    kept, pivot, hi, lo = [0], 0, -np.inf, np.inf
    for i in range(1, len(t)):
        dt = t[i] - t[pivot]
        if dt == 0:
            continue
        hi, lo = max(hi, (v[i] - v[pivot] - dev) / dt), min(lo, (v[i] - v[pivot] + dev) / dt)
        if hi > lo:
            if i - 1 != pivot:
                kept.append(i - 1)
            pivot = kept[-1] if i - 1 != pivot else i - 1
            dt = t[i] - t[pivot]
            hi, lo = ((v[i] - v[pivot] - dev) / dt, (v[i] - v[pivot] + dev) / dt) if dt else (-np.inf, np.inf)
    if last and kept[-1] != len(t) - 1:
        kept.append(len(t) - 1)
    return np.array(kept, np.int64)


def _seconds(at: pd.Series, since: pd.Series) -> np.ndarray:
    """Seconds from the first of `since`; numbers are taken as they are."""
    if not str(at.dtype).startswith("datetime"):
        return at.to_numpy(float)
    us = lambda s: s.astype("datetime64[us]").astype("int64").to_numpy()
    return (us(at) - us(since)[0]) / 1e6 if len(at) else np.zeros(0)


def compress(df: DataFrame, keys: list[str], time_col: str, value: str, mode: str = "zmean", dev: float | None = None, keep_last: bool = False, ties: list[str] = ()) -> DataFrame:
    """The rows that swinging-door compression keeps of each group; long tables go over chunks. `ties` order rows of one time."""
    schema = df.schema
    if chunks.is_long(df):
        from tidewheel.operators.doors import compress_long

        return compress_long(df, keys, time_col, value, mode, dev, keep_last, ties)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[value]).sort_values([time_col, *ties], kind="stable")
        t, v = _seconds(rows[time_col], rows[time_col]), rows[value].to_numpy(float)
        return rows.iloc[swinging_door(t, v, deviation(t, v, mode) if dev is None else dev, keep_last)]

    return df.groupBy(*keys).applyInPandas(run, schema)


def compression_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(after.agg(F.count(F.lit(1)).alias("rows_after"))).withColumn("ratio", F.try_divide(F.col("rows_before"), F.col("rows_after")))


def reconstruction_error(df: DataFrame, kept: DataFrame, keys: list[str], time_col: str, value: str) -> DataFrame:
    """RMSE per group of the kept points, joined by straight lines in time, against the original."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.dropna(subset=[value]).sort_values(time_col), b.sort_values(time_col)
        x, y = (_seconds(f[time_col], a[time_col]) for f in (a, b))
        e = np.interp(x, y, b[value].to_numpy(float)) - a[value].to_numpy(float) if len(b) else np.zeros(0)
        return pd.DataFrame([[*key, float(np.sqrt(np.mean(e**2))) if len(e) else None]], columns=[*keys, "rmse"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    return df.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInPandas(run, f"{fields}, rmse double")


def savitzky_golay(v: np.ndarray, window: int, degree: int = 2) -> np.ndarray:
    """Local polynomial at each point; the ends take the values of the end windows' polynomials."""
    window = min(window, len(v) if len(v) % 2 else len(v) - 1)
    if window <= degree:
        return v.astype(float)
    half = window // 2
    x = np.arange(-half, half + 1)
    basis = np.vander(x, degree + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.convolve(v, fit[0][::-1], "same").astype(float)
    out[:half] = (basis @ (fit @ v[:window]))[:half]
    out[-half:] = (basis @ (fit @ v[-window:]))[-half:]
    return out


def gaussian(v: np.ndarray, window: int) -> np.ndarray:
    """Gaussian smoothing with reflected ends, sigma ((window-1)/2 - 0.5) / 4."""
    sigma = max(1e-6, ((window - 1) / 2 - 0.5) / 4)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, r, "symmetric"), w / w.sum(), "valid") if r else v.astype(float)


def smooth(df: DataFrame, keys: list[str], time_col: str, value: str, method: str = "savgol", window: int = 11, out: str = "smooth") -> DataFrame:
    """Each group's series smoothed; long tables are cut in parts with a window's rows of their neighbours around."""
    fn = {"savgol": savitzky_golay, "gaussian": gaussian}[method]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    if chunks.is_long(df):

        def part(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_i")
            return rows.assign(**{out: fn(rows[value].to_numpy(float), window)})[rows["_mine"]].drop(columns=["_i", "_part", "_mine"])

        return chunks.with_halos(df, time_col, keys, window).groupBy(*keys, "_part").applyInPandas(part, f"{fields}, {out} double")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time_col, kind="stable")
        return rows.assign(**{out: fn(rows[value].to_numpy(float), window)})

    return df.groupBy(*keys).applyInPandas(run, f"{fields}, {out} double")


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits with tricube weights over the `span` nearest points."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    w0 = np.ones(n) if weights is None else weights
    q = min(span, n)
    start = np.clip(np.round(at - (q - 1) / 2).astype(int), 0, n - q)
    idx = start[:, None] + np.arange(q)
    d = np.abs(x[idx] - at[:, None])
    h = d.max(1, keepdims=True) * max(1.0, span / n) + 1e-9
    w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * w0[idx]
    sw = w.sum(1)
    sw[sw == 0] = 1e-12
    mx, my = (w * x[idx]).sum(1) / sw, (w * y[idx]).sum(1) / sw
    dx = x[idx] - mx[:, None]
    var = (w * dx**2).sum(1)
    slope = np.where(var > 1e-12, (w * dx * y[idx]).sum(1) / np.where(var > 1e-12, var, 1), 0)
    return my + slope * (at - mx)


def stl(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, robust: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by LOESS, cycle positions smoothed one by one."""
    n = len(y)
    trend, season, rw = np.zeros(n), np.zeros(n), np.ones(n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for outer in range(robust + 1):
        for _ in range(inner):
            part = y - trend
            cycle = np.zeros(n + 2 * period)
            for k in range(min(period, n)):
                c = part[k::period]
                cycle[k::period] = loess(c, seasonal, rw[k::period], np.arange(-1, len(c) + 1, dtype=float))[: len(cycle[k::period])]
            low = cycle
            for width in (period, period, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = cycle[period : period + n] - loess(low[:n], period | 1)
            trend = loess(y - season, span, rw)
        if outer < robust:
            r = np.abs(y - trend - season)
            u = r / max(1e-12, 6 * np.median(r))
            rw = np.clip(1 - u**2, 0, None) ** 2
    return trend, season, y - trend - season


def decompose(df: DataFrame, keys: list[str], time_col: str, value: str, period: int) -> DataFrame:
    """Each group's series with trend, seasonal and residual; nulls are filled by interpolation first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time_col, kind="stable")
        y = rows[value].astype(float).interpolate(limit_direction="both").fillna(0.0).to_numpy()
        t, s, r = stl(y, period) if len(y) >= 2 * period else (y, y * 0, y * 0)
        return rows[[*keys, time_col, value]].assign(trend=t, seasonal=s, residual=r)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, time_col, value]) + ", trend double, seasonal double, residual double")


def adaptive_bins(y: np.ndarray, power: float = 0.5) -> list[int]:
    """Split points of a series that raise the value of its parts: V = mean(((peak - first)(peak - x))^power)."""

    def value(a: int, b: int) -> float:
        x = y[a:b]
        peak = np.maximum.accumulate(x)
        return float(np.mean(np.maximum((peak - x[0]) * (peak - x), 0) ** power))

    out: list[int] = []
    todo = [(0, len(y))]
    while todo:
        a, b = todo.pop()
        if b - a < 3:
            continue
        halves = [(value(a, k + 1) + value(k, b), k) for k in range(a + 1, b - 1)]
        best, k = max(halves, key=lambda h: (h[0], -h[1]))
        if best > value(a, b):
            out.append(k)
            todo += [(a, k + 1), (k, b)]
    return sorted(set(out))


def split_points(df: DataFrame, keys: list[str], time_col: str, value: str, power: float = 0.5) -> DataFrame:
    """Per group, the row numbers at which adaptive_bins splits its series."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(time_col, kind="stable")[value].dropna().to_numpy(float)
        return pd.DataFrame([[*key, k] for k in adaptive_bins(y, power)], columns=[*keys, "split"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", split int")


def seasonal_forecast(y: np.ndarray, steps: int, period: int = 24) -> np.ndarray:
    """Differenced and seasonally differenced series with a seasonal AR(1) and MA-like shrinkage, forecast `steps` ahead."""
    if len(y) < 2 * period + 2:
        return np.repeat(y[-1] if len(y) else 0.0, steps)
    d = np.diff(y)
    w = d[period:] - d[:-period]
    x, z = w[:-period], w[period:]
    phi = float(np.clip(x @ z / (x @ x), -0.99, 0.99)) if len(x) > 2 and x @ x > 0 else 0.0
    w, d, out = list(w), list(d), [float(y[-1])]
    for _ in range(steps):
        w.append(phi * w[-period] if len(w) >= period else 0.0)
        d.append(d[-period] + w[-1])
        out.append(out[-1] + d[-1])
    return np.array(out[1:])


def impute_pattern(df: DataFrame, keys: list[str], time_col: str, value: str, every: int = 3600, period: int = 24, train: int = 360) -> DataFrame:
    """df with its gaps filled by a seasonal forecast from the `train` steps before each, and imputed, whether a value is.

    Rows are a grid of `every` seconds. Known values of the steps before a gap are joined by interpolation where earlier
    gaps part them; a gap with none before it stays null, and so do rows of a null key. Each gap is a group of its own
    with its bounded past, so a series need not fit in a task.
    """
    rows = df.withColumns({"_i": F.floor(micros(F.col(time_col)) / (every * 1_000_000)).cast("long"), "_v": F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))})
    w = Window.partitionBy(*keys).orderBy("_i")
    opens = F.col("_v").isNull() & F.coalesce(F.lag(F.col("_v").isNotNull()).over(w), F.lit(True))
    marked = rows.select(*keys, "_i", "_v", opens.alias("_o")).withColumn("_gap", F.max(F.when(F.col("_o"), F.col("_i"))).over(w))
    marked = saved(marked.drop("_o"), "gaps")  # read twice; sorted once
    asked = marked.where("_v is null").select(*keys, "_gap", "_i").distinct()
    block = lambda i: F.floor(i / train).cast("long")
    gaps = asked.select(*keys, "_gap").distinct().withColumn("_block", F.explode(F.array(block(F.col("_gap") - 1), block(F.col("_gap") - 1) - 1)))
    known = marked.where("_v is not null").select(*keys, "_i", "_v", block(F.col("_i")).alias("_block"))
    past = known.join(gaps, [*keys, "_block"]).where((F.col("_i") < F.col("_gap")) & (F.col("_i") >= F.col("_gap") - train)).drop("_block")

    def run(key: tuple, seen: pd.DataFrame, missing: pd.DataFrame) -> pd.DataFrame:
        if not len(seen) or not len(missing):
            return pd.DataFrame([], columns=[*keys, "_i", "_p"])
        at, v = (seen.groupby("_i")["_v"].mean().sort_index().reset_index()[c].to_numpy() for c in ("_i", "_v"))
        i = np.sort(missing["_i"].to_numpy())
        y = np.interp(np.arange(at[0], i[0]), at, v)
        p = seasonal_forecast(y, int(i[-1] - i[0]) + 1, period)
        return pd.DataFrame({k: [x] * len(i) for k, x in zip(keys, key, strict=False)} | {"_i": i, "_p": p[i - i[0]]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    past, asked = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (past, asked))  # columns of their own
    filled = past.groupBy(*keys, "_gap").cogroup(asked.groupBy(*keys, "_gap")).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _i long, _p double")
    out = rows.join(filled, [*keys, "_i"], "left").withColumns({value: F.coalesce("_v", "_p"), "imputed": F.col("_v").isNull() & F.col("_p").isNotNull()})
    return out.select(*df.columns, "imputed")
