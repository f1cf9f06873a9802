"""Seasonal ARIMA models as state spaces: likelihood, forecasts and smoothed gaps, a group of rows for each gap.

A model (p, d, q)(P, D, Q, s) is one autoregression and one moving average with the differences multiplied in, in the
form whose state is as long as the longer of the two. The Kalman filter skips missing values; the state starts diffuse,
and the first values, as many as the state has parts, don't count in the likelihood. Parameters are searched by
patterns: all moves of a round are filtered together as one batch of arrays. The smoother runs back over the window
and needs one row of each covariance only, so a gap takes both sides into account. Models without moving averages have
the same solution by least squares, which is taken where many gaps lie in a window and covariances never settle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import micros
from tidewheel.operators.blocks import saved

#: Variance of the unknown start; covariances that change by less than STEADY stay as they are until a value is missing.
DIFFUSE, STEADY = 1e6, 1e-7
#: Known values that a window needs beyond the length of the state.
SPARE = 8


@dataclass(frozen=True)
class Sarima:
    order: tuple[int, int, int] = (0, 1, 0)
    seasonal: tuple[int, int, int, int] = (1, 1, 0, 24)

    @property
    def parameters(self) -> int:
        return self.order[0] + self.order[2] + self.seasonal[0] + self.seasonal[2]

    @property
    def states(self) -> int:
        (p, d, q), (sp, sd, sq, s) = self.order, self.seasonal
        return max(p + d + s * (sp + sd), q + s * sq + 1)

    def polynomials(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of y on its past and of the noise on its own, `states` of each: parameters in the order p, P, q, Q."""
        (p, d, q), (sp, sd, sq, s) = self.order, self.seasonal
        a, b, c, e = np.split(np.asarray(theta, float), np.cumsum([p, sp, q]))

        def spread(coefficients: np.ndarray, step: int) -> np.ndarray:
            out = np.zeros(len(coefficients) * step + 1)
            out[0], out[step::step] = 1, coefficients
            return out

        ar = np.convolve(spread(-a, 1), spread(-b, s))
        for _ in range(d):
            ar = np.convolve(ar, [1, -1])
        for _ in range(sd):
            ar = np.convolve(ar, spread(np.array([-1.0]), s))
        ma = np.convolve(spread(c, 1), spread(e, s))
        m = self.states
        return np.append(-ar[1:], np.zeros(m))[:m], np.append(ma, np.zeros(m))[:m]

    def likelihood(self, y: np.ndarray, thetas: np.ndarray) -> np.ndarray:
        """Log likelihood of each row of parameters, the noise's variance taken at its best."""
        ar, ma = (np.array(x) for x in zip(*map(self.polynomials, thetas), strict=True))
        g, m = ar.shape
        a, p, noise = np.zeros((g, m)), np.tile(np.eye(m) * DIFFUSE, (g, 1, 1)), ma[:, :, None] * ma[:, None, :]
        squares, logs, n = np.zeros(g), np.zeros(g), 0
        seen, steady = 0, False
        for x in y:
            known = x == x
            before = p
            if known:
                if not steady:
                    f = p[:, 0, 0].copy()
                    k = p[:, :, 0] / f[:, None]
                v = x - a[:, 0]
                a = a + k * v[:, None]
                seen += 1
                if seen > m:
                    squares, logs, n = squares + v * v / f, logs + np.log(f), n + 1
            first = a[:, :1].copy()
            a[:, :-1] = a[:, 1:]
            a[:, -1] = 0
            a += ar * first
            if known and steady:
                continue
            if known:
                p = p - k[:, :, None] * p[:, :1, :]
            t = ar[:, :, None] * p[:, :1, :]
            t[:, :-1] += p[:, 1:]
            p = t[:, :, :1] * ar[:, None, :] + noise
            p[:, :, :-1] += t[:, :, 1:]
            steady = known and seen > m and np.abs(p - before).max() < STEADY
        return -0.5 * (n * np.log(np.maximum(squares, 1e-300) / max(1, n)) + logs) if n else np.zeros(g)

    def completed(self, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """Without moving averages: y with its missing values, and its log likelihood given an unknown start.

        All noise is then a weighted sum of the y of a few steps, so that missing values are a least-squares solution,
        the same that filter and smoother come to.
        """
        weights = np.append(1.0, -self.polynomials(theta)[0])
        m, n, gaps = self.states, len(y), np.flatnonzero(np.isnan(y))
        noise = np.convolve(np.nan_to_num(y), weights)[m:n]
        back = np.arange(m, n)[:, None] - gaps
        design = np.where((back >= 0) & (back <= m), weights[np.clip(back, 0, m)], 0.0)
        square = design.T @ design + 1e-9 * np.eye(len(gaps))
        fill = -np.linalg.solve(square, design.T @ noise)
        out = np.array(y, float)
        out[gaps] = fill
        free = max(1, n - m - len(gaps))
        rest = float(((noise + design @ fill) ** 2).sum())
        return out, -0.5 * (free * np.log(max(rest, 1e-300) / free) + np.linalg.slogdet(square)[1])

    def fitted(self, y: np.ndarray, least: float = 1e-3) -> np.ndarray:
        """Parameters of the highest likelihood found: steps along each parameter, made finer where none is better."""
        k = self.parameters
        best, step = np.zeros(k), 0.5
        moves = np.vstack([np.zeros(k), *(np.vstack([np.eye(k)[i] * f for f in (-1, -0.5, 0.5, 1)]) for i in range(k))]) if k else np.zeros((1, 0))
        while k and step >= least:
            tried = np.clip(best + step * moves, -0.99, 0.99)
            at = int(np.argmax(self.likelihood(y, tried) if self.order[2] or self.seasonal[2] else [self.completed(y, x)[1] for x in tried]))
            if at and not np.array_equal(tried[at], best):
                best = tried[at]
            else:
                step /= 4
        return best

    def smoothed(self, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """y with its missing values as expected from all known ones, before and after."""
        ar, ma = self.polynomials(theta)
        m, n = len(ar), len(y)
        a, p, noise = np.zeros(m), np.eye(m) * DIFFUSE, np.outer(ma, ma)
        level, rows, gain, v, f = np.zeros(n), np.zeros((n, m)), np.zeros((n, m)), np.zeros(n), np.ones(n)
        seen, steady = 0, False

        def ahead(x: np.ndarray) -> np.ndarray:
            return np.append(x[1:], 0.0) + ar * x[0]

        for t, x in enumerate(y):
            level[t], rows[t], known, before = a[0], p[0], x == x, p
            if known:
                f[t], v[t], seen = p[0, 0], x - a[0], seen + 1
                if not steady:
                    k = p[:, 0] / f[t]
                    kept = ahead(k)
                gain[t], a = kept, a + k * v[t]
            a = ahead(a)
            if known and steady:
                continue
            if known:
                p = p - np.outer(k, p[0])
            q = np.outer(ar, p[0])
            q[:-1] += p[1:]
            p = np.outer(q[:, 0], ar) + noise
            p[:, :-1] += q[:, 1:]
            steady = known and seen > m and np.abs(p - before).max() < STEADY
        out, r = np.array(y, float), np.zeros(m)
        for t in range(n - 1, -1, -1):
            back = np.append(ar @ r, r[:-1])
            if y[t] == y[t]:
                back[0] += v[t] / f[t] - gain[t] @ r
            r = back
            if y[t] != y[t]:
                out[t] = level[t] + rows[t] @ r
        return out

    def filled(self, y: np.ndarray) -> np.ndarray | None:
        """y with its missing values; None where too few are known."""
        known = y[~np.isnan(y)]
        if len(known) < self.states + SPARE:
            return None
        mean, spread = known.mean(), known.std()
        if not spread:
            return np.where(np.isnan(y), mean, y)
        z = (y - mean) / spread
        theta = self.fitted(z)
        return (self.smoothed(z, theta) if self.order[2] or self.seasonal[2] else self.completed(z, theta)[0]) * spread + mean


def impute_sarima(df: DataFrame, keys: list[str], time_col: str, value: str, every: int = 3600, model: Sarima | None = None, train: int = 360, after: int = 72) -> DataFrame:
    """df with its gaps filled by a model fitted on the `train` steps before and `after` steps behind each, and imputed.

    Rows are a grid of `every` seconds; several rows of a step count as their mean. With after=0 a gap is a forecast.
    Other gaps in a window are missing values there. A gap with too few known values around stays null, as do rows of
    a null key. Each gap is a group of its own with its bounded surroundings, so a series need not fit in a task.
    """
    model = model or Sarima()
    rows = df.withColumns({"_i": F.floor(micros(F.col(time_col)) / (every * 1_000_000)).cast("long"), "_v": F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))})
    w = Window.partitionBy(*keys).orderBy("_i")
    opens = F.col("_v").isNull() & F.coalesce(F.lag(F.col("_v").isNotNull()).over(w), F.lit(True))
    marked = rows.select(*keys, "_i", "_v", opens.alias("_o")).withColumn("_gap", F.max(F.when(F.col("_o"), F.col("_i"))).over(w))
    marked = saved(marked.drop("_o"), "gaps")  # read twice; sorted once
    missing = marked.where("_v is null").groupBy(*keys, "_gap").agg(F.max("_i").alias("_end"))
    block = lambda i: F.floor(i / train).cast("long")
    gaps = missing.withColumn("_block", F.explode(F.sequence(block(F.col("_gap") - train), block(F.col("_end") + after))))
    known = marked.where("_v is not null").select(*keys, "_i", "_v", block(F.col("_i")).alias("_block"))
    around = known.join(gaps, [*keys, "_block"]).where((F.col("_i") >= F.col("_gap") - train) & (F.col("_i") <= F.col("_end") + after)).select(*keys, "_gap", "_end", "_i", "_v")

    def run(key: tuple, seen: pd.DataFrame) -> pd.DataFrame:
        gap, end = int(seen["_gap"].iloc[0]), int(seen["_end"].iloc[0])
        at = seen.groupby("_i")["_v"].mean().sort_index()
        first, last = min(int(at.index[0]), gap), max(int(at.index[-1]), end)
        y = np.full(last - first + 1, np.nan)
        y[at.index.to_numpy() - first] = at.to_numpy()
        full = model.filled(y)
        if full is None:
            return pd.DataFrame([], columns=[*keys, "_i", "_p"])
        i = np.arange(gap, end + 1)
        return pd.DataFrame({k: [x] * len(i) for k, x in zip(keys, key, strict=False)} | {"_i": i, "_p": full[i - first]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    filled = around.groupBy(*keys, "_gap").applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _i long, _p double")
    out = rows.join(filled, [*keys, "_i"], "left").withColumns({value: F.coalesce("_v", "_p"), "imputed": F.col("_v").isNull() & F.col("_p").isNotNull()})
    return out.select(*df.columns, "imputed")
