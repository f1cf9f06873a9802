"""Support vector regression, and kernel regression on random Fourier features from sums over all rows.

`svr_model` is the exact machine for a training set that one task holds: pairs of dual weights are moved until none
violates the optimum by more than a tolerance. It keeps some kernel columns, never the whole matrix, and cuts no row.
`fourier_walk_forward` is for windows of any size: a fold is a sum of feature products, a training window a sum of
folds, so rows are read twice and never copied to the folds they train.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.learning import STRATEGIES

#: Bytes of kernel columns that a fit keeps.
COLUMNS = 64 << 20


def support_weights(x: np.ndarray, y: np.ndarray, c: float, gamma: float, epsilon: float, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual weights (in [-c, c], of sum 0) and the constant of epsilon-insensitive regression with a Gaussian kernel."""
    n = len(y)
    square = (x**2).sum(1)
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    most = max(2, COLUMNS // (8 * n))

    def column(i: int) -> np.ndarray:
        if i in kept:
            kept.move_to_end(i)
            return kept[i]
        kept[i] = np.exp(-gamma * np.maximum(0, square + square[i] - 2 * (x @ x[i])))
        if len(kept) > most:
            kept.popitem(last=False)
        return kept[i]

    w, r = np.zeros(n), y.astype(float).copy()
    while True:
        # what the objective gains by raising or lowering each weight a little
        up = np.where(w >= c, -np.inf, r - np.where(w >= 0, epsilon, -epsilon))
        down = np.where(w <= -c, np.inf, r - np.where(w > 0, epsilon, -epsilon))
        i = int(np.argmax(up))
        if up[i] - down.min() < tolerance:
            return w, float((up[i] + down.min()) / 2)
        ki = column(i)
        gain = np.maximum(0, up[i] - down)
        j = int(np.argmax(gain**2 / np.maximum(2 - 2 * ki, 1e-12)))
        kj = column(j)
        room = min(c - w[i] if w[i] >= 0 else -w[i], w[j] if w[j] > 0 else w[j] + c)
        step = min(room, gain[j] / max(2 - 2 * ki[j], 1e-12))
        w[i], w[j] = w[i] + step, w[j] - step
        r -= step * (ki - kj)


def _unit(low: np.ndarray, high: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (v - low) / np.where(high > low, high - low, 1)


def svr_model(x: np.ndarray, y: np.ndarray, z: np.ndarray, c: float = 10.0, gamma: float = 0.01, epsilon: float = 0.1, scaled: bool = True) -> np.ndarray:
    """Predictions at z by support vector regression on x, y; features and target are brought to 0..1 first where scaled."""
    ends = (x.min(0), x.max(0), y.min(), y.max()) if scaled else (np.zeros(x.shape[1]), np.ones(x.shape[1]), 0.0, 1.0)
    x, z, t = _unit(*ends[:2], x), _unit(*ends[:2], z), _unit(*ends[2:], y)
    w, b = support_weights(x, t, c, gamma, epsilon)
    s = np.flatnonzero(w)
    out = np.full(len(z), b)
    for k in range(0, len(z), 1024):
        part = z[k : k + 1024]
        out[k : k + 1024] += np.exp(-gamma * np.maximum(0, (part**2).sum(1)[:, None] + (x[s] ** 2).sum(1) - 2 * part @ x[s].T)) @ w[s]
    return out * ((ends[3] - ends[2]) or 1.0) + ends[2]


class Fourier:
    """Random cosines whose products approach a Gaussian kernel, and a constant, on features brought to 0..1."""

    def __init__(self, low: np.ndarray, high: np.ndarray, gamma: float, width: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.low, self.high, self.size = low, high, width + 1
        self.axes, self.phase = rng.normal(size=(len(low), width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(_unit(self.low, self.high, x) @ self.axes + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([z, np.ones(len(x))])


#: Keys and folds whose sums a task holds before it sends them on.
HELD = 256


def fold_sums(rows: DataFrame, by: list[str], features: list[str], target: str, fourier: Fourier) -> DataFrame:
    """by, products (size x size, then size: features with the target) summed over the rows; a task sends a few rows a fold."""
    names = [f"_k{i}" for i in range(len(by))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([[*k, v] for k, v in held.items()], columns=[*names, "products"])

        for batch in batches:
            for key, part in batch.groupby(names, dropna=False):
                z = fourier(part[features].to_numpy(float))
                s = np.append((z.T @ z).ravel(), z.T @ part[target].to_numpy(float))
                held[key] = held[key] + s if key in held else s
            if len(held) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, np.sum(np.stack(part["products"].tolist()), axis=0)]], columns=[*names, "products"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, by, strict=True)) + ", products array<double>"
    used = rows.select(*(F.col(k).alias(n) for n, k in zip(names, by, strict=True)), *dict.fromkeys([*features, target]))
    total = used.mapInPandas(run, schema).groupBy(*names).applyInPandas(add, schema)
    return total.select(*(F.col(n).alias(k) for n, k in zip(names, by, strict=True)), "products")


def fourier_walk_forward(df: DataFrame, keys: list[str], features: list[str], target: str, fold: str, strategy: str = "all_before", gamma: float = 0.01, c: float = 10.0, width: int = 64, seed: int = 0) -> DataFrame:
    """keys, fold, mae, n: as learning.walk_forward, with kernel ridge regression on random Fourier features, penalty 1 / c.

    Features are brought to 0..1 by their range in all rows. Rows with a null feature or target are left out.
    """
    rows = df.select(*keys, *dict.fromkeys([*features, target, fold])).na.drop(subset=[*features, target])
    ends = rows.agg(*(f(c_).cast("double") for c_ in features for f in (F.min, F.max))).first()
    fourier = Fourier(*(np.array([x or 0.0 for x in ends[k::2]]) for k in range(2)), gamma, width, seed)
    sums = fold_sums(rows, [*keys, fold], features, target, fourier)
    numbered = sums.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(fold)))
    tested = numbered.select(*keys, F.col(fold).alias("_test"), "_i")
    trained = numbered.select(*keys, F.col("_i").alias("_j"), "products")
    first, last = STRATEGIES[strategy]
    ok = (F.col("_j") <= F.col("_i") + last) & (F.lit(True) if first is None else (F.col("_j") >= F.col("_i") + first) & (F.col("_i") + first >= 1))
    pairs = (tested.join(trained, keys) if keys else tested.crossJoin(trained)).where(ok).select(*keys, "_test", "products")
    m = fourier.size

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(np.stack(part["products"].tolist()), axis=0)
        penalty = np.append(np.full(m - 1, 1 / c), 1e-9)
        return pd.DataFrame([[*key, np.linalg.solve(s[: m * m].reshape(m, m) + np.diag(penalty), s[m * m :])]], columns=[*keys, "_test", "_w"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    weights = pairs.groupBy(*keys, "_test").applyInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"_test {kinds[fold]}", "_w array<double>"]))
    judged = rows.withColumnRenamed(fold, "_test").join(weights, [*keys, "_test"])  # a row of weights per fold

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = (fourier(batch[features].to_numpy(float)) * np.stack(batch["_w"].tolist())).sum(1) if len(batch) else np.zeros(0)
            yield batch[[*keys, "_test"]].assign(_e=np.abs(p - batch[target].to_numpy(float)))

    out = judged.mapInPandas(errors, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"_test {kinds[fold]}", "_e double"]))
    return out.groupBy(*keys, F.col("_test").alias(fold)).agg(F.avg("_e").alias("mae"), F.count(F.lit(1)).alias("n"))
