"""Box-plot outliers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.quantiles import exact_quantiles, group_quantiles


def fences(q25: float, q75: float, alpha: float = 3.0, medcouple_: float | None = None) -> tuple[float, float]:
    """Lower and upper fence; a medcouple stretches them for skew."""
    m = medcouple_ or 0.0
    low, high = (-4 * m, 3 * m) if m > 0 else (-3 * m, 4 * m)
    iqr = q75 - q25
    return q25 - alpha * iqr * float(np.exp(low)), q75 + alpha * iqr * float(np.exp(high))


def medcouple(x: np.ndarray) -> float:
    """Robust skewness: the median of the kernel over pairs around the median (quadratic, for samples)."""
    x = np.sort(x[~np.isnan(x)])
    if not len(x):
        return 0.0
    m = np.median(x)
    up, down = x[x >= m], x[x <= m]
    width = up[:, None] - down[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        h = ((up[:, None] - m) - (m - down[None, :])) / width
    ties = width == 0
    if ties.any():
        i, j = np.nonzero(ties)
        k = np.count_nonzero(x == m)
        h[i, j] = np.sign(k - 1 - (i - i.min()) - (j - j.min()))
    return float(np.median(h))


def outlier_flags(df: DataFrame, column: str, alpha: float = 3.0, skew_sample: int = 0, flag: str = "outlier", key: str | None = None) -> DataFrame:
    """A flag per row, strictly outside the fences of the whole column; nulls are never flagged."""
    q25, q75 = exact_quantiles(df, column, [0.25, 0.75])
    if q25 is None:
        return df.withColumn(flag, F.lit(False))
    mc = None
    if skew_sample:
        rows = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col(key or column), F.lit(1)), column).limit(skew_sample)
        mc = medcouple(np.array([r[0] for r in rows.select(column).collect()], float))
    low, high = fences(q25, q75, alpha, mc)
    return df.withColumn(flag, F.coalesce((F.col(column) < low) | (F.col(column) > high), F.lit(False)))


def group_fences(df: DataFrame, keys: list[str], column: str, alpha: float = 3.0) -> DataFrame:
    """Per group: q25, q75, low, high."""
    q = group_quantiles(df, keys, column, [0.25, 0.75])
    q = q.select(*keys, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))
    iqr = F.col("q75") - F.col("q25")
    return q.withColumns({"low": F.col("q25") - alpha * iqr, "high": F.col("q75") + alpha * iqr})


def group_outlier_flags(df: DataFrame, keys: list[str], column: str, alpha: float = 3.0, flag: str = "outlier") -> DataFrame:
    f = group_fences(df, keys, column, alpha).select(*keys, "low", "high")
    out = df.join(f, keys, "left")
    return out.withColumn(flag, F.coalesce((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")), F.lit(False))).drop("low", "high")
