"""Scaling of columns, within groups or over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.outliers import outlier_flags
from tidewheel.operators.resample import resample

Scaler = Callable[[Column, dict[str, Column]], Column]

#: Each scaler as a function of the value and its group's statistics.
SCALERS: dict[str, Scaler] = {
    "zscore": lambda x, s: F.try_divide(x - s["mean"], s["sd"]),
    "standard": lambda x, s: F.try_divide(x - s["mean"], s["sd0"]),
    "minmax": lambda x, s: F.try_divide(x - s["min"], s["max"] - s["min"]),
    "max": lambda x, s: F.try_divide(x, s["max"]),
}


def scaled(df: DataFrame, columns: list[str], keys: list[str] = (), method: str | Scaler = "zscore", prefix: str = "n_") -> DataFrame:
    """Scaled copies of the columns. Statistics are one row per group, joined back: groups are never gathered."""
    fn = SCALERS[method] if isinstance(method, str) else method
    kinds = {"mean": F.avg, "sd": F.stddev_samp, "sd0": F.stddev_pop, "min": F.min, "max": F.max}
    aggs = [k(F.col(c)).alias(f"_{n}_{c}") for c in columns for n, k in kinds.items()]
    stats = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    out = df.join(stats, list(keys), "left") if keys else df.crossJoin(F.broadcast(stats))
    return out.withColumns({prefix + c: fn(F.col(c), {n: F.col(f"_{n}_{c}") for n in kinds}) for c in columns}).select(*df.columns, *(prefix + c for c in columns))


def row_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column divided by the row's sum over the columns; rows with a null are left out."""
    total = reduce(lambda a, b: a + b, (F.col(c) for c in columns))
    out = df.na.drop(subset=columns).withColumn("_total", total)
    return out.withColumns({c: F.try_divide(F.col(c), F.col("_total")) for c in columns}).drop("_total")


def scaled_within_fences(df: DataFrame, column: str, alpha: float = 3.0, method: str | Scaler = "minmax", prefix: str = "n_") -> DataFrame:
    """The rows inside the column's box-plot fences, with its scaled copy: outliers leave before the statistics are taken."""
    inside = outlier_flags(df.where(F.col(column).isNotNull()), column, alpha, flag="_out").where("not _out").drop("_out")
    return scaled(inside, [column], (), method, prefix)


def resampled_scaled(df: DataFrame, time_col: str, freq: str, columns: list[str], keys: list[str] = (), method: str | Scaler = "minmax", prefix: str = "n_") -> DataFrame:
    """Sums per bin, empty bins 0, and their copies scaled within each group."""
    sums = resample(df, time_col, freq, {c: F.sum(c) for c in columns}, keys, tuple(columns))
    return scaled(sums, columns, list(keys), method, prefix)
