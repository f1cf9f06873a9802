"""Data behind charts: histograms, box summaries, trims, heatmaps, overlays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.quantiles import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int | list[float] | None = None) -> DataFrame:
    """lo, hi, n per bin, empty ones included; bins: a number, edges, or none for 1 + 3.322 log10(n).

    Bins are closed on the left, the last on both sides. Counting is one aggregation by bin number.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0:
        return df.sparkSession.createDataFrame([], "lo double, hi double, n long")
    if not isinstance(bins, list):
        k = bins or int(math.ceil(1 + 3.322 * math.log10(n)))
        width = (hi - lo) / k or 1.0
        bins = [lo + i * width for i in range(k + 1)]
    edges = F.array(*(F.lit(float(b)) for b in bins))
    x = F.col(column)
    at = F.least(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.lit(len(bins) - 2))
    counts = df.where((x >= bins[0]) & (x <= bins[-1])).groupBy(at.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins, bins[1:], strict=False))], "i int, lo double, hi double")
    return cells.join(counts, "i", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def box_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"), F.count(column).alias("n"))
    return q.select(*keys, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "q25", "median", "q75", "high"))))


def trimmed(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two quantiles of a column, both included."""
    a, b = exact_quantiles(df, column, [low, high])
    return df.where(F.col(column).between(a, b)) if a is not None else df.limit(0)


def heatmap(df: DataFrame, row: Column, column: Column, values: list, agg: Column, fill=0) -> DataFrame:
    """A row per `row`, a column per value of `column`."""
    out = df.select("*", row.alias("_row"), column.alias("_col")).groupBy("_row").pivot("_col", values).agg(agg)
    return out.na.fill(fill).withColumnRenamed("_row", "row")


def share_per_day(df: DataFrame, day: Column, group: str) -> DataFrame:
    """day, group, n, percent of the day's rows."""
    n = df.where(F.col(group).isNotNull()).groupBy(day.alias("day"), group).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("day")))


def yearly_overlay(df: DataFrame, time_col: str, value: str, agg=F.avg) -> DataFrame:
    """year, day_of_year, value: years laid over each other."""
    return df.groupBy(F.year(time_col).alias("year"), F.dayofyear(time_col).alias("day_of_year")).agg(agg(value).alias("value"))


def error_change(df: DataFrame, keys: list[str], truth: str, before: str, after: str) -> DataFrame:
    """Mean of |before - truth| - |after - truth| per group: positive where the later model is better."""
    gain = F.abs(F.col(before) - F.col(truth)) - F.abs(F.col(after) - F.col(truth))
    return df.groupBy(*keys).agg(F.avg(gain).alias("gain"), F.count(F.lit(1)).alias("n"))


def row_percent(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cells of a table of two columns as percent of their row."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))
