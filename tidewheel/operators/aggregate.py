"""Grouped summaries: shares, curves, correlations, pivots, top and bottom rows, relevancy."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.quantiles import exact_quantiles


def completeness(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Percent of non-null values per group."""
    return df.groupBy(*keys).agg(*((100 * F.count(c) / F.count(F.lit(1))).alias(c) for c in columns))


def null_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: count, mean, sd, min, quartiles (exact, of what isn't NaN), max. All but the quartiles take one scan."""
    one = df.agg(*(c.alias(f"{k}_{i}") for i, col in enumerate(columns) for k, c in {"n": F.count(col), "mean": F.avg(col), "sd": F.stddev_samp(col), "lo": F.min(col).cast("double"), "hi": F.max(col).cast("double")}.items()))
    rows = []
    for i, col in enumerate(columns):
        q = [F.lit(x).cast("double").alias(n) for n, x in zip(("q25", "median", "q75"), exact_quantiles(df, col, [0.25, 0.5, 0.75]), strict=True)]
        rows.append(F.struct(F.lit(col).alias("column"), F.col(f"n_{i}").alias("count"), F.col(f"mean_{i}").alias("mean"), F.col(f"sd_{i}").alias("sd"), F.col(f"lo_{i}").alias("min"), *q, F.col(f"hi_{i}").alias("max")))
    return one.select(F.inline(F.array(*rows)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair of columns, strongest first; all in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.a", "x.b", "x.r").orderBy(F.abs("r").desc(), "a", "b")


def autocorrelation(df: DataFrame, value: str, order: str, lags: list[int], keys: list[str] = ()) -> DataFrame:
    """lag, r: Pearson correlation with the value so many rows before."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({f"_l{k}": F.lag(value, k).over(w) for k in lags})
    one = rows.agg(*(F.corr(value, f"_l{k}").alias(f"_r{k}") for k in lags))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_r{k}").alias("r")) for k in lags))).alias("x")).select("x.lag", "x.r")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def share_within(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Rows per group and their percent of the wider group."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def cumulative_curve(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows per value and group with running count, percent and running percent; windows run over distinct values."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    g = Window.partitionBy(*keys)
    run = g.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = n.withColumns({"running": F.sum("n").over(run), "percent": 100 * F.col("n") / F.sum("n").over(g)})
    return out.withColumn("running_percent", 100 * F.col("running") / F.sum("n").over(g))


def top_bottom(df: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    """The n highest and the n lowest rows, each side by its own limit."""
    top = df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(F.col(by).asc_nulls_last(), *ties).limit(n).withColumn("side", F.lit("bottom")))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, agg: Column, fill=None) -> DataFrame:
    out = df.groupBy(*rows).pivot(column, values).agg(agg)
    return out.na.fill(fill, subset=[str(v) for v in values]) if fill is not None else out


def relevancy(df: DataFrame, run: str, event: str) -> DataFrame:
    """run, event, tf, idf, score: tf is the count over the run's largest count, idf the log of runs over runs that have the event."""
    counts = df.where(F.col(event).isNotNull() & F.col(run).isNotNull()).groupBy(run, event).agg(F.count(F.lit(1)).alias("n"))
    tf = counts.withColumn("tf", F.col("n") / F.max("n").over(Window.partitionBy(run)))
    runs = counts.select(run).distinct().agg(F.count(F.lit(1)).alias("_runs"))
    idf = counts.groupBy(event).agg(F.count(F.lit(1)).alias("_with")).crossJoin(F.broadcast(runs)).select(event, F.log(F.col("_runs") / F.col("_with")).alias("idf"))
    return tf.join(idf, event).select(run, event, "tf", "idf", (F.col("tf") * F.col("idf")).alias("score"))


#: Values of a key in a grid.
MOST_VALUES = 100_000


def padded(df: DataFrame, keys: list[str], counts: list[str], fill: int = 0) -> DataFrame:
    """One row for every combination of the keys' values, the counts of those that df lacks filled.

    The grid is made of the keys' values, MOST_VALUES of each at most: more raise a ValueError before anything is broadcast.
    """
    grid = None
    for k in keys:
        values = df.select(k).where(F.col(k).isNotNull()).distinct()
        if values.limit(MOST_VALUES + 1).count() > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} values of {k}: a grid of them is no table to look at")
        grid = values if grid is None else grid.join(F.broadcast(values))
    return grid.join(df, keys, "left").withColumns({c: F.coalesce(c, F.lit(fill)) for c in counts})


def page(df: DataFrame, columns: list[str], order: list[str], number: int = 0, size: int = 20, digits: int | None = None) -> DataFrame:
    """A page of a table for display: chosen columns, doubles rounded, rows in order; reads no more than the pages up to it."""
    kinds = dict(df.dtypes)
    shown = [F.round(c, digits).alias(c) if digits is not None and kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return df.orderBy(*order).offset(number * size).limit(size).select(*shown)
