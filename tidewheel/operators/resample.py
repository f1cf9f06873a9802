"""Regular time grids: resampling with empty bins, rolling windows, interpolation, calendar lags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import micros
from tidewheel.operators import chunks


def spine(df: DataFrame, time_col: str, freq: str, keys: list[str] = ()) -> DataFrame:
    """The grid of bin starts from each group's first to its last bin; freq as in '1 day', '10 minutes'."""
    b = F.window(F.col(time_col), freq).getField("start")
    ends = df.select(*keys, b.alias("_b")).groupBy(*keys).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")) if keys else df.select(b.alias("_b")).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    return ends.where("_lo is not null").select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, interval {freq})")).alias("bin"))


def resample(df: DataFrame, time_col: str, freq: str, aggs: dict[str, Column], keys: list[str] = (), zero: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per bin, empty bins included: null there, 0 for the columns in `zero` (sums and counts)."""
    binned = df.withColumn("bin", F.window(F.col(time_col), freq).getField("start"))
    full = spine(df, time_col, freq, keys).join(binned.groupBy(*keys, "bin").agg(*(c.alias(n) for n, c in aggs.items())), [*keys, "bin"], "left")
    return full.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in zero}) if zero else full


def rolling(df: DataFrame, time_col: str, hours: float, aggs: dict[str, Column], keys: list[str] = (), stretch: int = 16) -> DataFrame:
    """Aggregates over the window (t - hours, t] of each row's group.

    Time is cut into stretches of `stretch` windows, a window partition each, so that a long series is spread over tasks;
    a row within a window of the next stretch is copied there, and left out of its result.
    """
    width = int(hours * 3.6e9) - 1
    at = micros(F.col(time_col))
    part = lambda t: F.floor(t / (width * stretch + 1)).cast("long")
    rows = df.withColumn("_own", part(at)).withColumn("_part", F.explode_outer(F.sequence("_own", part(at + width))))
    w = Window.partitionBy(*keys, "_part").orderBy(at).rangeBetween(-width, 0)
    return rows.withColumns({n: c.over(w) for n, c in aggs.items()}).where(F.col("_own").eqNullSafe(F.col("_part"))).drop("_own", "_part")


class _Bounds(BaseIndexer):
    """Windows from given first to given last rows."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first, self.end


def _medians(v: np.ndarray, known: np.ndarray, first: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Medians of the known values in windows; ranks stand for values, so that infinite ones and NaN (the largest) are values too."""
    levels, rank = np.unique(v[known], return_inverse=True)
    ranks = np.full(len(v), np.nan)
    ranks[known] = rank
    rolled = pd.Series(ranks).rolling(_Bounds(first=first, end=end), min_periods=1)
    low, high = (rolled.quantile(0.5, interpolation=way).to_numpy() for way in ("lower", "higher"))
    out, some = np.full(len(v), np.nan), ~np.isnan(low)
    a, b = levels[low[some].astype(int)], levels[high[some].astype(int)]
    with np.errstate(invalid="ignore"):  # the middle of -inf and inf is NaN
        out[some] = np.where(a == b, a, 0.5 * a + 0.5 * b)
    return out


def _means(v: np.ndarray, known: np.ndarray, first: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Means of the known values in windows: blocks, which begin at the cuts, are a window long, so a window is the end of a
    block and the start of the next.

    Both are running sums within a block; nothing is subtracted.
    """
    x, n = np.where(known, v, 0.0), np.r_[0, np.cumsum(known)]
    up, down = np.empty(len(v)), np.zeros(len(v) + 1)
    with np.errstate(invalid="ignore"):  # -inf and inf add up to NaN
        for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True):
            up[a:b] = np.cumsum(x[a:b])
            down[a:b] = np.cumsum(x[a:b][::-1])[::-1]
        start = np.repeat(cuts, np.diff([*cuts, len(v)]))
        total = up[end - 1] + np.where(first < start, down[first], 0.0)
    return total / np.maximum(n[end] - n[first], 1)


def _whole_groups(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.Table]:
    """The rows of ordered batches as tables of whole groups, whose first rows are marked; no more than a batch besides one group."""
    held = []
    for batch in batches:
        marks = np.flatnonzero(batch.column(mark).to_numpy(zero_copy_only=False))
        if len(marks):
            held.append(batch.slice(0, marks[-1]))
            if any(b.num_rows for b in held):
                yield pa.Table.from_batches(held)
            batch, held = batch.slice(marks[-1]), []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def rolling_values(df: DataFrame, time_col: str, hours: float, stats: dict[str, tuple[str, str]], keys: list[str] = (), stretch: int = 8) -> DataFrame:
    """rolling() for medians and means, {name: ("median" or "mean", column)}, whose cost grows neither with the rows of a window
    nor with the number of stretches that a long series has.

    A window aggregate of Spark reads a whole window for each row. Here medians move along an ordered list, means are made
    of running sums. Rows are dealt by stretch of time, with a copy of those one window before it; a task takes its stretches
    in batches of many short ones, and holds a stretch at least.
    """
    width = int(hours * 3.6e9) - 1
    at = micros(F.col(time_col))
    part = lambda t: F.floor(t / ((width + 1) * stretch)).cast("long")
    sources = list(dict.fromkeys(c for _, c in stats.values()))
    dealt = df.withColumn("_part", F.explode_outer(F.sequence(part(at), part(at + width)))).repartition(*keys, "_part")
    rows = dealt.withColumns({"_at": at, "_mine": part(at).eqNullSafe(F.col("_part"))} | {f"_value{i}": F.col(c).cast("double") for i, c in enumerate(sources)})
    # numbering them puts a stretch's rows together, in the order of time
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at")) == 1)
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "_first"):
            t = table["_at"].combine_chunks().fill_null(0).to_numpy()  # rows without a time are a group of their own, and each other's window
            new, block = table["_first"].to_numpy(), t // (width + 1)
            first, end = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
            groups = np.flatnonzero(new)
            for a, b in zip(groups, [*groups[1:], len(t)], strict=True):
                first[a:b] = a + np.searchsorted(t[a:b], t[a:b] - width, "left")
                end[a:b] = a + np.searchsorted(t[a:b], t[a:b], "right")
            cuts = np.flatnonzero(new | np.r_[True, block[1:] != block[:-1]])
            out = table.select(kept)
            for name, (kind, column) in stats.items():
                values = table[f"_value{sources.index(column)}"]
                known = values.is_valid().to_numpy()
                found = {"median": _medians, "mean": _means}[kind](values.to_numpy(), known, first, end, cuts)
                seen = np.r_[0, np.cumsum(known)]
                out = out.append_column(name, pa.array(found, mask=seen[end] == seen[first]))
            yield from out.filter(table["_mine"]).to_batches()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` double" for n in stats)])
    return rows.mapInArrow(run, fields)


def calendar_lag(df: DataFrame, time_col: str, value: str, lags: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """The value at the same group's time minus an interval (not so many rows before): a self-join on shifted times."""
    out = df
    for name, interval in lags.items():
        past = df.select(*keys, (F.col(time_col) + F.expr(f"INTERVAL {interval}")).alias(time_col), F.col(value).alias(name))
        out = out.join(past, [*keys, time_col], "left")
    return out


def row_lags(df: DataFrame, value: str, order: str, lags: list[int], keys: list[str] = (), leads: list[int] = ()) -> DataFrame:
    """value_lag<k> and value_lead<k>; rows where one is missing are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = {f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags} | {f"{value}_lead{k}": F.lead(value, k).over(w) for k in leads}
    return df.withColumns(names).na.drop(subset=list(names))


def interpolate(df: DataFrame, value: str, order: str, keys: list[str] = (), out: str | None = None) -> DataFrame:
    """Linear by row position between known values; leading nulls stay, trailing ones take the last value. Long tables go over chunks."""
    if chunks.is_long(df):
        return chunks.interpolated(df, value, order, [*keys], out or value)
    w = Window.partitionBy(*keys).orderBy(order)
    upto = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # growing frames take one pass, shrinking ones a pass per row
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i"), F.col(value).cast("double").alias("v")))
    rows = df.withColumn("_i", F.row_number().over(w))
    rows = rows.withColumns({"_p": F.last(known, ignorenulls=True).over(upto), "_q": F.last(known, ignorenulls=True).over(after)})
    p, q = F.col("_p"), F.col("_q")
    between = p["v"] + (q["v"] - p["v"]) * F.try_divide(F.col("_i") - p["_i"], q["_i"] - p["_i"])
    return rows.withColumn(out or value, F.coalesce(F.col(value).cast("double"), between, p["v"])).drop("_i", "_p", "_q")


def trailing_mean(df: DataFrame, value: str, date_col: str, days: int, keys: list[str] = (), out: str = "trailing") -> DataFrame:
    """Mean over the `days` days before each row's date, that day excluded; 0 where there is none."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    return df.withColumn(out, F.coalesce(F.avg(value).over(w), F.lit(0.0)))


def sequence_windows(df: DataFrame, values: list[str], order: str, length: int, keys: list[str] = (), label: str | None = None) -> DataFrame:
    """For every row with `length` rows before it in its group: those rows as an array of structs, and its own label."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumns({"window": F.collect_list(F.struct(*values)).over(w.rowsBetween(-length, -1)), "_n": F.row_number().over(w)})
    return out.where(F.col("_n") > length).select(*keys, order, "window", *([label] if label else []))


def upsample(df: DataFrame, time_col: str, value: str, freq: str, keys: list[str] = ()) -> DataFrame:
    """Means on a finer grid, the steps between known ones filled linearly: keys, bin, value."""
    return interpolate(resample(df, time_col, freq, {value: F.avg(value)}, keys), value, "bin", list(keys))
