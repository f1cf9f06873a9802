"""Labelling runs of flagged rows, merging near ones, summarising them; sessions by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import micros
from tidewheel.operators import chunks
from tidewheel.operators.blocks import saved
from tidewheel.operators.quantiles import exact_quantiles


def label_runs(df: DataFrame, flag: str, order: str, keys: list[str] = (), label: str = "label") -> DataFrame:
    """Runs of flagged rows, in order within a group, numbered from 1; 0 elsewhere. Long tables go over chunks."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    if chunks.is_long(df):
        return chunks.runs(df, on, order, [*keys], label)
    start = (on & ~F.coalesce(F.lag(on).over(w), F.lit(False))).cast("int")
    total = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_start", start).withColumn(label, F.when(on, total).otherwise(0).cast("int")).drop("_start")


def sampling_period(df: DataFrame, time_col: str, keys: list[str] = ()) -> float:
    """Median difference of consecutive times within groups, in microseconds."""
    w = Window.partitionBy(*keys).orderBy(time_col)
    steps = df.select((micros(F.col(time_col)) - F.lag(micros(F.col(time_col))).over(w)).alias("d"))
    return exact_quantiles(saved(steps.where("d is not null"), "steps"), "d", [0.5])[0]


def label_runs_merged(df: DataFrame, flag: str, time_col: str, merge_minutes: float, keys: list[str] = (), period_minutes: float | None = None, label: str = "label") -> DataFrame:
    """Like label_runs, over the regular time grid: runs whose gap is at most merge_minutes become one event.

    For flagged neighbours at distance g: g beyond the merge interval, or longer than the period and not
    merged, splits; a merged gap also labels the unflagged rows inside it; within one period an unflagged row
    between them splits. No grid is expanded.
    """
    period = period_minutes * 60e6 if period_minutes else sampling_period(df, time_col, keys)
    merge = max(merge_minutes * 60e6, period or 0)
    w = Window.partitionBy(*keys).orderBy(time_col)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # growing frames take one pass, shrinking ones a pass per row
    on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    if chunks.is_long(df):
        return chunks.merged_runs(df, on, micros(F.col(time_col)), time_col, merge, period, [*keys], label)
    rows = df.withColumns({"_t": micros(F.col(time_col)), "_on": on})
    rows = rows.withColumns({"_i": F.row_number().over(w), "_prev_row": F.lag("_on").over(w), "_prev": F.last(F.when(F.col("_on"), F.col("_t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    gap = F.col("_t") - F.col("_prev")
    joined = (gap <= merge) & ((gap > F.lit(period)) | F.col("_prev_row"))
    rows = rows.withColumn("_new", (F.col("_on") & ~F.coalesce(joined, F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(before))
    rows = rows.withColumns({
        "_next_run": F.last(F.when(F.col("_on"), F.col("_run")), ignorenulls=True).over(after),
        "_last_run": F.last(F.when(F.col("_on"), F.col("_run")), ignorenulls=True).over(before),
    })
    bridged = ~F.col("_on") & (F.col("_next_run") == F.col("_last_run"))
    out = rows.withColumn(label, F.when(F.col("_on") | F.coalesce(bridged, F.lit(False)), F.col("_run")).otherwise(0).cast("int"))
    return out.select(*df.columns, label)


def summarize(df: DataFrame, label: str, time_col: str, target: str, keys: list[str] = (), unit_us: float = 6e7, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per event: start, end, duration in units of unit_us, flagged rows, rows, share flagged, and more."""
    t = micros(F.col(time_col))
    out = df.where(F.col(label) > 0).groupBy(*keys, label).agg(
        F.min(time_col).alias("start"), F.max(time_col).alias("end"), ((F.max(t) - F.min(t)) / unit_us).alias("duration"),
        F.sum(F.col(target).cast("long")).alias("flagged"), F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in (extra or {}).items()),
    )
    return out.withColumn("rat_labeled", F.col("flagged") / F.col("n_rows"))


def sessions(df: DataFrame, time_col: str, gap_seconds: float, keys: list[str] = (), session: str = "session") -> DataFrame:
    """Numbers from 0 per group: a new session after a gap of more than gap_seconds."""
    w = Window.partitionBy(*keys).orderBy(time_col)
    out = df.withColumn("_new", F.coalesce((micros(F.col(time_col)) - F.lag(micros(F.col(time_col))).over(w) > gap_seconds * 1e6).cast("int"), F.lit(0)))
    return out.withColumn(session, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sessions_unkeyed(df: DataFrame, time_col: str, gap_seconds: float, session: str = "session", bucket_seconds: int = 86_400) -> DataFrame:
    """sessions() of one long series without a key: rows are windowed by bucket of time, only the buckets' ends all together."""
    rows = df.where(F.col(time_col).isNotNull()).withColumn("_t", micros(F.col(time_col)))
    rows = rows.withColumn("_b", F.floor(F.col("_t") / int(bucket_seconds * 1e6)))
    w = Window.partitionBy("_b").orderBy("_t")
    rows = rows.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(w) > gap_seconds * 1e6).cast("int"), F.lit(0)))
    rows = rows.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.sum("_new").alias("_n"))
    by_bucket = Window.orderBy("_b")  # a row per bucket
    ends = ends.withColumn("_new", F.coalesce((F.col("_lo") - F.lag("_hi").over(by_bucket) > gap_seconds * 1e6).cast("int"), F.lit(0)))
    base = F.sum(F.col("_new") + F.col("_n")).over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    out = rows.join(ends.select("_b", base.alias("_base")), "_b")
    return out.withColumn(session, (F.col("_base") + F.col("_in")).cast("long")).select(*df.columns, session)
