"""Wind turbines: how each behaves against the fleet, and what to put where readings are missing."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.angles import circular_mean
from tidewheel.operators import clean, events, outliers, resample, series

MEASURES = ["power", "wind_speed", "temperature"]


def averages(df: DataFrame, low: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Means per turbine of the rows within some ranges (ends included), the circular one for the wind's direction."""
    for column, (a, b) in (low or {}).items():
        df = df.where(F.col(column).between(a, b))
    return df.where("turbine is not null").groupBy("turbine").agg(*(F.round(F.avg(c), 2).alias(c) for c in MEASURES), F.round(circular_mean(F.col("wind_direction")), 2).alias("wind_direction")).orderBy("turbine")


def fleet_events(df: DataFrame, alpha: float = 5.0, merge_minutes: float = 20, shortest: float = 30, longest: float = 120, others: int = 3) -> DataFrame:
    """Times when one turbine is far from the fleet's median while `others` more of them run: merged, of a length in minutes, summarised."""
    at = Window.partitionBy("datetime")
    on = (F.col("power") > 0).cast("int")
    rows = df.withColumns({"_median": F.median("power").over(at), "_others": F.sum(on).over(at) - on})
    rows = rows.withColumn("residual", F.abs(F.col("power") - F.col("_median")))
    rows = outliers.outlier_flags(rows, "residual", alpha, flag="_far")
    rows = rows.withColumn("_flag", F.coalesce(F.col("_far"), F.lit(False)) & (F.col("_others") == others))
    labelled = events.label_runs_merged(rows, "_flag", "datetime", merge_minutes, ["turbine"])
    extra = {"power_min": F.min("power"), "power_max": F.max("power"), "power_median": F.percentile("power", 0.5), "residual_median": F.percentile("residual", 0.5)}
    out = events.summarize(labelled, "label", "datetime", "_flag", ["turbine"], extra=extra).where(F.col("duration").between(shortest, longest))
    return out.withColumn("event_id", F.concat_ws("_", "turbine", F.date_format("start", "yyyy-MM-dd HH:mm")))


def residual_events(df: DataFrame, period: int, alpha: float = 3.0, merge_minutes: float = 60) -> DataFrame:
    """Outliers of what trend and season leave of each turbine's power, merged into events."""
    parts = series.decompose(df, ["turbine"], "datetime", "power", period)
    flagged = outliers.outlier_flags(parts, "residual", alpha, flag="_far")
    labelled = events.label_runs_merged(flagged, "_far", "datetime", merge_minutes, ["turbine"])
    return events.summarize(labelled, "label", "datetime", "_far", ["turbine"])


#: Lengths of made gaps in minutes, and the powers of ten between which their weights fall. Fixed values.
GAP_MINUTES, GAP_WEIGHTS = range(10, 240, 10), (0.9, 0.1)


def made_missing(df: DataFrame, events_: int = 100, column: str = "power", seed: int = 0) -> DataFrame:
    """df with the column nulled in a number of stretches, its values as original, and missing_event, the stretch's number (0 outside).

    A stretch starts at a row that has a value, one of those with the lowest hashes of turbine and time; short ones are
    likelier. Where stretches overlap, the one drawn later has its number there. They reach the driver, `events_` at most.
    """
    spark, steps = df.sparkSession, list(GAP_MINUTES)
    weight = np.logspace(*GAP_WEIGHTS, len(steps))
    known = df.where(F.col(column).isNotNull() & F.col("turbine").isNotNull() & F.col("datetime").isNotNull())
    drawn = known.select("turbine", "datetime", F.xxhash64("turbine", "datetime", F.lit(seed)).alias("_h")).orderBy("_h", "turbine", "datetime").limit(events_).collect()
    of: dict[str, list] = {}
    for k, r in enumerate(drawn):
        u = (r["_h"] * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF) / 2**32
        length = steps[int(np.searchsorted(np.cumsum(weight) / weight.sum(), u, "right"))]
        of.setdefault(r.turbine, []).append((k + 1, r.datetime, r.datetime + dt.timedelta(minutes=length)))
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    gaps = spark.createDataFrame(list(of.items()), f"turbine {kind['turbine']}, _gaps array<struct<id: int, start: {kind['datetime']}, stop: {kind['datetime']}>>")
    here = F.filter("_gaps", lambda g: (F.col("datetime") >= g["start"]) & (F.col("datetime") < g["stop"]))
    rows = df.join(F.broadcast(gaps), "turbine", "left").withColumn("missing_event", F.coalesce(F.array_max(F.transform(here, lambda g: g["id"])), F.lit(0)))
    return rows.withColumns({"original": F.col(column), column: F.when(F.col("missing_event") == 0, F.col(column))}).select(*df.columns, "original", "missing_event")


def imputed(df: DataFrame, how: str = "linear") -> DataFrame:
    """power with its gaps filled: by lines within each turbine, or by the mean of the turbines that have a reading then."""
    if how == "linear":
        return resample.interpolate(df, "power", "datetime", ["turbine"])
    return df.withColumn("power", F.coalesce("power", F.avg("power").over(Window.partitionBy("datetime"))))


def imputation_errors(df: DataFrame, how: str = "linear") -> DataFrame:
    """Root mean square error per turbine over what made_missing() took."""
    gone = df.withColumn("_gone", F.col("power").isNull() & F.col("original").isNotNull())
    e = F.col("power") - F.col("original")
    return imputed(gone, how).where("_gone").groupBy("turbine").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def gap_lengths(df: DataFrame) -> DataFrame:
    """Lengths of missing stretches of power in minutes, and how many there are of each."""
    labelled = events.label_runs(clean.nan_to_null(df).withColumn("_missing", F.col("power").isNull()), "_missing", "datetime", ["turbine"])
    return events.summarize(labelled, "label", "datetime", "_missing", ["turbine"]).groupBy("duration").agg(F.count(F.lit(1)).alias("n"))
