"""Drives recorded by an accelerometer: splitting, compression of six signals, and the events that survive it."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.dates import epoch_seconds
from tidewheel.operators import clean, events, resample, series
from tidewheel.sources import datasets

SIGNALS = [f"{end}{axis}Acc" for axis in "XYZ" for end in ("min", "max")]
#: Limits of each signal, and classes of severity in percent of them. Fixed values.
LIMITS = {"minXAcc": -2.5, "maxXAcc": 1.5, "minYAcc": -1.8, "maxYAcc": 1.3, "minZAcc": -2.5, "maxZAcc": 2.0}
CLASSES = [("Warning", 100, 150), ("Incident", 150, 200), ("Hard_incident", 200, float("inf"))]
GAP_SECONDS, LEAST_ROWS = 5, 10


def drives(spark: SparkSession, path: str) -> DataFrame:
    """t (seconds), signals, drive: a new one after a gap of over 5 seconds; drives of at most 10 rows go."""
    raw = datasets.read(spark, "drives", path)
    rows = raw.withColumn("at", datasets.stamp("time")).where("at is not null")
    return split(rows.select("at", *SIGNALS), "at").withColumn("t", epoch_seconds(F.col("at"))).drop("at")


def split(rows: DataFrame, time_col: str, keys: list[str] = ()) -> DataFrame:
    parted = events.sessions(rows, time_col, GAP_SECONDS, keys, "drive") if keys else events.sessions_unkeyed(rows, time_col, GAP_SECONDS, "drive")
    return clean.groups_larger_than(parted, [*keys, "drive"], LEAST_ROWS)


def compressed_apart(rows: DataFrame, signals: list[str] = SIGNALS, mode: str = "zmean") -> DataFrame:
    """Each signal compressed by itself; a row per time that any signal kept, the other signals null there.

    The kept points are put under each other and folded by time, one shuffle in place of a chain of outer joins.
    """
    kept = [series.compress(rows.select("drive", "t", F.col(s).cast("double").alias("v")), ["drive"], "t", "v", mode).select("drive", "t", *(F.col("v").alias(s) if s == x else F.lit(None).cast("double").alias(x) for x in signals)) for s in signals]
    return reduce(DataFrame.unionByName, kept).groupBy("drive", "t").agg(*(F.max(s).alias(s) for s in signals))


def compressed_together(rows: DataFrame, signals: list[str], mode: str = "zmean") -> DataFrame:
    """Whole rows kept wherever the compression of any of the signals keeps a point; each has its own deviation."""
    wanted = rows.select("drive", "t", *(F.col(s).cast("double").alias(s) for s in signals))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna().sort_values("t", kind="stable")
        t, keep = part["t"].to_numpy(float), set()
        for s in signals:
            v = part[s].to_numpy(float)
            keep |= set(series.swinging_door(t, v, series.deviation(t, v, mode)).tolist())
        return part.iloc[sorted(keep)]

    return wanted.groupBy("drive").applyInPandas(run, wanted.schema)


def compressed_by_end(rows: DataFrame, mode: str = "zmean") -> DataFrame:
    """The three minima compressed together, and the three maxima; outer-joined by time."""
    low, high = (compressed_together(rows, [s for s in SIGNALS if s.startswith(e)], mode) for e in ("min", "max"))
    return low.join(high, ["drive", "t"], "full").select("drive", "t", *SIGNALS)


def reconstructed(rows: DataFrame, kept: DataFrame, signals: list[str] = SIGNALS) -> DataFrame:
    """The kept values at all times of rows, interpolated by position within each drive."""
    out = rows.select("drive", "t").join(kept, ["drive", "t"], "left")
    for s in signals:
        out = resample.interpolate(out, s, "t", ["drive"])
    return out


def reconstruction_rmse(rows: DataFrame, kept: DataFrame, signals: list[str] = SIGNALS) -> DataFrame:
    """One row: root mean square error of each signal, and their mean."""
    back = reconstructed(rows, kept, signals).select("drive", "t", *(F.col(s).alias(f"_{s}") for s in signals))
    error = lambda s: F.sqrt(F.avg((F.col(s) - F.col(f"_{s}")) * (F.col(s) - F.col(f"_{s}"))))
    out = rows.join(back, ["drive", "t"]).agg(*(error(s).alias(s) for s in signals))
    return out.withColumn("rmse", reduce(lambda a, b: a + b, (F.col(s) for s in signals)) / len(signals))


def detected(rows: DataFrame) -> DataFrame:
    """drive, t, event: the rows whose signals exceed their limits, by the highest class."""
    percent = clean.threshold_percent(rows, LIMITS)
    return percent.withColumn("event", clean.severity([f"{s}_pct" for s in LIMITS], CLASSES)).where("event != 'No event'").select("drive", "t", "event")


def event_confusion(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Events found in the original against those found in the kept rows, counted; 'No event' where one finds none."""
    a, b = detected(rows).withColumnRenamed("event", "original"), detected(kept).withColumnRenamed("event", "compressed")
    both = a.join(b, ["drive", "t"], "full").na.fill("No event", ["original", "compressed"])
    return both.groupBy("original", "compressed").agg(F.count(F.lit(1)).alias("n"))
