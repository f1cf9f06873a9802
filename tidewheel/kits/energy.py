"""Energy consumption: one household with weather and holidays, and many households for federated learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import dates
from tidewheel.operators import clean, learning, resample
from tidewheel.sources import datasets

#: Half-hours that a household's next reading is predicted from. Fixed values.
LAGS = [*range(1, 13), 47, 48, 49, 335, 336, 337]
FEATURES = ["past_day", "past_week", "hour", "weekday", "month", "holiday", "temperature"]


def hourly_consumption(power: DataFrame) -> DataFrame:
    """hour, consumption: watt-hours summed over each hour of kilowatt minutes, empty hours 0."""
    wh = power.withColumn("wh", F.col("Global_active_power") * 1000 / 60)
    return resample.resample(wh, "datetime", "1 hour", {"consumption": F.sum("wh")}, zero=("consumption",)).withColumnRenamed("bin", "hour")


def forecast_features(hourly: DataFrame, temperature: DataFrame, calendar: str = "fr") -> DataFrame:
    """Consumption with that of a day and a week before, calendar columns, holiday flag and temperature; complete rows only."""
    lagged = resample.calendar_lag(hourly, "hour", "consumption", {"past_day": "1 DAY", "past_week": "7 DAYS"})
    degrees = clean.sentinel_to_null(temperature, "temperature", -9999.0).groupBy(dates.truncated(F.col("datetime"), "hour").alias("hour")).agg(F.avg("temperature").alias("temperature"))
    ends = hourly.agg(F.min(F.year("hour")), F.max(F.year("hour"))).first()
    free = dates.holidays(hourly.sparkSession, range(ends[0] or 0, (ends[1] or -1) + 1), calendar).select("date").distinct() if ends[0] else hourly.select(F.to_date("hour").alias("date")).limit(0)
    t = F.col("time")
    rows = lagged.join(degrees, "hour").withColumn("date", F.to_date("hour")).join(F.broadcast(free.withColumn("_free", F.lit(1))), "date", "left")
    rows = rows.withColumnRenamed("hour", "time").withColumns({"hour": F.hour(t), "weekday": F.weekday(t), "month": F.month(t), "holiday": F.coalesce("_free", F.lit(0))})
    return rows.select("time", "consumption", *FEATURES).na.drop("any")


def forecast_errors(features: DataFrame, strategy: str = "all_before", model=None, keys: list[str] = ()) -> DataFrame:
    """Mean absolute error per month, each predicted from the months before it (all, or the last)."""
    rows = features.withColumn("fold", F.date_format("time", "yyyy-MM"))
    rows = rows if keys else rows.withColumn("series", F.lit(0))
    return learning.walk_forward(rows, list(keys) or ["series"], "time", FEATURES, "consumption", "fold", model, strategy)


def households(spark: SparkSession, path: str) -> DataFrame:
    raw = datasets.read(spark, "households", path)
    return raw.select("consumer", datasets.stamp("timestamp").alias("ts"), "consumption")


def household_features(rows: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    """Per consumer and half-hour: lagged consumption, position in year and day, and the next reading (target); complete rows only."""
    moy, hod = dates.cyclic(F.month("ts"), 12), dates.cyclic(F.hour("ts"), 23)
    out = rows.withColumns({"moy_sin": moy[0], "moy_cos": moy[1], "hod_sin": hod[0], "hod_cos": hod[1]})
    return resample.row_lags(out, "consumption", "ts", lags, ["consumer"], [1]).withColumnRenamed("consumption_lead1", "target")


def scaled_per_household(rows: DataFrame, train_end: str) -> DataFrame:
    """Consumption scaled to 0..1 by each consumer's minimum and maximum before train_end."""
    ends = rows.where(F.col("ts") < F.lit(train_end).cast("timestamp_ntz")).groupBy("consumer").agg(F.min("consumption").alias("_lo"), F.max("consumption").alias("_hi"))
    unit = F.coalesce(F.try_divide(F.col("consumption") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(F.col("consumption").isNotNull(), 0.0))
    return rows.join(ends, "consumer").withColumn("consumption", unit).drop("_lo", "_hi")


def parts(rows: DataFrame, train_end: str, test_end: str) -> dict[str, DataFrame]:
    """train, test and val by half-open ranges of time."""
    t, a, b = F.col("ts"), F.lit(train_end).cast("timestamp_ntz"), F.lit(test_end).cast("timestamp_ntz")
    return {"train": rows.where(t < a), "test": rows.where((t >= a) & (t < b)), "val": rows.where(t >= b)}


def evaluation_vectors(losses: DataFrame, worker: str = "consumer") -> DataFrame:
    """Each worker's losses under the donated trees, standardised per worker, as one array in the order of donors."""
    w = Window.partitionBy(worker)
    z = F.coalesce(F.try_divide(F.col("rmse") - F.avg("rmse").over(w), F.stddev_pop("rmse").over(w)), F.lit(0.0))
    rows = losses.withColumn("_z", z).groupBy(worker).agg(F.sort_array(F.collect_list(F.struct("donor", "tree_no", "_z"))).alias("_v"))
    return rows.select(worker, F.transform("_v", lambda x: x["_z"]).alias("vector"))


def daily_errors(predicted: DataFrame, worker: str = "consumer") -> DataFrame:
    """Root mean square error per worker and day of (target, predicted)."""
    e = F.col("target") - F.col("predicted")
    return predicted.groupBy(worker, F.to_date("ts").alias("day")).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def maintenance(flags: DataFrame, clusters: DataFrame, worker: str = "consumer", support: float = 0.033, share: float = 0.16) -> DataFrame:
    """Per cluster of workers: how many there are and drifted, whether its model is still supported, and whether to retrain.

    A model is supported while its cluster holds more than `support` of all workers that haven't drifted; a
    cluster is retrained once `share` of its workers or more have drifted.
    """
    drifted = flags.groupBy(worker).agg(F.max(F.col("drift").cast("int")).alias("drifted"))
    rows = clusters.join(drifted, worker, "left").na.fill(0, ["drifted"])
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_workers"), F.sum("drifted").alias("n_drifted"))
    total = per.agg(F.sum("n_workers").alias("_all"))
    per = per.crossJoin(F.broadcast(total))  # one row
    kept = (F.col("n_workers") - F.col("n_drifted")) / F.col("_all") > support
    return per.select("cluster", "n_workers", "n_drifted", kept.alias("supported"), (F.col("n_drifted") / F.col("n_workers") >= share).alias("retrain"))
