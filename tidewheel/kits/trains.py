"""Train punctuality: arrivals (one row per train, station and pass) and positions.

Arrivals have train_id, direction, origin, next_station, date, status, ts; positions train_id, status,
next_station, source, dest, lon, lat, track_change, date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.dates import day_type
from tidewheel.functions.geo import geodesic
from tidewheel.functions.text import status_minutes
from tidewheel.operators import clean, resample
from tidewheel.sources import datasets

RUN = ["train_id", "date"]
PASS = ["train_id", "next_station", "date"]
#: Delays, in minutes, that stand for a suspended train. Fixed values.
SUSPENDED = [999, 1440]


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    raw = datasets.read(spark, "train_arrivals", path)
    return raw.withColumns({"date": F.col("date").try_cast("date"), "ts": datasets.stamp("timeStamp")}).drop("timeStamp")


def positions(spark: SparkSession, path: str) -> DataFrame:
    raw = datasets.read(spark, "train_positions", path)
    return raw.withColumns({"date": F.col("date").try_cast("date"), "timeStamp0": datasets.stamp("timeStamp0"), "timeStamp1": datasets.stamp("timeStamp1")})


def valid(df: DataFrame) -> DataFrame:
    """Rows whose train number is all digits and whose station is known."""
    return clean.reject_values(clean.reject_pattern(df, "train_id", "[^0-9]"), "next_station", ["None"])


def passes(arrived: DataFrame) -> DataFrame:
    """How often each train was at each station on each date, and whether once only."""
    return arrived.na.drop(subset=PASS).groupBy(*PASS).agg(F.count(F.lit(1)).alias("n_occurrences")).withColumn("single_pass", F.col("n_occurrences") == 1)


def single_passes(df: DataFrame, arrived: DataFrame) -> DataFrame:
    """Rows of df whose train was at the station once on that date, by the arrivals."""
    return df.join(passes(arrived).where("single_pass").select(*PASS), PASS, "left_semi")


def with_delay(df: DataFrame) -> DataFrame:
    """status, a number of minutes as text in either notation, as delay; rows without one go."""
    delay = F.coalesce(status_minutes(F.col("status")), F.col("status").try_cast("int"))
    return df.withColumn("delay", delay).where("delay is not null").drop("status")


def running(df: DataFrame) -> DataFrame:
    return clean.reject_values(df, "delay", SUSPENDED)


def overview(arrived: DataFrame) -> DataFrame:
    """Stations, trains, train runs, first and last date, and the percentage of arrivals under 6 minutes late."""
    return arrived.agg(
        F.countDistinct("next_station").alias("n_stations"), F.countDistinct("train_id").alias("n_trains"), F.countDistinct(*RUN).alias("n_runs"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), (100 * F.avg((F.col("delay") < 6).cast("int"))).alias("percent_on_time"),
    )


def time_features(arrived: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return arrived.withColumns({"day": F.date_format(ts, "EEE"), "hour": F.date_format(ts, "HH"), "weekend": F.weekday(ts) >= 5, "day_type": day_type(ts)})


def hourly_trains(timed: DataFrame) -> DataFrame:
    """Distinct trains per hour of the day, over weekdays."""
    return timed.where(~F.col("weekend")).groupBy("hour").agg(F.countDistinct("train_id").alias("n_trains"))


def with_rush_hour(timed: DataFrame, share: float = 0.75) -> DataFrame:
    """rush_hour: on weekdays, in hours with more trains than that percentile over weekdays and hours."""
    per_day = timed.where(~F.col("weekend")).groupBy("day", "hour").agg(F.countDistinct("train_id").alias("n"))
    cut = per_day.agg(F.percentile("n", share).alias("_cut"))
    busy = hourly_trains(timed).crossJoin(F.broadcast(cut)).where(F.col("n_trains") > F.col("_cut")).select("hour", F.lit(True).alias("_busy"))  # 24 rows at most
    return timed.join(F.broadcast(busy), "hour", "left").withColumn("rush_hour", ~F.col("weekend") & F.coalesce("_busy", F.lit(False))).drop("_busy")


def with_rank(arrived: DataFrame) -> DataFrame:
    """rank: position of the stop in its run, equal times sharing one."""
    return arrived.withColumn("rank", F.dense_rank().over(Window.partitionBy(*RUN).orderBy("ts")))


def station_coordinates(positioned: DataFrame) -> DataFrame:
    return positioned.na.drop(subset=["next_station"]).groupBy("next_station").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def with_distance(ranked: DataFrame, positioned: DataFrame) -> DataFrame:
    """previous_station and the kilometres from it, and since the run's start; first stops have no distance and a running one of 0.

    Distances are computed once per pair of neighbouring stations, then joined to the stops.
    """
    w = Window.partitionBy(*RUN).orderBy("rank", "next_station")
    stops = ranked.withColumn("previous_station", F.lag("next_station").over(w))
    at = station_coordinates(positioned)
    links = stops.select("previous_station", "next_station").where("previous_station is not null").distinct()
    links = links.join(at, "next_station").join(at.select(F.col("next_station").alias("previous_station"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0")), "previous_station")
    links = links.select("previous_station", "next_station", geodesic("lat0", "lon0", "lat", "lon").getField("km").alias("distance"))
    out = stops.join(links, ["previous_station", "next_station"], "left")
    return out.withColumn("running_distance", F.coalesce(F.sum("distance").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def with_running_delay(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy(*RUN).orderBy("rank", "next_station").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running_delay", F.sum("delay").over(w))


def run_totals(distanced: DataFrame) -> DataFrame:
    """Per run: kilometres, delay summed over its stops, and the delay at the last stop."""
    return distanced.groupBy(*RUN).agg(F.sum("distance").alias("distance"), F.sum("delay").alias("delay"), F.max_by("delay", F.struct("rank", "next_station")).alias("last_delay"))


def station_delays(arrived: DataFrame) -> DataFrame:
    rows = arrived.na.drop(subset=["direction", "next_station"])
    return rows.groupBy("direction", "next_station").agg(F.avg("delay").alias("mean"), F.stddev_samp("delay").alias("sd"), F.count("delay").alias("n"))


def with_long_delay_station(arrived: DataFrame, share: float = 0.9) -> DataFrame:
    """long_delay_station: its mean delay, by direction, is above that percentile of all stations' means."""
    per = station_delays(arrived)
    late = per.crossJoin(F.broadcast(per.agg(F.percentile("mean", share).alias("_cut")))).where(F.col("mean") > F.col("_cut"))
    late = late.select("direction", "next_station", F.lit(True).alias("_late"))
    return arrived.join(late, ["direction", "next_station"], "left").withColumn("long_delay_station", F.coalesce("_late", F.lit(False))).drop("_late")


def with_last_week_delay(arrived: DataFrame) -> DataFrame:
    """last_week_delay: mean delay of the same train at the same station on the seven days before; 0 if there is none."""
    return resample.trailing_mean(arrived, "delay", "date", 7, ["train_id", "next_station"], "last_week_delay")


def track_changes(positioned: DataFrame) -> DataFrame:
    """Per train, station and date: whether any track change was announced, and the delay summed."""
    changed = (F.col("track_change").cast("string") != "-1").cast("int")
    return positioned.na.drop(subset=PASS).groupBy(*PASS).agg(F.coalesce(F.max(changed), F.lit(0)).alias("changed"), F.sum("delay").alias("delay"))


def change_frequency(changes: DataFrame) -> DataFrame:
    """Share of a station's trains on a date that changed track."""
    return changes.groupBy("next_station", "date").agg(F.avg("changed").alias("frequency"))


def mean_change_frequency(frequency: DataFrame) -> DataFrame:
    return frequency.groupBy("next_station").agg(F.avg("frequency").alias("frequency")).orderBy(F.desc("frequency"), "next_station")
