"""Bike trips between docking stations: enrichment, popularity, balance and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources import datasets

WEEKDAYS, WEEKEND = ["Mon", "Tue", "Wed", "Thu", "Fri"], ["Sat", "Sun"]
MORNING, EVENING = [7, 8, 9], [16, 17, 18]
#: Stations up to which their table is sent whole to each task.
BROADCAST_STATIONS = 100_000


def trips(spark: SparkSession, path: str, time_format: str = "M/d/yyyy H:mm") -> DataFrame:
    raw = datasets.read(spark, "trips", path)
    return raw.withColumns({c: F.coalesce(datasets.stamp(c, time_format), datasets.stamp(c)) for c in ("starttime", "stoptime")})


def stations(spark: SparkSession, path: str) -> DataFrame:
    return datasets.read(spark, "stations", path).withColumnRenamed("long", "lon")


def enriched(trips_: DataFrame) -> DataFrame:
    """Minutes, age, month, day and hour of the start; unknown genders are named so."""
    t = F.col("starttime")
    return trips_.withColumns({
        "minutes": F.col("tripduration") / 60, "age": F.year(t) - F.col("birthyear").cast("int"), "gender": F.coalesce("gender", F.lit("Unknown")),
        "month": F.date_format(t, "MMM"), "day": F.date_format(t, "EEE"), "hour": F.hour(t),
    })


def located(trips_: DataFrame, stations_: DataFrame, elevation: bool = False) -> DataFrame:
    """Trips with from_ and to_ coordinates; trips of unknown stations go."""
    kept = ["lat", "lon", *(["elevation"] if elevation else [])]
    few = stations_.limit(BROADCAST_STATIONS + 1).count() <= BROADCAST_STATIONS
    out = trips_
    for side in ("from", "to"):
        place = stations_.select(F.col("name").alias(f"{side}_station_name"), *(F.col(c).alias(f"{side}_station_{c}") for c in kept))
        out = out.join(F.broadcast(place) if few else place, f"{side}_station_name")
    return out


def dataset_stats(trips_: DataFrame) -> DataFrame:
    pairs = trips_.where("bikeid is not null").select("bikeid", "trip_id").distinct()
    rest = trips_.agg(F.countDistinct("bikeid").alias("n_bikes"), F.countDistinct("from_station_id").alias("n_stations"), F.to_date(F.min("starttime")).alias("first_date"), F.to_date(F.max("stoptime")).alias("last_date"))
    return pairs.agg(F.count("trip_id").alias("n_trips")).crossJoin(F.broadcast(rest))


def by_gender(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gender").agg(F.count("trip_id").alias("n_trips"), F.avg("minutes").alias("minutes"))


def destination_popularity(rows: DataFrame, first: str = "Female", second: str = "Male") -> DataFrame:
    """Per destination that both genders reach: each one's share of its own trips, and the shares' ratios; one pass for both."""
    n = {g: F.count(F.when(F.col("gender") == g, F.col("bikeid"))) for g in (first, second)}
    total = rows.agg(*(F.count(F.when(F.col("gender") == g, 1)).alias(f"_t{k}") for k, g in enumerate((first, second))))
    per = rows.where("to_station_name is not null").groupBy("to_station_name").agg(n[first].alias("_n0"), n[second].alias("_n1"), F.min_by("to_station_lat", "trip_id").alias("lat"), F.min_by("to_station_lon", "trip_id").alias("lon"))
    per = per.where("_n0 > 0 and _n1 > 0").crossJoin(F.broadcast(total))  # one row
    a, b = F.col("_n0") / F.col("_t0"), F.col("_n1") / F.col("_t1")
    return per.select("to_station_name", "lat", "lon", a.alias("share_first"), b.alias("share_second"), (a / b).alias("first_to_second"), (b / a).alias("second_to_first"))


def on_days(rows: DataFrame, days: list[str], hours: list[int] | None = None) -> DataFrame:
    out = rows.where(F.col("day").isin(days))
    return out.where(F.col("hour").isin(hours)) if hours else out


def top_destinations(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n stations most trips go to."""
    per = rows.where("to_station_name is not null").groupBy("to_station_name").agg(F.count("to_station_id").alias("n"), F.min_by("to_station_lat", "trip_id").alias("lat"), F.min_by("to_station_lon", "trip_id").alias("lon"))
    return per.orderBy(F.desc("n"), "to_station_name").limit(n)


def morning_destinations(rows: DataFrame, n: int = 10) -> DataFrame:
    return top_destinations(on_days(rows, WEEKDAYS, MORNING), n)


def evening_destinations(rows: DataFrame, n: int = 10) -> DataFrame:
    return top_destinations(on_days(rows, WEEKDAYS, EVENING), n)


def popular_with(rows: DataFrame, gender: str, n: int = 10, days: list[str] | None = None, hours: list[int] | None = None) -> DataFrame:
    """destination_popularity of the n stations that a gender reaches most on some days and hours."""
    some = on_days(rows, days or WEEKDAYS, hours)
    top = top_destinations(some.where(F.col("gender") == gender), n).select("to_station_name")
    return destination_popularity(some).join(F.broadcast(top), "to_station_name", "left_semi")  # n rows


def station_balance(rows: DataFrame) -> DataFrame:
    """Per station that trips both leave and reach: departures, arrivals, difference."""
    end = lambda side, out: F.struct(F.col(f"{side}_station_name").alias("station"), F.lit(out).alias("out"))
    ends = rows.select(F.explode(F.array(end("from", 1), end("to", 0))).alias("e")).select("e.*")
    per = ends.where("station is not null").groupBy("station").agg(F.sum("out").alias("departures"), F.sum(1 - F.col("out")).alias("arrivals"))
    return per.where("departures > 0 and arrivals > 0").withColumn("difference", F.col("arrivals") - F.col("departures"))


def unbalanced(rows: DataFrame, n: int = 10) -> DataFrame:
    return station_balance(rows).orderBy(F.desc(F.abs("difference")), "station").limit(n)


def durations(rows: DataFrame) -> DataFrame:
    """Median minutes and number of trips for each pair of stations."""
    pairs = rows.na.drop(subset=["from_station_name", "to_station_name"])
    return pairs.groupBy("to_station_name", "from_station_name").agg(F.percentile("minutes", 0.5).alias("median_minutes"), F.count("minutes").alias("n"))


def unbalanced_durations(rows: DataFrame, n: int = 10) -> DataFrame:
    """durations() between two different ones of the n most unbalanced stations; the trips are filtered before they are grouped."""
    some = unbalanced(rows, n)
    out = rows.where("from_station_name != to_station_name")
    for side in ("from", "to"):
        out = out.join(F.broadcast(some.select(F.col("station").alias(f"{side}_station_name"))), f"{side}_station_name", "left_semi")  # n rows
    return durations(out)


def per_hour(rows: DataFrame, days: list[str]) -> DataFrame:
    """Trips per hour on those weekdays, divided by how many weekdays they are."""
    return on_days(rows, days).groupBy("hour").agg((F.count(F.lit(1)) / len(days)).alias("n"))


def per_period(rows: DataFrame, period: str) -> DataFrame:
    """Median minutes and trips per day or month name."""
    return rows.groupBy(period).agg(F.percentile("minutes", 0.5).alias("median_minutes"), F.count("starttime").alias("n_trips"))
