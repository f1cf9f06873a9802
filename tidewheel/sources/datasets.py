"""Declared schemas and readers of the time-series and tabular datasets, and plain sinks.

Readers take a path that Spark opens itself, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reader options and columns per dataset. Fixed values.
SCHEMAS: dict[str, tuple[dict[str, str], str]] = {
    "wind": ({"sep": ";", "header": "true"}, "Wind_turbine_name string, Date_time string, P_avg double, Ws_avg double, Ot_avg double, Wa_avg double"),
    "train_arrivals": ({"header": "true"}, "train_id string, direction string, origin string, next_station string, date string, status string, timeStamp string"),
    "train_positions": ({"header": "true"}, "train_id string, status string, next_station string, source string, dest string, lon double, lat double, track_change string, date string, timeStamp0 string, timeStamp1 string, seconds long"),
    "trips": ({"header": "true"}, "trip_id long, starttime string, stoptime string, bikeid string, tripduration double, from_station_name string, to_station_name string, from_station_id string, to_station_id string, usertype string, gender string, birthyear double"),
    "stations": ({"header": "true"}, "name string, terminal string, lat double, long double, dockcount int, online string, elevation double"),
    "power": ({"sep": ";", "header": "true", "nullValue": "?"}, "Date string, Time string, Global_active_power double, Global_reactive_power double, Voltage double, Global_intensity double, Sub_metering_1 double, Sub_metering_2 double, Sub_metering_3 double"),
    "temperature": ({"header": "true"}, "datetime string, temperature double"),
    "households": ({"header": "true"}, "row long, consumer string, timestamp string, consumption double"),
    "drives": ({"header": "true"}, "time string, minXAcc double, maxXAcc double, minYAcc double, maxYAcc double, minZAcc double, maxZAcc double"),
    "cycles": ({"sep": " ", "header": "false"}, "id int, cycle int, setting1 double, setting2 double, setting3 double, " + ", ".join(f"s{k} double" for k in range(1, 22))),
    "crossings": ({"header": "true"}, "row long, Node string, Timestamp string, Date string, Time string, Hour int, DayOfWeek int, direction_0 double, direction_1 double, Total double"),
    "vibration": ({"sep": " ", "header": "false"}, "x double, y double, z double, tachometer double"),
}


def read(spark: SparkSession, name: str, path: str | list[str]) -> DataFrame:
    """A dataset by name, with its schema declared, not inferred."""
    options, schema = SCHEMAS[name]
    return spark.read.options(**options).schema(schema).csv(path)


def stamp(text: str, pattern: str | None = None):
    """A timestamp without zone from text, null where it can't be read; an offset at its end is cut off."""
    cut = F.regexp_replace(F.col(text), r"[+-]\d{2}:\d{2}$", "")
    return F.try_to_timestamp(cut, F.lit(pattern)).cast("timestamp_ntz") if pattern else F.try_to_timestamp(cut).cast("timestamp_ntz")


def wind(spark: SparkSession, path: str) -> DataFrame:
    raw = read(spark, "wind", path)
    return raw.select(stamp("Date_time").alias("datetime"), F.col("Wind_turbine_name").alias("turbine"), F.col("P_avg").alias("power"), F.col("Ws_avg").alias("wind_speed"), F.col("Ot_avg").alias("temperature"), F.col("Wa_avg").alias("wind_direction")).na.drop("any")


def power(spark: SparkSession, path: str) -> DataFrame:
    raw = read(spark, "power", path).withColumn("_at", F.concat_ws(" ", "Date", "Time"))
    return raw.withColumn("datetime", stamp("_at", "d/M/yyyy HH:mm:ss")).drop("Date", "Time", "_at")


def vibration(spark: SparkSession, path: str) -> DataFrame:
    """Signals with speed, torque and run taken from the file name, V<rpm>_<torque>N_<run>.txt."""
    raw = read(spark, "vibration", path).withColumn("_file", F.col("_metadata.file_name"))
    part = lambda p: F.regexp_extract("_file", p, 1).try_cast("int")
    return raw.withColumns({"rpm": part(r"V(\d+)_"), "torque": part(r"_(\d+)N"), "run": F.coalesce(part(r"N_(\d+)"), part(r"^(\d+)_V"))}).drop("_file")


def climate_years(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Hourly temperature from yearly files whose TMP is '+0123,1': tenths of a degree and a quality flag."""
    raw = spark.read.options(header=True).csv(paths)
    return raw.select(stamp("DATE").alias("datetime"), (F.regexp_extract("TMP", r"^([+-]?\d+)", 1).try_cast("double") / 10).alias("temperature"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The Parquet table at path, written from make() if it isn't there or force is set."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))
    if force or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matching_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, name, length, modificationTime of the files under a folder, at any depth, whose names start with a match; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), "length", "modificationTime").where(F.col("name").rlike(f"^(?:{pattern})"))


def as_float32(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema.fields if f.dataType.typeName() == "double"})


def written_size(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Bytes of df written in a format, doubles as 32-bit floats."""
    as_float32(df).write.mode("overwrite").option("header", True).format(fmt).save(path)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
