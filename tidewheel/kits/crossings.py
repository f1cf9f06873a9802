"""Bike crossings counted per node and hour: overviews, profiles of days, and days unlike their weekday."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import dates
from tidewheel.operators import learning, resample
from tidewheel.operators.blocks import saved
from tidewheel.sources import datasets

HOURS = list(range(24))


def crossings(spark: SparkSession, path: str) -> DataFrame:
    raw = datasets.read(spark, "crossings", path)
    return raw.withColumn("ts", datasets.stamp("Timestamp")).select(F.col("Node").alias("node"), "ts", F.hour("ts").alias("hour"), (F.weekday("ts") + 1).alias("day_of_week"), "direction_0", "direction_1", F.col("Total").alias("total"))


def node_ranges(df: DataFrame) -> DataFrame:
    return df.where("node is not null").groupBy("node").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("total").alias("total"))


def week_grid(df: DataFrame, per_node: bool = False) -> DataFrame:
    """Crossings by weekday (rows) and hour (columns), for each node if asked."""
    return df.groupBy(*(["node"] if per_node else []), "day_of_week").pivot("hour", HOURS).agg(F.sum("total")).na.fill(0)


def daily_totals(df: DataFrame) -> DataFrame:
    return df.where("ts is not null").groupBy(F.to_date("ts").alias("date")).agg(F.sum("total").alias("total"))


def time_of_day(df: DataFrame) -> DataFrame:
    """Mean crossings by node and hour."""
    return df.groupBy("node", "hour").agg(F.avg("total").alias("total"))


def node_totals(df: DataFrame, nodes: list[str], freq: str = "1 day") -> DataFrame:
    """bin and a column of totals for each node; 0 for bins without a row."""
    full = resample.resample(df, "ts", freq, {"total": F.sum("total")}, ["node"], ("total",))
    return full.groupBy("bin").pivot("node", nodes).agg(F.first("total")).na.fill(0)


def day_profiles(df: DataFrame) -> DataFrame:
    """A row per day: its weekday and the crossings of each hour, h0 to h23; hours without a row are 0."""
    rows = df.where("ts is not null").groupBy(F.to_date("ts").alias("date")).pivot("hour", HOURS).agg(F.sum("total")).na.fill(0)
    return rows.select("date", (F.weekday("date") + 1).alias("day_of_week"), *(F.col(str(h)).cast("double").alias(f"h{h}") for h in HOURS))


def day_clusters(profiled: DataFrame, k: int = 2, seed: int = 1) -> DataFrame:
    """date, day_of_week, pc1, pc2, cluster: two principal components of the days, and a Gaussian mixture on them."""
    flat = saved(learning.projected(profiled, [f"h{h}" for h in HOURS], 2).select("date", "day_of_week", "pc1", "pc2"), "days")  # read once per iteration; a row per day
    rows = learning.assembled(flat, ["pc1", "pc2"], "pair")
    model = GaussianMixture(featuresCol="pair", predictionCol="cluster", k=k, maxIter=50, seed=seed).fit(rows)
    return model.transform(rows).select("date", "day_of_week", "pc1", "pc2", "cluster")


def unlike_their_weekday(clustered: DataFrame, calendar: str = "us") -> DataFrame:
    """Working days in the cluster that most weekend days are in, with the holiday they fall on, if any."""
    weekend = clustered.where("day_of_week > 5").groupBy("cluster").count().orderBy(F.desc("count"), "cluster").limit(1).select("cluster")
    ends = clustered.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    rows = clustered.where("day_of_week <= 5").join(F.broadcast(weekend), "cluster", "left_semi")  # one row
    if ends[0] is None:
        return rows.withColumn("holiday", F.lit(None).cast("string"))
    free = dates.holidays(clustered.sparkSession, range(ends[0], ends[1] + 1), calendar)
    return rows.join(F.broadcast(free), "date", "left")
