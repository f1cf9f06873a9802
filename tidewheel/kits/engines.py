"""Remaining useful life of engines from cycles of sensor readings."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import learning, resample
from tidewheel.sources import datasets

SENSORS = [f"s{k}" for k in range(1, 22)]
INPUTS = ["setting1", "setting2", "setting3", *SENSORS]
#: Cycles to failure from which on an engine counts as failing, and cycles of a window.
SOON, LENGTH = 30, 50


def cycles(spark: SparkSession, path: str) -> DataFrame:
    return datasets.read(spark, "cycles", path).where("id is not null")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """id, more: the cycles each test engine had left; engines are numbered by their line in the file, a line each."""
    raw = spark.read.options(sep=" ").schema("more int").csv(path).where("more is not null").withColumn("_line", F.monotonically_increasing_id())
    return raw.select(F.row_number().over(Window.orderBy("_line")).alias("id"), "more")  # a row per engine


def with_remaining(df: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """rul: cycles to the last one seen, and what the engine had left after it."""
    out = df.withColumn("rul", F.max("cycle").over(Window.partitionBy("id")) - F.col("cycle"))
    return out if left is None else out.join(left, "id", "left").withColumn("rul", F.col("rul") + F.coalesce("more", F.lit(0))).drop("more")


def with_label(df: DataFrame, soon: int = SOON) -> DataFrame:
    return df.withColumn("label", (F.col("rul") <= soon).cast("int"))


def scaled_like(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of df scaled to 0..1 by the minima and maxima of train; 0 where train has one value only."""
    ends = train.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.when(F.col(c).isNotNull(), 0.0))
    return df.crossJoin(F.broadcast(ends)).withColumns({c: unit(c) for c in columns}).select(*df.columns)  # one row


def windows(labelled: DataFrame, columns: list[str], length: int = LENGTH) -> DataFrame:
    """A row per cycle with `length` cycles before it: those as an array of structs, and its label."""
    return resample.sequence_windows(labelled, columns, "cycle", length, ["id"], "label")


def last_windows(labelled: DataFrame, columns: list[str], length: int = LENGTH) -> DataFrame:
    """The last `length` cycles of each engine that has as many, in order, and its last label."""
    w = Window.partitionBy("id").orderBy(F.desc("cycle"))
    rows = labelled.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= length)
    out = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("cycle", *columns))).alias("window"), F.max_by("label", "cycle").alias("label"))
    return out.where(F.size("window") == length)


def window_features(windowed: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, last value and change of each column over its window, in place of a recurrent network's state."""
    at = lambda c, k: F.element_at(F.col("window"), k).getField(c)
    mean = lambda c: F.aggregate(F.col("window"), F.lit(0.0), lambda a, x: a + x[c]) / F.size("window")
    return windowed.withColumns({f"{c}_mean": mean(c) for c in columns} | {f"{c}_last": at(c, -1).cast("double") for c in columns} | {f"{c}_change": (at(c, -1) - at(c, 1)).cast("double") for c in columns})


def fitted(train: DataFrame, columns: list[str], rounds: int = 20, seed: int = 1):
    """Boosted trees on window_features(); a Spark ML model, saved and loaded by its own writer."""
    names = [f"{c}_{n}" for c in columns for n in ("mean", "last", "change")]
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, seed=seed).fit(learning.assembled(train, names))


def predicted(model, df: DataFrame, columns: list[str]) -> DataFrame:
    names = [f"{c}_{n}" for c in columns for n in ("mean", "last", "change")]
    out = model.transform(learning.assembled(df, names))
    return out.select("id", "label", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("score"))


def sensor_curves(df: DataFrame, ids: list[int], sensors: list[str] = SENSORS) -> DataFrame:
    """cycle, sensor and a column of values for each of some engines."""
    long = df.where(F.col("id").isin(ids)).unpivot(["id", "cycle"], sensors, "sensor", "value")
    return long.groupBy("cycle", "sensor").pivot("id", ids).agg(F.first("value"))
