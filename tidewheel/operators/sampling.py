"""Samples with replacement: exactly n draws, the same ones on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import chunks

#: Hexadecimal digits of a digest that make a number, and the number of their values.
DIGITS, VALUES = 13, 1 << 52


def digest_number(text: Column) -> Column:
    """A whole number under VALUES from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def with_replacement(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of df drawn with replacement, with copy (1, 2, ... of each row).

    Rows are numbered in the order of a digest of their key, over chunks, so that no task holds them all; a draw's own
    digest gives the number that it takes. Draws are counted by number before they meet the rows, so that the counts
    are multinomial whatever the partitions. Keys tell rows apart; a null key counts as the text "null". An empty table
    gives no rows.
    """
    total = df.count()
    spark = df.sparkSession
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = df.withColumn("_o", F.concat(F.md5(F.concat(F.lit(f"{seed}/"), name)), name))
    places, _ = chunks.positions(rows, "_o", [])
    draw = digest_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    draws = spark.range(n if total else 0).select((F.floor(draw.cast("double") * total / VALUES) + 1).alias("_i")).groupBy("_i").count()
    return places.join(draws, "_i").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).select(*df.columns, "copy")
