"""Filters, predicates, null handling, imputation, sampling and grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN and infinities of fractional columns become null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, FractionalType)})


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the columns of `names`, under their new names."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def reject_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value has no match of the pattern."""
    return df.where(~F.col(column).rlike(pattern))


def reject_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def sentinel_to_null(df: DataFrame, column: str, sentinel) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != sentinel, F.col(column)))


def period_slice(df: DataFrame, time_col: str, first: str, last: str) -> DataFrame:
    """Rows from the start of `first` to the end of `last`; both are years, months or days as text."""
    unit = {4: "YEAR", 7: "MONTH", 10: "DAY"}
    start = lambda t: F.lit(t + "-01-01"[len(t) - 4 :]).cast("timestamp_ntz")
    return df.where((F.col(time_col) >= start(first)) & (F.col(time_col) < start(last) + F.expr(f"INTERVAL 1 {unit[len(last)]}")))


def half_open(df: DataFrame, time_col: str, first: str, end: str) -> DataFrame:
    return df.where((F.col(time_col) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time_col) < F.lit(end).cast("timestamp_ntz")))


def same_group(df: DataFrame, record: dict) -> DataFrame:
    """Rows equal to the record in all of its columns."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in record.items())))


def groups_larger_than(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with more than `least` rows: a count per group (combined map-side) and a semi-join."""
    big = df.groupBy(*keys).count().where(F.col("count") > least).select(*keys)
    return df.join(big, keys, "left_semi")


def semi(df: DataFrame, other: DataFrame, on: str, other_col: str | None = None) -> DataFrame:
    return df.join(other.select(F.col(other_col or on).alias(on)).distinct(), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: str, other_col: str | None = None) -> DataFrame:
    return df.join(other.select(F.col(other_col or on).alias(on)).distinct(), on, "left_anti")


def impute(df: DataFrame, columns: list[str], least: int = 0, by: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Nulls replaced by the column's aggregate where at least `least` values are there; one row of aggregates is joined."""
    stats = df.agg(*(by(F.col(c)).alias(f"_a_{c}") for c in columns), *(F.count(c).alias(f"_n_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.when(F.col(f"_n_{c}") >= least, F.col(f"_a_{c}"))) for c in columns}).select(*df.columns)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that any rerun picks again: those with the smallest hashes of their key, which tells rows apart.

    Hashes are counted by their first 16 bits; only the rows of the group that holds the n-th are sorted.
    """
    rows = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.shiftright("_h", 48))
    run = F.sum("count").over(Window.orderBy("_b"))  # over 65,536 counts at most
    cut = rows.groupBy("_b").count().withColumn("_run", run).where(F.col("_run") >= n).agg(F.min(F.struct("_b", (F.col("_run") - F.col("count")).alias("before"))).alias("_cut"))
    marked = rows.crossJoin(F.broadcast(cut))  # one row
    whole = marked.where(F.col("_cut").isNull() | (F.col("_b") < F.col("_cut._b")))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    rest = marked.where(F.col("_b") == F.col("_cut._b")).withColumn("_rank", rank).where(F.col("_rank") <= n - F.col("_cut.before"))
    return whole.select("_h", *df.columns).unionByName(rest.select("_h", *df.columns)).orderBy("_h", key).select(*df.columns)


def grid(spark, values: dict[str, list]) -> DataFrame:
    """Every combination of the listed values."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def threshold_percent(df: DataFrame, limits: dict[str, float], suffix: str = "_pct") -> DataFrame:
    """Each column as percent of its limit."""
    return df.withColumns({c + suffix: 100 * F.col(c) / F.lit(float(v)) for c, v in limits.items()})


def severity(columns: list[str], classes: list[tuple[str, float, float]], none: str = "No event") -> Column:
    """The last class (name, low, high) with any column above low and any below high."""
    out = F.lit(none)
    for name, low, high in classes:
        above, below = (reduce(lambda a, b: a | b, x) for x in ([F.col(c) > low for c in columns], [F.col(c) < high for c in columns]))
        out = F.when(above & below, F.lit(name)).otherwise(out)
    return out
