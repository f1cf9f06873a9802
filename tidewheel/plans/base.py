"""Registration of queries with their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register fn(read) under a name; read(table) gives a driver table."""

        def put(fn: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            if sql:
                self.sql[name] = sql
            return fn

        return put


def rounded(*names: str, digits: int = 6) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


def half_up(name: str, digits: int) -> Column:
    """The column rounded half away from zero in plain arithmetic, as DuckDB does it; F.round makes a BigDecimal of each value."""
    x, scale = F.col(name), F.lit(10.0**digits)
    y = F.abs(x) * scale
    up = F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)  # rint takes halves to the even side
    return F.when(y < 2.0**52, F.signum(x) * up / scale + 0.0).otherwise(x)
