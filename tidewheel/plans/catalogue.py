"""Worked queries over the driver tables, each with the DuckDB SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.plans import charts, exploration, models, relations, timeseries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (relations, timeseries, exploration, charts, models):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
