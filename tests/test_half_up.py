"""Rounding in plain arithmetic against DuckDB's, and the pair queries that use it."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewheel.functions.angles import angular_distance
from tidewheel.plans.base import half_up
from tidewheel.plans.catalogue import QUERIES


def test_as_duckdb_rounds(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 0.5, 0.00005, -0.00005, 1.00005, 2.00015, 0.00012499999999999998, 1e300, -1e308, 4.9999999999999994e-5, 2.0**53, 1e13 + 0.3]
    values += (rng.integers(-(10**7), 10**7, 3000) / 10**5).tolist() + rng.normal(0, 1000, 2000).tolist()
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").withColumn("x", half_up("x", 4)).orderBy("k").collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchone()[0] for v in values[:400]]
    for v, g, w in zip(values, got, want, strict=False):
        assert g == w or (abs(v) * 1e4 >= 2**52 and g == v), (v, g, w)
    assert all(abs(g - v) <= 0.00005 + 1e-9 for v, g in zip(values, got, strict=True) if abs(v) < 1e9)
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double").select(half_up("x", 4).alias("x")).collect()
    assert odd[0].x is None and math.isnan(odd[1].x) and odd[2].x == math.inf and odd[3].x == -math.inf


def test_angular_distance_takes_whole_turns(spark):
    rows = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (180.0, 0.0), (0.0, 180.0), (725.0, 0.0), (-725.0, 0.0), (5.0, 5.0), (None, 1.0)], "x double, y double")
    assert [r.d for r in rows.select(angular_distance(F.col("x"), F.col("y")).alias("d")).collect()] == [-20.0, 20.0, -180.0, -180.0, 5.0, -5.0, 0.0, None]


def test_no_decimal_for_each_pair(spark):
    for name in ("pairwise_mixed", "pairwise_euclidean"):
        assert " round(" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
