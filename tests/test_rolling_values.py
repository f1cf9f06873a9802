"""Rolling medians and means against Spark's window aggregates, and their tasks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import resample


@pytest.mark.parametrize("stretch", [1, 3, 8])
def test_medians_and_means_of_odd_rows(spark, stretch):
    rng = np.random.default_rng(0)
    t0 = dt.datetime(2024, 1, 1)
    odd = {7: None, 40: float("inf"), 90: float("nan"), 120: float("-inf"), 121: None, 122: None}
    rows = [(k, "ab"[k % 2] if k % 50 else None, None if k % 97 == 0 else t0 + dt.timedelta(minutes=int(rng.integers(0, 3000))), odd.get(k, float(rng.integers(0, 90)))) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, t timestamp_ntz, v double").repartition(3)
    want = {r.id: (r.m, r.a) for r in resample.rolling(df, "t", 1.5, {"m": F.percentile("v", 0.5), "a": F.avg("v")}, ["g"]).collect()}
    got = {r.id: (r.m, r.a) for r in resample.rolling_values(df, "t", 1.5, {"m": ("median", "v"), "a": ("mean", "v")}, ["g"], stretch).collect()}
    assert len(got) == 300 and got.keys() == want.keys()
    for k, pair in want.items():
        for x, y in zip(pair, got[k], strict=True):
            assert (x is None or math.isnan(x)) == (y is None or math.isnan(y)) and (x is None or math.isnan(x) or y == pytest.approx(x)), k


def test_wide_windows_cost_no_more(spark):
    """60,000 rows in one window: a window aggregate reads 1,800 million of them."""
    df = spark.range(60_000).select("id", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id / 1000)").alias("t"), (F.col("id") % 1000).cast("double").alias("v"))
    got = resample.rolling_values(df, "t", 1, {"m": ("median", "v"), "a": ("mean", "v")}).orderBy("t").toPandas()
    assert got.m.iloc[-1] == 499.5 and got.a.iloc[-1] == pytest.approx(499.5) and got.m.iloc[4] == 2
