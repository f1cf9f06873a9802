"""Rolling values by stretches that come in batches: many short ones at once, long ones over several batches, rows as they are."""

import datetime as dt
import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import resample


def test_many_short_stretches_take_no_time_each(spark):
    """40,000 stretches of one row and its copy; as a group of pandas rows each took about 11 ms of a core."""
    df = spark.range(40_000).select("id", (F.col("id") % 5).alias("g"), F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, id, 0, 0)").alias("t"), F.col("id").cast("double").alias("v"))
    began = time.time()
    got = resample.rolling_values(df, "t", 0.05, {"m": ("median", "v"), "a": ("mean", "v")}, ["g"])
    assert got.where("m = id and a = id").count() == 40_000
    assert time.time() - began < 20


def test_long_stretches_over_small_batches(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, pmod(id * id * 7, 4001), 0)").alias("t"), F.when(F.col("id") % 9 > 0, F.col("id") % 37).cast("double").alias("v"))
    want = {r.id: (r.m, r.a) for r in resample.rolling(df, "t", 2, {"m": F.percentile("v", 0.5), "a": F.avg("v")}, ["g"]).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.id: (r.m, r.a) for r in resample.rolling_values(df, "t", 2, {"m": ("median", "v"), "a": ("mean", "v")}, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {k: (m, pytest.approx(a)) for k, (m, a) in want.items()}


def test_nan_is_no_null_and_ids_stay(spark):
    """A window with NaN has the mean NaN, as in SQL, one without values has none; ids beside a null keep their last digits."""
    t0, big = dt.datetime(2024, 1, 1), 2**60 + 1
    rows = [(big, t0, float("nan")), (None, t0, 1.0), (big + 1, t0 + dt.timedelta(hours=2), None), (big + 2, t0 + dt.timedelta(hours=4), 3.0)]
    df = spark.createDataFrame(rows, "id bigint, t timestamp_ntz, v double")
    got = {r.id: r for r in resample.rolling_values(df, "t", 1, {"a": ("mean", "v"), "m": ("median", "v")}).collect()}
    assert got.keys() == {big, None, big + 1, big + 2}
    assert math.isnan(got[big].a) and math.isnan(got[None].a) and math.isnan(got[big].v)
    assert (got[big + 1].a, got[big + 1].m, got[big + 1].v) == (None, None, None) and (got[big + 2].a, got[big + 2].m) == (3, 3)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_groups_stay_whole(size):
    marks = [True, False, False, True, True, False, False, False, False, True]
    table = pa.table({"first": marks, "k": list(range(10))})
    got = [t.to_pydict() for t in resample._whole_groups(iter(table.to_batches(max_chunksize=size)), "first")]
    assert [k for t in got for k in t["k"]] == list(range(10)) and all(t["first"][0] for t in got)
    assert list(resample._whole_groups(iter([]), "first")) == []
