"""Long series over chunks give the rows that one window per key gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import chunks, events, resample, series


def table(spark, n=900, keys=("a",)):
    rng = np.random.default_rng(len(keys))
    gaps = rng.choice([60, 60, 60, 600, 4000], n)
    e = pd.DataFrame({"k": rng.choice(list(keys), n), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), "s"), "on": rng.random(n) < 0.5, "v": rng.normal(size=n).cumsum(), "id": range(n)})
    e.loc[(e.id > 300) & (e.id < 480), "on"] = False
    e.loc[(e.id > 500) & (e.id < 640), "on"] = True
    e.loc[rng.random(n) < 0.3, "v"] = np.nan
    e.loc[(e.id < 70) | ((e.id > 350) & (e.id < 500)), "v"] = np.nan
    e["on"] = e["on"].astype(object).where(e.id != 700, None)
    e["k"] = e["k"].where(e["k"] != "n", None)
    return spark.createDataFrame(e.astype({"t": "datetime64[us]"}).astype(object).where(e.notna(), None), "k string, t timestamp, on boolean, v double, id long").repartition(3)


def both(monkeypatch, run):
    sort = lambda df: sorted(tuple(r) for r in df.select("id", df.columns[-1] if df.columns[-1] not in ("v", "id") else "v").collect())
    want = sort(run())
    monkeypatch.setattr(chunks, "WHOLE", 40)
    assert len(want) and (got := sort(run()))
    return got, want


@pytest.mark.parametrize("keys", [("a",), ("a", "b", "c", "n")])
def test_runs_merges_and_gaps(spark, monkeypatch, keys):
    df = table(spark, keys=keys)
    for run in (
        lambda: events.label_runs(df, "on", "t", ["k"]),
        lambda: events.label_runs_merged(df, "on", "t", 20, ["k"], period_minutes=2),
        lambda: events.label_runs_merged(df.where("on or id % 3 = 0"), "on", "t", 90, ["k"], period_minutes=2),
        lambda: events.label_runs(df.where("on"), "on", "t", ["k"]),
        lambda: resample.interpolate(df, "v", "t", ["k"], "w"),
        lambda: resample.interpolate(df, "v", "t", ["k"]).select("id", "v"),
    ):
        with monkeypatch.context() as m:
            got, want = both(m, run)
            assert got == want


def test_one_key_takes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "WHOLE", 10)
    rows = chunks.numbered(table(spark), ["k"], "t")
    per = rows.groupBy("_chunk").count().collect()
    assert len(per) >= 64 and max(r["count"] for r in per) < 60


@pytest.mark.parametrize("method, window", [("savgol", 11), ("gaussian", 21)])
def test_smoothing_in_parts(spark, monkeypatch, method, window):
    df = table(spark, keys=("a", "b")).withColumn("v", F.coalesce("v", F.sin("id"))).where("k is not null")
    got, want = both(monkeypatch, lambda: series.smooth(df, ["k"], "t", "v", method, window))
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-9)
    few = df.where("id < 4")
    assert series.smooth(few, ["k"], "t", "v", method, window).count() == few.count()


@pytest.mark.parametrize("mode, dev, last", [("zmean", None, False), ("mean", None, True), ("range", None, False), ("second", None, True), ("zmean", 0.8, True), ("zmean", 1e9, True), ("zmean", 0.0, False)])
def test_doors_over_chunks(spark, monkeypatch, mode, dev, last):
    df = table(spark, 500, ("a", "b", "n"))
    same = df.withColumn("t", F.date_trunc("hour", "t")).dropDuplicates(["k", "t"]).withColumn("v", F.round("v", 1))
    for rows in (df, same):
        with monkeypatch.context() as m:
            got, want = both(m, lambda: series.compress(rows.select("k", "t", "v", "id"), ["k"], "t", "v", mode, dev, last))  # noqa: B023
            assert got == want


def test_a_door_that_never_closes_takes_a_round_per_chunk_at_most(spark, monkeypatch):
    df = spark.range(400).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), F.when(F.col("id") == 390, 50.0).otherwise(0.0).alias("v"), "id")
    got, want = both(monkeypatch, lambda: series.compress(df, ["k"], "t", "v", dev=1.0))
    assert got == want and [i for i, _ in want] == [0, 389, 390, 391]
