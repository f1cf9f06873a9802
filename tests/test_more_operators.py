"""Edge cases of padding, pages, pairwise and Mahalanobis distances, tests of correlation, cube models and walk-forward folds."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import aggregate, binning, learning, metrics, normalize, patterns, resample


def test_student_tail():
    for t, n, p in ((0, 5, 1.0), (12.706205, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (4.587, 10, 0.001), (-2.228139, 10, 0.05)):
        assert metrics.student_tail(t, n) == pytest.approx(p, rel=1e-3)


def test_pearson(spark):
    row = metrics.pearson_test(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 7.0), (4.0, 6.0), (None, 1.0)], "x double, y double"), "x", "y").first()
    r = np.corrcoef([1, 2, 3, 4], [2, 3, 7, 6])[0, 1]
    assert row.n == 4 and row.r == pytest.approx(r) and row.p == pytest.approx(1 - r, abs=1e-6)  # with two degrees of freedom p is 1 - |r|
    assert metrics.pearson_test(spark.createDataFrame([], "x double, y double"), "x", "y").first().p is None


def test_fpr_where_no_threshold_reaches(spark):
    curve = spark.createDataFrame([(1.0, 0.2, 0.5), (0.5, 0.6, 1.0)], "threshold double, fpr double, tpr double")
    assert metrics.fpr_at_tpr(curve, 0.5).first().fpr == 0.6 and metrics.fpr_at_tpr(curve, 1.0).first().fpr == 0.0


def test_mahalanobis(spark):
    x = np.random.default_rng(0).normal(size=(40, 3)) @ np.array([[1, 0.5, 0], [0, 2, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(99, None, 1.0, 1.0)], "k long, a double, b double, c double")
    inverse = np.linalg.inv(np.cov(x.T))
    want = {k: math.sqrt((r - x.mean(0)) @ inverse @ (r - x.mean(0))) for k, r in enumerate(x)}
    got = {r.k: r.distance for r in metrics.mahalanobis(df, ["a", "b", "c"]).collect()}
    assert got.pop(99) is None and got == pytest.approx(want)
    assert metrics.mahalanobis(df.limit(0), ["a"]).count() == 0


def test_pairwise_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k), 350.0 * (k % 2) + 5) for k in range(12)], "k long, x double, w double")
    one = sorted(map(tuple, metrics.pairwise(df, df, ("k", "k"), ["x"], ["w"], kind="mixed").collect()))
    monkeypatch.setattr(metrics, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, metrics.pairwise(df, df, ("k", "k"), ["x"], ["w"], kind="mixed").collect())) == one and len(one) == 144
    assert {(a, b): d for a, b, d in one}[1, 0] == pytest.approx(1 - 10)  # 355 and 5 are 10 apart, with their sign


def test_padding_and_pages(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 7), (None, 1, 9)], "g string, d int, n long")
    assert sorted(map(tuple, aggregate.padded(df, ["g", "d"], ["n"]).collect())) == [("a", 1, 5), ("a", 2, 0), ("b", 1, 0), ("b", 2, 7)]
    t = spark.createDataFrame([(k, k / 7, "x") for k in range(10)], "k long, v double, s string")
    assert [tuple(r) for r in aggregate.page(t, ["k", "v"], ["k"], number=1, size=3, digits=2).collect()] == [(3, 0.43), (4, 0.57), (5, 0.71)]


def test_upsample_and_scale(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-02 00:00:00", 5.0), ("2024-01-02 00:10:00", 7.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r.v for r in resample.upsample(df, "ts", "v", "12 hours").orderBy("bin").collect()]
    assert got == [1.0, 3.5, 6.0]
    assert [r.n_v for r in normalize.resampled_scaled(df, "ts", "12 hours", ["v"]).orderBy("bin").collect()] == pytest.approx([1 / 12, 0, 1])
    wild = spark.createDataFrame([(float(k),) for k in range(20)] + [(1e6,), (None,)], "v double")
    assert normalize.scaled_within_fences(wild, "v").agg(F.count("*"), F.max("n_v")).first()[:] == (20, 1.0)


def test_cube_model_takes_the_nearest_cell_where_its_own_is_thin(spark):
    rows = [(k, 0.5, float(k)) for k in range(6)] + [(10, 2.5, 100.0)] + [(20 + k, 4.5, 50.0 + k) for k in range(6)] + [(30, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, t double")
    out, cube = binning.cube_model(df, [binning.Bins("x", (0.0, 1.0, 2.0, 3.0, 4.0, 5.0))], ["t"], least=5)
    got = {r.k: (r.t_expected, r.res_t) for r in out.collect()}
    assert got[0] == (2.5, -2.5) and got[25] == (52.5, 2.5) and got[10][0] in (2.5, 52.5) and 30 not in got
    assert cube.count() == 2


@pytest.mark.parametrize("strategy,folds", [("1_month", range(2, 15)), ("6_months", range(7, 15)), ("1_year", range(13, 15)), ("1_month_year_before", range(13, 15)), ("all_before", range(2, 15)), ("train_test_split", range(10, 15))])
def test_walk_forward_without_keys(spark, strategy, folds):
    rows = [(m, d, float(m)) for m in range(1, 15) for d in range(3)] + [(5, 9, None)]
    df = spark.createDataFrame(rows, "m long, d long, y double").withColumn("x", F.col("d").cast("double"))
    got = {r.m: (r.mae, r.n) for r in learning.walk_forward(df, [], "d", ["x"], "y", "m", learning.mean_model, strategy, split=9).collect()}
    windows = {"1_month": lambda m: [m - 1], "6_months": lambda m: range(m - 6, m), "1_year": lambda m: range(m - 12, m), "1_month_year_before": lambda m: [m - 12], "all_before": lambda m: range(1, m), "train_test_split": lambda m: range(1, 10)}
    assert got == {m: (pytest.approx(abs(m - np.mean(windows[strategy](m)))), 3) for m in folds}


def test_rolling_is_the_same_over_stretches(spark):
    """A window reaches back over the border of a stretch; null times see each other."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(minutes=7 * k), float(k * 37 % 101)) for k in range(400)] + [(0, None, 5.0), (0, None, 7.0)]
    df = spark.createDataFrame(rows, "g int, t timestamp, v double")
    for stretch in (1, 2, 1000):
        got = resample.rolling(df, "t", 1.5, {"m": F.percentile("v", 0.5), "n": F.count("v")}, ["g"], stretch=stretch).collect()
        assert len(got) == len(rows)
        for r in got:
            near = [v for g, t, v in rows if g == r.g and ((t is None and r.t is None) or (t and r.t and r.t - dt.timedelta(hours=1.5) < t <= r.t))]
            assert r.n == len(near) and abs(r.m - np.median(near)) < 1e-9


def test_kernel_density_by_hand(spark):
    v = [0.0, 1.0, 1.0, 4.0, None]
    got = metrics.kde(spark.createDataFrame([(x,) for x in v], "v double").repartition(3), "v", 0.5, 9).orderBy("x").collect()
    for r in got:
        want = sum(np.exp(-0.5 * ((r.x - x) / 0.5) ** 2) for x in v if x is not None) / (4 * 0.5 * np.sqrt(2 * np.pi))
        assert abs(r.density - want) < 1e-12
    assert [r.x for r in got] == list(np.linspace(0, 4, 9))


def test_time_formats_of_names(spark):
    """Days over 12 decide between orders; digits beside a match, impossible months and names without a time don't vote."""
    votes = lambda *names: {r.format: r.votes for r in patterns.time_format_votes(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert votes("05/06/2024", "25/06/2024") == {"dd/MM/yyyy": 2, "MM/dd/yyyy": 1}
    assert votes("x2024-01-02T03:04:05.678Z") == {"yyyy-MM-dd'T'HH:mm:ss.SSS": 1}
    assert votes("a20240102030405", "20240102_0304", "2024.01.02-03-04-05") == {"yyyyMMddHHmmss": 1, "yyyyMMdd_HHmm": 1, "yyyy.MM.dd-HH-mm-ss": 1}
    assert votes("12024010211", "2024-13-01", "2024-01-41", None, "", "plain") == {}
    assert votes("2024-01-02 25:00") == {"yyyy-MM-dd": 1}
