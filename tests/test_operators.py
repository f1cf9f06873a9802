import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import aggregate, binning, clean, events, kernels, learning, metrics, normalize, outliers, patterns, quantiles, resample, series

T0 = dt.datetime(2024, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def test_clean(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b"), (3, None, "a"), (4, float("inf"), None)], "k int, v double, g string")
    assert [r.v for r in clean.nan_to_null(df).orderBy("k").collect()] == [1.0, None, None, None]
    assert clean.impute(clean.nan_to_null(df), ["v"], 1).where("v is null").count() == 0
    assert clean.impute(clean.nan_to_null(df), ["v"], 2).where("v is null").count() == 3
    assert clean.groups_larger_than(df, ["g"], 1).count() == 2
    assert clean.same_group(df, {"g": "a", "k": 3}).count() == 1
    assert clean.numeric_columns(df) == ["k", "v"]
    assert clean.sentinel_to_null(df, "k", 2).where("k is null").count() == 1
    assert clean.hashed_sample(df, "k", 2).select("k").collect() == clean.hashed_sample(df.repartition(3), "k", 2).select("k").collect()
    assert clean.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6


def test_period_slice(spark):
    df = spark.createDataFrame([(dt.datetime(2015, 12, 31, 23),), (dt.datetime(2016, 1, 1),), (dt.datetime(2016, 12, 31, 23, 59),), (dt.datetime(2017, 1, 1),)], "ts timestamp_ntz")
    assert clean.period_slice(df, "ts", "2016", "2016").count() == 2
    assert clean.period_slice(df, "ts", "2015-12", "2016-01").count() == 2
    assert clean.period_slice(df, "ts", "2017-01-01", "2017-01-01").count() == 1


def test_severity(spark):
    df = spark.createDataFrame([(10.0, 10.0), (70.0, 10.0), (120.0, 70.0)], "a double, b double")
    kind = clean.severity(["a", "b"], [("low", 50, 100), ("high", 100, 200)])
    assert [r[0] for r in df.select(kind).collect()] == ["No event", "low", "high"]


@pytest.mark.parametrize("leaf", [10, 100_000])
def test_exact_quantiles(spark, leaf):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=3000), np.repeat(0.5, 800)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], leaf) == pytest.approx(np.quantile(v, [0, 0.25, 0.5, 0.9, 1]).tolist())
    assert quantiles.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_outliers(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([("g", x) for x in v] + [("h", 7.0)] * 3 + [("h", 8.0)], "g string, v double")
    assert [r.v for r in outliers.outlier_flags(df.where("g = 'g'"), "v").where("outlier").collect()] == [100.0]
    got = outliers.group_outlier_flags(df, ["g"], "v", 1.5).where("outlier").collect()
    assert sorted((r.g, r.v) for r in got) == [("g", 100.0), ("h", 8.0)]
    assert outliers.fences(1, 3, 1.5) == (-2, 6)
    low, high = outliers.fences(1, 3, 1.5, 0.3)
    assert low > -2 and high > 6
    assert outliers.medcouple(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(0) and outliers.medcouple(np.array([1.0, 2, 3, 10, 30])) > 0.3
    assert outliers.outlier_flags(df, "v", skew_sample=50).count() == df.count()


def brute_merge(rows, period, merge):
    """Labels by expanding to the grid: rows (minute, flag)."""
    lo, hi = rows[0][0], rows[-1][0]
    flags = dict(rows)
    grid = sorted({*flags, *range(lo, hi + 1, period)})
    on = {t: flags.get(t, False) for t in grid}
    true = [t for t in grid if on[t]]
    for a, b in zip(true, true[1:]):
        if period < b - a <= merge:
            for t in grid:
                if a < t < b:
                    on[t] = True
    label, k, last = {}, 0, False
    for t in grid:
        if on[t] and not last:
            k += 1
        label[t] = k if on[t] else 0
        last = on[t]
    return [label[t] for t, _ in rows]


@pytest.mark.parametrize("seed", range(6))
def test_merged_runs_match_grid_expansion(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for _ in range(60):
        rows.append((t, rng.random() < 0.4))
        t += 10 * rng.choice([1, 1, 1, 2, 3, 5, 9])
    df = spark.createDataFrame([(at(m), f) for m, f in rows], "ts timestamp_ntz, f boolean")
    for merge in (10, 30, 60):
        got = [r.label for r in events.label_runs_merged(df, "f", "ts", merge, period_minutes=10).orderBy("ts").collect()]
        assert got == brute_merge(rows, 10, merge)


def test_runs_and_sessions(spark):
    rows = [("a", m, f) for m, f in ((0, True), (1, True), (2, False), (3, True), (9, None))] + [("b", 5, False)]
    df = spark.createDataFrame([(g, at(m), f) for g, m, f in rows], "g string, ts timestamp_ntz, f boolean")
    assert [r.label for r in events.label_runs(df, "f", "ts", ["g"]).orderBy("g", "ts").collect()] == [1, 1, 0, 2, 0, 0]
    s = events.sessions(df, "ts", 300, ["g"]).orderBy("g", "ts").collect()
    assert [r.session for r in s] == [0, 0, 0, 0, 1, 0]
    labelled = events.label_runs(df, "f", "ts", ["g"])
    e = events.summarize(labelled, "label", "ts", "f", ["g"]).orderBy("label").collect()
    assert [(r.duration, r.flagged, r.n_rows, r.rat_labeled) for r in e] == [(1.0, 2, 2, 1.0), (0.0, 1, 1, 1.0)]
    assert events.sampling_period(df, "ts", ["g"]) == 60e6


def test_resample(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(1), 3.0), (at(25), 5.0)], "ts timestamp_ntz, v double")
    r = resample.resample(df, "ts", "10 minutes", {"mean": F.avg("v"), "total": F.sum("v")}, zero=("total",)).orderBy("bin").collect()
    assert [(x["mean"], x.total) for x in r] == [(2.0, 4.0), (None, 0.0), (5.0, 5.0)]
    roll = resample.rolling(df, "ts", 1 / 60, {"m": F.count("v")}).orderBy("ts").collect()
    assert [x.m for x in roll] == [1, 1, 1]
    assert [x.m for x in resample.rolling(df, "ts", 2 / 60, {"m": F.count("v")}).orderBy("ts").collect()] == [1, 2, 1]


def test_interpolate(spark):
    v = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "k int, v double")
    assert [r.v for r in resample.interpolate(df, "v", "k").orderBy("k").collect()] == [None, 1, 2, 3, 4, 4]


def test_lags(spark):
    df = spark.createDataFrame([("a", at(60 * 24 * k), float(k)) for k in (0, 1, 3, 8)], "g string, ts timestamp_ntz, v double")
    lag = resample.calendar_lag(df, "ts", "v", {"d": "1 DAY", "w": "7 DAYS"}, ["g"]).orderBy("ts").collect()
    assert [(r.d, r.w) for r in lag] == [(None, None), (0.0, None), (None, None), (None, 1.0)]
    m = resample.row_lags(df, "v", "ts", [1], ["g"], [1]).orderBy("ts").collect()
    assert [(r.v_lag1, r.v, r.v_lead1) for r in m] == [(0, 1, 3), (1, 3, 8)]
    w = resample.sequence_windows(df, ["v"], "ts", 2, ["g"]).orderBy("ts").collect()
    assert [[s.v for s in r.window] for r in w] == [[0, 1], [1, 3]]
    d = df.withColumn("day", F.to_date("ts"))
    assert [r.trailing for r in resample.trailing_mean(d, "v", "day", 7, ["g"]).orderBy("ts").collect()] == [0, 0, 0.5, 2]


def test_normalize(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    z = {(r.g, r.v): r.n_v for r in normalize.scaled(df, ["v"], ["g"]).collect()}
    assert z[("a", 1.0)] == pytest.approx(-(0.5**0.5)) and z[("b", 5.0)] is None
    assert [r.n_v for r in normalize.scaled(df, ["v"], method="minmax").orderBy("v").collect()] == [0, 0.5, 1]
    assert [r.n_v for r in normalize.scaled(df, ["v"], method=lambda x, s: x * 2).orderBy("v").collect()] == [2, 6, 10]
    rows = spark.createDataFrame([(1.0, 3.0), (None, 1.0)], "a double, b double")
    assert [tuple(r) for r in normalize.row_shares(rows, ["a", "b"]).collect()] == [(0.25, 0.75)]


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 3.3, 3.4, 10.0, 11.0, None)], "v double")
    b = binning.Bins("v", (0.0, 3.33333, 6.66667, 10.0))
    assert [r[0] for r in df.select(b.number()).collect()] == [0, 0, 0, 1, 2, None, None]
    assert b.rounded_mids() == pytest.approx([1.666, 5.0, 8.3335], abs=1e-3)
    assert len(binning.Bins.equal(df, "v", 20).mids) == 19
    h = binning.histogram_2d(df.withColumn("w", F.col("v")), b, binning.Bins("w", (0.0, 5.0, 10.0)))
    assert h.count() == 6 and h.agg(F.sum("n")).first()[0] == 5
    c = binning.cells(df, [b], ["v"])
    assert c.agg(F.sum("v_count")).first()[0] == 5
    near = binning.nearest_cell(df.na.drop(), binning.numbered(c, "v_mean", ["v_bin"]).select("cube_id", F.col("v_bin").alias("v")), ["v"])
    assert near.where("v = 11").first().cube_id == 0


def test_mesh(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.beta(1, 4, (2000, 2))], "x double, y double")
    leaves = binning.refine(df, ["x", "y"], bins=4, tolerance=0.05, levels=3)
    assert leaves.agg(F.sum("n")).first()[0] == 2000
    assert leaves.where("level < 3 and n >= 100").count() == 0 and leaves.agg(F.max("level")).first()[0] >= 1


def test_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.1), ("b", 3.0, 6.2), ("b", None, 8.0)], "g string, x double, y double")
    assert aggregate.completeness(df, ["g"], ["x"]).orderBy("g").collect()[1].x == 50
    assert aggregate.null_ratios(df, ["x"]).first().x == 0.25
    assert aggregate.share_within(df, ["g", "x"], ["g"]).where("g = 'a'").first().percent == 50
    c = aggregate.cumulative_curve(df.na.drop(), "x", []).orderBy("x").collect()
    assert [r.running for r in c] == [1, 2, 3] and c[-1].running_percent == 100
    runs = spark.createDataFrame([(1, "e"), (1, "e"), (1, "f"), (2, "e"), (2, None)], "run int, event string")
    r = {(x.run, x.event): x.score for x in aggregate.relevancy(runs, "run", "event").collect()}
    assert r[(1, "e")] == 0 and r[(1, "f")] == pytest.approx(0.5 * np.log(2))


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.7, 1), (0.2, 0), (None, 1)], "s double, y int")
    s, y = np.array([0.9, 0.8, 0.7, 0.7, 0.2]), np.array([1, 1, 0, 1, 0])
    want = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(want)
    curve = metrics.roc_curve(df, "s", "y").orderBy("threshold").collect()
    assert [(r.tp, r.fp) for r in curve] == [(3, 2), (3, 1), (2, 0), (1, 0)]
    assert metrics.tpr_at_fpr(metrics.roc_curve(df, "s", "y"), 0.1).first().tpr == pytest.approx(2 / 3)
    e = metrics.regression_errors(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 1.0)], "o double, p double"), "o", "p").first()
    assert e.mae == pytest.approx(2 / 3) and e.rmse == pytest.approx((2 / 3) ** 0.5) and e.mape == pytest.approx(0.5)
    k = metrics.kde(spark.createDataFrame([(0.0,), (1.0,)], "v double"), "v", 1.0, 3).orderBy("x").collect()
    g = lambda z: np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
    assert k[0].density == pytest.approx((g(0) + g(1)) / 2)


def test_patterns(spark):
    names = spark.createDataFrame([("a1_20240101.csv",), ("a12_20240102.csv",), ("b.txt",), (None,)], "n string")
    got = {r["shape"]: (r.n, r.widths) for r in patterns.templates(names, "n").collect()}
    assert got == {r"a\d_\d.csv": (2, r"\d{1, 2}|\d{8}"), "b.txt": (1, "")}
    assert [(r.format, r.votes) for r in patterns.time_format_votes(names, "n").collect()] == [("yyyyMMdd", 2)]


def test_swinging_door():
    t = np.arange(50.0)
    assert series.swinging_door(t, np.zeros(50), 0.1).tolist() == [0]
    assert series.swinging_door(t, 2 * t, 0.1).tolist() == [0]
    step = np.where(t < 25, 0.0, 10.0)
    kept = series.swinging_door(t, step, 0.5, last=True)
    assert kept[0] == 0 and kept[-1] == 49 and 24 in kept and len(kept) <= 5
    rng = np.random.default_rng(0)
    v = np.cumsum(rng.normal(size=400))
    kept = series.swinging_door(np.arange(400.0), v, 1.0, last=True)
    assert np.abs(np.interp(np.arange(400), kept, v[kept]) - v).max() <= 2.0 + 1e-9 and len(kept) < 250
    assert series.deviation(t, 2 * t) == 2 and series.deviation(t[:1], t[:1]) == 0


def test_smoothing_and_decomposition():
    x = np.arange(60.0)
    assert series.savitzky_golay(3 + 2 * x + x**2, 11) == pytest.approx(3 + 2 * x + x**2)
    assert series.gaussian(np.ones(30), 11) == pytest.approx(np.ones(30))
    n = np.arange(24 * 20)
    y = 0.05 * n + 3 * np.sin(2 * np.pi * n / 24)
    trend, season, rest = series.stl(y, 24)
    assert trend + season + rest == pytest.approx(y) and np.abs(rest[48:-48]).max() < 0.3 and np.corrcoef(season, 3 * np.sin(2 * np.pi * n / 24))[0, 1] > 0.99
    f = series.seasonal_forecast(y, 24)
    assert np.abs(f - (0.05 * np.arange(480, 504) + 3 * np.sin(2 * np.pi * np.arange(480, 504) / 24))).max() < 0.5
    assert series.adaptive_bins(np.array([0, 5, 0, 0, 5, 0, 0, 5, 0.0]))


def test_learning_kernels():
    rng = np.random.default_rng(0)
    w, h = rng.random((40, 2)), rng.random((2, 6))
    path = learning.nmf_path(w @ h, [1, 2, 3])
    assert path[-2]["r2"] > 0.99 and path[-1]["r2"] < path[-2]["r2"]
    f, p = learning.welch(np.sin(2 * np.pi * 50 * np.arange(4000) / 1000), 1000, 500)
    assert f[np.argmax(p)] == 50 and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.05)
    x = rng.random((400, 3))
    y = (x[:, 0] > 0.5) * 2.0
    assert np.abs(learning.forest_model(x[:300], y[:300], x[300:]) - y[300:]).mean() < 0.2
    assert np.abs(kernels.svr_model(x[:300], x[:300, 1], x[300:], gamma=0.1) - x[300:, 1]).mean() < 0.2
    groups = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))])
    lab = learning.swarm_clusters(groups, most=3)
    assert len(set(lab[:20])) == 1 and len(set(lab[20:])) == 1 and lab[0] != lab[20]


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.2, (30, 3)), rng.normal(4, 0.2, (30, 3))])
    df = spark.createDataFrame([(k, k // 30, [float(c) for c in v]) for k, v in enumerate(x)], "id int, c int, x array<double>")
    s = learning.silhouette(df, "x", "c", "id").first().silhouette
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = [d[k, (k // 30) * 30 : (k // 30) * 30 + 30].sum() / 29 for k in range(60)]
    other = [d[k, 30 - (k // 30) * 30 : 60 - (k // 30) * 30].mean() for k in range(60)]
    assert s == pytest.approx(np.mean([(b - a) / max(a, b) for a, b in zip(own, other)]))
    assert learning.connectivity(df, "x", "c", "id").first().connectivity == 0
    m = learning.kmedoids(df, "x", "id", 2)
    assert m.groupBy("cluster").count().count() == 2 and m.where("distance = 0").count() == 2
    r = learning.cluster_scores(df, "x", "c").first()
    assert r.clusters == 2 and r.calinski_harabasz > 1000 and r.davies_bouldin < 0.3
