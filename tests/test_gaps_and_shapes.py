"""Seasonal filling of gaps, name patterns, samples, Dunn index, knees, short-time spectra, gearbox parts, file search."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.kits import gearbox
from tidewheel.operators import clean, learning, patterns, series
from tidewheel.plans.catalogue import QUERIES
from tidewheel.sources import datasets

START = dt.datetime(2024, 1, 1)


def filled_by_hand(v, train=360, period=24):
    """The same by a walk over one whole series."""
    v, out = np.array(v, float), np.array(v, float)
    k = 0
    while k < len(v):
        if not np.isnan(v[k]):
            k += 1
            continue
        end = k
        while end < len(v) and np.isnan(v[end]):
            end += 1
        past = [(i, v[i]) for i in range(max(0, k - train), k) if not np.isnan(v[i])]
        if past:
            at, seen = np.array([i for i, _ in past]), np.array([x for _, x in past])
            out[k:end] = series.seasonal_forecast(np.interp(np.arange(at[0], k), at, seen), end - k, period)
        k = end
    return out


def hourly_frame(spark, tables):
    rows = [(key, START + dt.timedelta(hours=i), None if np.isnan(x) else float(x)) for key, v in tables.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")


def test_pattern_imputation_as_by_hand(spark):
    rng, hours = np.random.default_rng(3), np.arange(500)
    day = 10 + 5 * np.sin(hours * 2 * np.pi / 24) + rng.normal(0, 0.1, 500)
    gaps = day.copy()
    for a, b in ((0, 3), (100, 101), (120, 130), (400, 450), (495, 500)):
        gaps[a:b] = np.nan
    tables = {"a": gaps, "short": np.array([1.0, np.nan, np.nan, 2.0]), "none": np.full(5, np.nan), "full": day[:50]}
    out = series.impute_pattern(hourly_frame(spark, tables), ["k"], "t", "v").toPandas().sort_values(["k", "t"])
    assert out.columns.tolist() == ["k", "t", "v", "imputed"] and len(out) == 559
    for key, v in tables.items():
        got = out[out.k == key]
        np.testing.assert_allclose(got.v.to_numpy(float), filled_by_hand(v), rtol=1e-9)
        assert (got.imputed.to_numpy() == (np.isnan(v) & ~np.isnan(filled_by_hand(v)))).all()
    got = out[out.k == "a"].v.to_numpy(float)
    assert np.abs(got[400:450] - day[400:450]).max() < 2  # the daily wave goes on
    assert series.impute_pattern(hourly_frame(spark, {"a": gaps}).limit(0), ["k"], "t", "v").count() == 0


def test_imputation_query_as_by_hand(spark):
    from tidewheel.plans.timeseries import hourly_grid

    sf = "/root/testdata/sf0.001"
    grid = hourly_grid(lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
    want = grid.toPandas().sort_values(["event_type", "hour"])
    whole = series.impute_pattern(grid, ["event_type"], "hour", "value").toPandas().sort_values(["event_type", "hour"])
    got = QUERIES["pattern_imputation"](spark, sf).toPandas().sort_values(["event_type", "hour"])
    assert len(got) == len(want) == len(whole) and got.imputed.any()
    for key, rows in want.groupby("event_type"):
        hand = filled_by_hand(rows.value)
        np.testing.assert_allclose(whole[whole.event_type == key].value.to_numpy(float), hand, rtol=1e-9)
        np.testing.assert_allclose(got[got.event_type == key].value.to_numpy(float), hand, rtol=0, atol=5.1e-7)  # the query has 6 decimals


def test_regex_of_names(spark):
    names = ["V1_20N_3.txt", "V100_20N_12.txt", "log(2024).csv", "log(9).csv", "plain", "7", "a\\d{1}", "", None, "plain"]
    got = patterns.named(spark.createDataFrame([(n,) for n in names], "name string"), "name").toPandas()
    assert len(got) == len(names)
    known = {n: r for n, r in zip(got.name, got.regex) if n is not None}
    assert known["V1_20N_3.txt"] == known["V100_20N_12.txt"] == r"V\d{1,3}_\d{2}N_\d{1,2}\.txt"
    assert known["plain"] == "plain" and known["7"] == r"\d{1}" and known[""] == ""
    assert all(re.fullmatch(r, n) for n, r in known.items()) and got[got.name.isna()].regex.isna().all()


def test_numbers_in_names(spark):
    names = ["run_12_3.5kg.csv", "run_7_10.25kg.csv", "V100_20N", "v1.2.3", "0.5", "10.0.0.1", "x7.5", "plain", "", None, "3.14.txt"]
    got = {(r.template, r.position): tuple(r)[2:] for r in patterns.numbered_parts(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert got["run_\\d_\\d.\\dkg.csv", 2] == ("run", "int", 2, 2, 7, 12) and got["run_\\d_\\d.\\dkg.csv", 4] == ("kg", "float", 2, 2, 3.5, 10.25)
    assert got["V\\d_\\dN", 1] == ("V", "int", 1, 1, 100, 100) and got["V\\d_\\dN", 3] == ("N", "int", 1, 1, 20, 20)
    assert [got["v\\d.\\d.\\d", k][:2] for k in (1, 3, 5)] == [("v", "int")] * 3
    assert got["\\d.\\d", 0] == ("part0", "float", 1, 1, 0.5, 0.5) and got["\\d.\\d.txt", 0][:2] == ("part0", "float") and got["x\\d.\\d", 1][:2] == ("x", "float")
    assert sum(k[0] == "\\d.\\d.\\d.\\d" for k in got) == 4 and not any(k[0] in ("plain", "") for k in got)


@pytest.mark.parametrize("n", [0, 1, 500, 999, 1000, 2000])
def test_sample_is_of_the_smallest_hashes(spark, n):
    df = spark.range(1000).withColumn("extra", F.lit("x"))
    want = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(n).collect()]
    got = clean.hashed_sample(df, "id", n, 5)
    assert got.columns == ["id", "extra"] and [r.id for r in got.collect()] == want


def test_dunn(spark):
    rng = np.random.default_rng(0)
    x, lab = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, lab))], "id int, x array<double>, c int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, same = 1 - u @ u.T, lab[:, None] == lab[None]
    assert learning.dunn(df, "x", "c", "id").first().dunn == pytest.approx(d[~same].min() / d[same & ~np.eye(90, dtype=bool)].max())
    assert learning.dunn(df.where("c = 0"), "x", "c", "id").first().dunn is None


def test_knee(spark):
    x = np.arange(1, 21)
    df = spark.createDataFrame([("up", int(k), float(1 - 0.5**k)) for k in x] + [("flat", int(k), 1.0) for k in x] + [("two", 1, 0.0), ("two", 2, 1.0)], "k string, x int, y double")
    got = {r.k: r.knee for r in learning.knee(df, "x", "y", ["k"]).collect()}
    scaled = lambda v: (v - v.min()) / (v.max() - v.min())
    assert got == {"up": int(x[np.argmax(scaled(1 - 0.5**x) - scaled(x))]), "flat": None, "two": None}
    down = df.where("k = 'up'").withColumn("y", 1 - F.col("y"))
    assert learning.knee(down, "x", "y", ["k"], decreasing=True).first().knee == got["up"]


def test_short_time_spectra_average_to_welch(spark):
    v = np.random.default_rng(2).normal(size=110)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 1.0) for i in range(10)], "k string, i int, v double")
    got = learning.short_time_spectra(df, ["k"], "i", "v", 8.0, 20).toPandas()
    f, p = learning.welch(v, 8.0, 20)
    assert set(got.k) == {"a"} and sorted(set(got.segment)) == list(range(10))
    np.testing.assert_allclose(got.groupby("frequency").power.mean().to_numpy(), p, rtol=1e-9)
    assert sorted(set(got.frequency)) == pytest.approx(f.tolist())
    with pytest.raises(ValueError):
        learning.short_time_spectra(df, ["k"], "i", "v", 8.0, 21)


def test_gearbox_parts_and_balance(spark):
    rows = [(f"{r}_{t}_{i}", d, r, t) for r in (100, 200) for t in (10, 20) for i in range(50) for d in "xyz"]
    healthy = spark.createDataFrame(rows, "sample string, direction string, rpm int, torque int")
    train, test = gearbox.parts(healthy)
    a, b = (set(r.sample for r in p.select("sample").distinct().collect()) for p in (train, test))
    assert not a & b and len(a | b) == 200 and 120 <= len(a) <= 175 and train.count() == 3 * len(a)
    extra = [(f"{r}_{t}_{i}_pitting_level_2", d, r, t) for r in (100, 300) for t in (10, 20) for i in range(100) for d in "xyz"]
    out = gearbox.balanced(test, spark.createDataFrame(extra, healthy.schema)).toPandas()
    pitted = out[out["sample"].str.contains("pitting")]
    assert pitted["sample"].nunique() == len(b) and set(pitted.rpm) == {100} and len(out) == 6 * len(b)


def test_matching_files(spark, tmp_path):
    for name in ("V1_2.txt", "sub/V2_3.txt", "sub/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("abc")
    got = datasets.matching_files(spark, f"file://{tmp_path}", r"V\d+_\d+").toPandas()
    assert sorted(got.name) == ["V1_2.txt", "V2_3.txt"] and set(got.length) == {3} and isinstance(got, pd.DataFrame)


def moved_by_day(flags, clusters, support, share):
    """The same by a walk over the days."""
    waiting, seen, out = set(), set(), []
    for day in sorted({d for _, d, _ in flags}):
        before = set(waiting)
        seen |= {w for w, d, drift in flags if d == day and drift and w in clusters}
        waiting |= seen
        for c in set(clusters.values()):
            served = [w for w, k in clusters.items() if k == c and w not in seen]
            if len(served) / len(clusters) <= support:
                waiting |= set(served)
        if waiting - before:
            out.append((day, len(waiting - before), len(waiting), len(waiting) / len(clusters) >= share))
    return out


@pytest.mark.parametrize("support", [0.0, 0.1, 0.2])
def test_drift_days_as_by_hand(spark, support):
    rng = np.random.default_rng(7)
    clusters = {w: w % 5 if w < 36 else 9 for w in range(40)}
    flags = [(w, d, bool(rng.random() < 0.04)) for w in [*range(38), 77] for d in range(12)]
    got = learning.drift_days(spark.createDataFrame(flags, "w int, d int, drift boolean"), spark.createDataFrame(list(clusters.items()), "w int, cluster int"), "w", "d", support=support, share=0.3)
    assert [tuple(r) for r in got.orderBy("d").collect()] == moved_by_day(flags, clusters, support, 0.3)
