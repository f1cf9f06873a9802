"""Rows of one time are compressed in the order of their ids, however they arrive."""

import datetime as dt

import numpy as np
import pytest

from tidewheel.operators import chunks, series


@pytest.mark.parametrize("whole", [200_000, 20])
def test_rows_of_one_time(spark, monkeypatch, whole):
    monkeypatch.setattr(chunks, "WHOLE", whole)
    rng = np.random.default_rng(0)
    rows = [(k, "a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k // 4), float(v)) for k, v in enumerate(rng.integers(0, 50, 120))]
    t, v = np.array([60.0 * (k // 4) for k in range(120)]), np.array([r[3] for r in rows])
    want = sorted(series.swinging_door(t, v, 5.0, False))
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id int, g string, t timestamp_ntz, v double").coalesce(1)
        got = series.compress(df, ["g"], "t", "v", dev=5.0, ties=["id"])
        assert sorted(r.id for r in got.collect()) == want
