"""Values of queries without SQL, each against a plain computation on the same rows."""

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import learning
from tidewheel.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_pca_feature_importance(spark):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = {r.feature: r.importance for r in QUERIES["pca_feature_importance"](spark, SF).collect()}
    values, axes = np.linalg.eigh(np.cov(table("lineitem")[columns].to_numpy(float).T))
    order = np.argsort(-values)[:3]
    loading = np.abs(axes[:, order])
    want = sum(values[k] / values.sum() * loading[:, i] / loading[:, i].sum() for i, k in enumerate(order))
    assert [got[c] for c in columns] == pytest.approx((want / want.sum()).tolist(), rel=1e-6)


def tricube_line(x, y, at, span):
    """Weighted line through the `span` nearest points, by normal equations."""
    n, q = len(y), min(span, len(y))
    start = int(np.clip(np.round(at - (q - 1) / 2), 0, n - q))
    idx = np.arange(start, start + q)
    d = np.abs(x[idx] - at)
    h = d.max() * max(1.0, span / n) + 1e-9
    w = np.maximum(0, 1 - (d / h) ** 3) ** 3
    design = np.column_stack([np.ones(q), x[idx] - at])
    return np.linalg.lstsq(design * np.sqrt(w)[:, None], y[idx] * np.sqrt(w), rcond=None)[0][0]


def plain_stl(y, period, seasonal=7, inner=2):
    n = len(y)
    line = lambda v, span, at=None: np.array([tricube_line(np.arange(len(v), dtype=float), v, p, span) for p in (np.arange(len(v), dtype=float) if at is None else at)])
    trend = np.zeros(n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for _ in range(inner):
        cycle = np.zeros(n + 2 * period)
        for k in range(period):
            part = (y - trend)[k::period]
            smooth = line(part, seasonal, np.arange(-1, len(part) + 1, dtype=float))
            for i, v in enumerate(smooth):
                if k + i * period < len(cycle):
                    cycle[k + i * period] = v
        low = cycle
        for width in (period, period, 3):
            low = np.array([low[i : i + width].mean() for i in range(len(low) - width + 1)])
        season = cycle[period : period + n] - line(low[:n], period | 1)
        trend = line(y - season, span)
    return trend, season


def test_stl_components(spark):
    got = QUERIES["stl_components"](spark, SF).toPandas().sort_values(["event_type", "hour"])
    for kind, rows in list(got.groupby("event_type"))[:2]:
        y = rows.value.astype(float).interpolate(limit_direction="both").fillna(0.0).to_numpy()
        trend, season = plain_stl(y, 24)
        assert rows.trend.to_numpy() == pytest.approx(trend, abs=1e-5), kind
        assert rows.seasonal.to_numpy() == pytest.approx(season, abs=1e-5)
        assert rows.residual.to_numpy() == pytest.approx(y - trend - season, abs=1e-5)


def test_rf_walk_forward(spark):
    from tidewheel.plans.models import _forecast_rows

    f = ["past_day", "past_week", "hour_of_day", "weekday"]
    rows = _forecast_rows(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).toPandas().dropna().sort_values("hour", kind="stable")
    got = QUERIES["rf_walk_forward"](spark, SF).toPandas().set_index(["event_type", "fold"])
    n = 0
    for kind, own in rows.groupby("event_type"):
        for fold in sorted(own.fold.unique())[1:]:
            seen, asked = own[own.fold < fold], own[own.fold == fold]
            p = learning.forest_model(seen[f].to_numpy(float), seen.value.to_numpy(float), asked[f].to_numpy(float))
            r = got.loc[(kind, fold)]
            assert r.n == len(asked) and r.mae == pytest.approx(np.abs(p - asked.value).mean())
            n += 1
    assert n == len(got) > 4
