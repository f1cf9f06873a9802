"""Support vectors by the gap between primal and dual; sums over folds by fitting each fold anew."""

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import kernels, learning
from tidewheel.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def rbf(a, b, gamma):
    return np.array([[np.exp(-gamma * sum((u - v) ** 2 for u, v in zip(p, q, strict=True))) for q in b] for p in a])


@pytest.mark.parametrize("c, gamma, epsilon", [(10, 0.01, 0.1), (1, 1.0, 0.05), (100, 0.3, 0.02)])
def test_primal_and_dual_meet(c, gamma, epsilon):
    rng = np.random.default_rng(int(c))
    x = rng.random((70, 3))
    x[10:14] = x[10]
    y = np.sin(4 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=70) * 0.1
    w, b = kernels.support_weights(x, y, c, gamma, epsilon, 1e-6)
    k = rbf(x, x, gamma)
    assert abs(w.sum()) < 1e-9 and (np.abs(w) <= c + 1e-12).all()
    norm = w @ k @ w / 2
    primal = norm + c * np.maximum(0, np.abs(y - k @ w - b) - epsilon).sum()
    dual = y @ w - epsilon * np.abs(w).sum() - norm
    assert primal - dual == pytest.approx(0, abs=1e-3 * max(1, primal)) and primal >= dual - 1e-9


def test_two_points_by_hand():
    # one pair: the weights grow until both errors are epsilon, or stop at c
    x, y, gamma = np.array([[0.0], [1.0]]), np.array([0.0, 1.0]), 0.5
    w, b = kernels.support_weights(x, y, 10, gamma, 0.1, 1e-9)
    want = (1 - 0.2) / (2 - 2 * np.exp(-gamma))
    assert w == pytest.approx([-want, want]) and b == pytest.approx(0.5)
    assert kernels.support_weights(x, y, 0.3, gamma, 0.1, 1e-9)[0] == pytest.approx([-0.3, 0.3])
    assert kernels.svr_model(x, np.full(2, 7.0), x) == pytest.approx([7, 7])


def test_every_row_counts_and_columns_are_bounded(monkeypatch):
    monkeypatch.setattr(kernels, "COLUMNS", 8 * 3000 * 2)
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    y = 5 + 3 * x[:, 0]
    y[:1000] += 2 * (x[:1000, 1] > 0.5)  # only the oldest rows know of it, and are older than any cut
    x[1000:, 1] = 0.25
    p = kernels.svr_model(x, y, np.array([[0.5, 0.9], [0.5, 0.1]]), 100, 1.0, 0.05)
    assert p[0] - p[1] > 1.2


def test_walk_forward_query_equals_a_machine_per_fold(spark):
    got = QUERIES["svr_walk_forward"](spark, SF).toPandas().sort_values(["event_type", "fold"]).reset_index(drop=True)
    from tidewheel.plans.models import _forecast_rows

    rows = _forecast_rows(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).toPandas().dropna().sort_values("hour")
    f, n = ["past_day", "past_week", "hour_of_day", "weekday"], 0
    for r in got.itertuples():
        seen = rows[(rows.event_type == r.event_type) & (rows.fold < r.fold)]
        asked = rows[(rows.event_type == r.event_type) & (rows.fold == r.fold)]
        assert r.n == len(asked)
        if n < 4:
            p = kernels.svr_model(seen[f].to_numpy(float), seen.value.to_numpy(float), asked[f].to_numpy(float), 10, 0.01)
            assert r.mae == pytest.approx(np.abs(p - asked.value).mean(), abs=2e-3 * rows.value.max())
        n += 1
    assert n


@pytest.mark.parametrize("strategy", ["all_before", "1_month", "6_months"])
def test_fourier_sums_equal_a_fit_per_fold(spark, strategy, monkeypatch):
    monkeypatch.setattr(kernels, "HELD", 3)
    rng = np.random.default_rng(2)
    n = 900
    e = pd.DataFrame({"k": rng.choice(list("ab"), n), "m": rng.integers(0, 9, n), "x": rng.random(n), "u": rng.random(n) * 50})
    e["y"] = np.sin(6 * e.x) * 10 + e.u + rng.normal(size=n)
    got = kernels.fourier_walk_forward(spark.createDataFrame(e).repartition(5), ["k"], ["x", "u"], "y", "m", strategy, gamma=3.0, width=20).toPandas().set_index(["k", "m"])
    fourier = kernels.Fourier(e[["x", "u"]].min().to_numpy(), e[["x", "u"]].max().to_numpy(), 3.0, 20)
    first, want = {"all_before": None, "1_month": 1, "6_months": 6}[strategy], 0
    for k in "ab":
        for m in range(1 if first is None else first, 9):
            seen = e[(e.k == k) & (e.m < m) & (e.m >= (0 if first is None else m - first))]
            asked = e[(e.k == k) & (e.m == m)]
            z = fourier(seen[["x", "u"]].to_numpy())
            w = np.linalg.lstsq(np.vstack([z, np.diag(np.append(np.full(20, np.sqrt(0.1)), 1e-4))]), np.append(seen.y, np.zeros(21)), rcond=None)[0]
            assert got.loc[(k, m)].mae == pytest.approx(np.abs(fourier(asked[["x", "u"]].to_numpy()) @ w - asked.y).mean(), rel=1e-4)
            assert got.loc[(k, m)].n == len(asked)
            want += 1
    assert len(got) == want
    assert kernels.fourier_walk_forward(spark.createDataFrame(e).limit(0), ["k"], ["x", "u"], "y", "m").count() == 0
