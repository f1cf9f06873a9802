"""Seasonal ARIMA against a plain matrix Kalman filter and smoother, and gaps filled better than by the fixed forecast."""

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import series
from tidewheel.operators.statespace import DIFFUSE, Sarima, impute_sarima
from tidewheel.plans.catalogue import QUERIES


def plain(y, model, theta):
    """Likelihood and smoothed states by textbook matrices, one step at a time."""
    ar, ma = model.polynomials(theta)
    m = len(ar)
    t = np.zeros((m, m))
    t[:, 0] = ar
    for i in range(m - 1):
        t[i, i + 1] = 1
    z, q = np.eye(m)[:1], np.outer(ma, ma)
    a, p = np.zeros(m), np.eye(m) * DIFFUSE
    terms = []
    for x in y:
        if not np.isnan(x):
            f = float((z @ p @ z.T)[0, 0])
            v = x - float(z[0] @ a)
            k = (p @ z.T)[:, 0] / f
            a, p = a + k * v, p - np.outer(k, z @ p)
            terms.append((v, f))
        a, p = t @ a, t @ p @ t.T + q
    terms = terms[m:]
    sigma2 = np.mean([v * v / f for v, f in terms])
    like = -0.5 * (len(terms) * np.log(sigma2) + sum(np.log(f) for _, f in terms))
    # the expectation of all y given the known ones: y is linear in the first state and the noise
    n, weights = len(y), []
    state = np.hstack([np.eye(m), np.zeros((m, n))])
    for i in range(n):
        weights.append(state[0].copy())
        state = t @ state
        state[:, m + i] += ma
    w = np.array(weights)
    joint = w @ np.diag([DIFFUSE] * m + [1.0] * n) @ w.T
    known = ~np.isnan(y)
    out = joint[:, known] @ np.linalg.solve(joint[np.ix_(known, known)], y[known])
    return like, out


@pytest.mark.parametrize("model, theta", [(Sarima((0, 1, 0), (1, 1, 0, 4)), [0.4]), (Sarima((1, 0, 1), (0, 0, 0, 4)), [0.7, -0.3]), (Sarima((1, 1, 1), (1, 0, 1, 3)), [0.3, 0.2, -0.4, 0.5])])
def test_filter_and_smoother_equal_plain_matrices(model, theta):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=60)) + np.tile([0.0, 2, 5, 1], 15)
    y[[7, 20, 21, 22, 23, 40]] = np.nan
    like, smooth = plain(y, model, theta)
    assert model.likelihood(y, np.array([theta, np.zeros(len(theta))]))[0] == pytest.approx(like, abs=1e-4)
    got = model.smoothed(y, theta)
    assert got[~np.isnan(y)] == pytest.approx(y[~np.isnan(y)])
    assert got[np.isnan(y)] == pytest.approx(smooth[np.isnan(y)], abs=1e-3)


def test_least_squares_equal_filter_and_smoother():
    rng = np.random.default_rng(5)
    model = Sarima((1, 1, 0), (1, 1, 0, 5))
    y = np.cumsum(rng.normal(size=120)) + np.tile([0.0, 2, 5, 1, 3], 24)
    y[rng.choice(np.arange(20, 120), 25, replace=False)] = np.nan
    thetas = [[0.3, -0.4], [0.0, 0.5], [-0.6, 0.2]]
    direct = [model.completed(y, x) for x in thetas]
    likes = model.likelihood(y, np.array(thetas))
    for x, (full, like), other in zip(thetas, direct, likes, strict=True):
        assert full == pytest.approx(model.smoothed(y, x), abs=1e-3)
        assert like - direct[0][1] == pytest.approx(other - likes[0], abs=0.05)


def test_polynomials_multiply_out():
    ar, ma = Sarima((1, 1, 1), (1, 1, 1, 4)).polynomials([0.5, 0.25, 0.4, 0.2])
    want = np.convolve(np.convolve(np.convolve([1, -0.5], [1, 0, 0, 0, -0.25]), [1, -1]), [1, 0, 0, 0, -1])
    assert ar[:10] == pytest.approx(-want[1:]) and ma[:6] == pytest.approx([1, 0.4, 0, 0, 0.2, 0.08])


def test_fit_finds_the_highest_likelihood():
    rng = np.random.default_rng(2)
    w = np.zeros(300)
    for i in range(300):
        w[i] = (0.6 * w[i - 6] if i >= 6 else 0) + rng.normal()
    y = w.copy()
    for i in range(300):
        y[i] += (y[i - 6] if i >= 6 else 0)
    y = np.cumsum(y)
    y = (y - y.mean()) / y.std()
    model = Sarima((0, 1, 0), (1, 1, 0, 6))
    theta = model.fitted(y)
    grid = np.linspace(-0.98, 0.98, 197)[:, None]
    assert model.likelihood(y, theta[None])[0] >= model.likelihood(y, grid).max() - 1e-3
    assert theta[0] == pytest.approx(grid[np.argmax([model.completed(y, x)[1] for x in grid]), 0], abs=0.01)
    assert theta[0] == pytest.approx(0.6, abs=0.15)


def made(rng, n=700):
    t = np.arange(n)
    noise = np.zeros(n)
    for i in range(1, n):
        noise[i] = 0.9 * noise[i - 1] + rng.normal() * 0.4
    return 10 + 4 * np.sin(2 * np.pi * t / 24) + 1.5 * np.cos(2 * np.pi * t / 12) + noise


def frame(spark, tables):
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), None if np.isnan(x) else float(x)) for k, v in tables.items() for i, x in enumerate(v)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "v"]), "k string, t timestamp, v double")


def test_gaps_are_filled_better_than_by_the_fixed_forecast(spark):
    rng = np.random.default_rng(4)
    whole = {k: made(rng, 560) for k in "ab"}
    holed = {k: v.copy() for k, v in whole.items()}
    for v in holed.values():
        v[400:412] = v[470:500] = v[100:103] = np.nan
    out = {}
    for name, fn in (("sarima", impute_sarima), ("forecast", series.impute_pattern), ("mean", lambda *a: impute_sarima(*a, model=Sarima((1, 0, 0), (0, 1, 1, 24))))):
        got = fn(frame(spark, holed), ["k"], "t", "v").toPandas().sort_values(["k", "t"])
        err = np.concatenate([(got[got.k == k].v.to_numpy() - whole[k])[np.isnan(holed[k])] for k in whole])
        assert got.imputed.sum() == 2 * 45 and not np.isnan(err).any()
        out[name] = np.sqrt(np.mean(err**2))
    assert out["sarima"] < 0.95 * out["forecast"] and out["mean"] < 0.9 * out["forecast"], out


def test_without_later_values_a_gap_is_a_forecast(spark):
    y = made(np.random.default_rng(3), 300)
    y[200:205] = np.nan
    got = impute_sarima(frame(spark, {"a": y}), ["k"], "t", "v", after=0).toPandas().sort_values("t").v.to_numpy()
    assert got[200:205] == pytest.approx(Sarima().filled(y[:205])[200:])


def test_short_constant_null_and_empty(spark):
    gap = np.array([1.0, 2, np.nan, 3] * 4)
    flat = np.full(120, 5.0)
    flat[50:55] = np.nan
    got = impute_sarima(frame(spark, {"short": gap, "flat": flat}), ["k"], "t", "v").toPandas()
    assert got[got.k == "short"].v.isna().sum() == 4 and (got[got.k == "flat"].v == 5).all()
    assert impute_sarima(frame(spark, {"short": gap}).limit(0), ["k"], "t", "v").count() == 0


def test_query_equals_a_model_per_gap(spark):
    sf = "/root/testdata/sf0.01"
    from tidewheel.plans.timeseries import hourly_grid

    grid = hourly_grid(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).toPandas().sort_values(["event_type", "hour"])
    got = QUERIES["pattern_imputation_sarima"](spark, sf).toPandas().sort_values(["event_type", "hour"])
    assert len(got) == len(grid) and got.imputed.sum() == grid.value.isna().sum() - got.value.isna().sum()
    known = ~grid.value.isna().to_numpy()
    assert got.value.to_numpy()[known] == pytest.approx(grid.value.to_numpy()[known], abs=1e-6)
    kind = grid.event_type.to_numpy()[~known][0]
    y = grid[grid.event_type == kind].value.to_numpy()
    gap = int(np.flatnonzero(np.isnan(y))[0])
    end = gap + int(np.argmax(~np.isnan(y[gap:]))) - 1
    window = y[max(0, gap - 360) : end + 73]
    if (~np.isnan(window)).sum() >= Sarima().states + 8:
        want = Sarima().filled(window)[gap - max(0, gap - 360)]
        assert got[got.event_type == kind].value.to_numpy()[gap] == pytest.approx(want, abs=1e-5)
