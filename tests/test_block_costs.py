"""What queries over blocks and long series shuffle, and their values where rows are many."""

import json
import timeit

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import federated, learning, metrics


def shuffled(spark, run):
    """The number of records that stages shuffle while run() works."""

    def written():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in written().items() if k not in before)


def test_losses_shuffle_rows_and_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(learning, "LOSS_ROWS", 40)
    monkeypatch.setattr(learning, "LOSS_TREES", 16)
    rng = np.random.default_rng(0)
    e = pd.DataFrame({"w": np.repeat(np.arange(61), [110] + [6] * 60), "a": rng.integers(0, 5, 470).astype(float)})
    e["y"] = rng.random(470) + (e.a > 2)
    df = spark.createDataFrame(e).repartition(3)
    forest = spark.createDataFrame(learning.local_forests(df, "w", ["a"], "y", trees=1, depth=2).toPandas())
    got, records = shuffled(spark, lambda: learning.federated_losses(forest, df, "w", ["a"], "y").toPandas())
    assert len(got) == 61 * 61 and records < 61 * 61
    rmse = got.set_index(["w", "donor"]).rmse
    for t in forest.toPandas().itertuples():
        off = (learning.grown(json.loads(t.tree), e[["a"]].to_numpy()) - e.y.to_numpy()) ** 2
        assert np.sqrt(pd.Series(off).groupby(e.w).mean()).to_numpy() == pytest.approx([rmse[w, t.w] for w in range(61)])


def test_errors_are_products_where_points_repeat():
    """A product of trees x points with points x workers in place of every tree at every row, to the same figures."""
    rng = np.random.default_rng(0)
    p, counts = rng.normal(50, 20, (256, 168)), np.full(120, 67)
    at, y = rng.integers(0, 168, counts.sum()), rng.normal(50, 20, counts.sum())
    y[:67] = p[3, at[:67]]  # a tree without an error
    y[67:134] = p[4, at[67:134]] + 1e-5  # and one with a small one
    y[134], y[201], y[268:335] = np.nan, np.inf, y[268:335] + 1e12
    want = np.add.reduceat((p[:, at] - y[None]) ** 2, np.r_[0, np.cumsum(counts)[:-1]], axis=1)
    got = learning.squared_errors(p, at, y, counts)
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose(learning.squared_errors(p[:, :67], np.tile(np.arange(67), 1), y[335:402], np.ones(67, int)), (p[:, :67] - y[335:402]) ** 2, rtol=1e-9)
    assert got[3, 0] == 0

    def took(rows):
        counts, at, y = np.full(20, rows), rng.integers(0, 168, 20 * rows), rng.normal(50, 20, 20 * rows)
        run = lambda: learning.squared_errors(p, at, y, counts)
        return min(timeit.repeat(run, number=1, repeat=3)) / rows

    assert took(5000) < took(100)  # the work of a row goes down with the rows, as it isn't done for every tree


def test_global_forest_shuffles_points(spark, monkeypatch):
    monkeypatch.setattr(federated, "LOSS_ROWS", 100)
    monkeypatch.setattr(federated, "LOSS_TREES", 4)
    rng = np.random.default_rng(0)
    e = pd.DataFrame({"w": np.repeat(np.arange(60), 30), "a": rng.integers(0, 5, 1800).astype(float), "id": range(1800)})
    e["y"] = rng.random(1800) + e.a
    df = spark.createDataFrame(e).repartition(3)
    forest = spark.createDataFrame(learning.local_forests(df, "w", ["a"], "y", trees=1, depth=2).toPandas())
    got, records = shuffled(spark, lambda: federated.global_predictions(forest, df, "id", ["a"]).toPandas())
    want = np.mean([learning.grown(json.loads(t), e[["a"]].to_numpy()) for t in forest.toPandas().tree], axis=0)
    assert got.sort_values("id").prediction.to_numpy() == pytest.approx(want) and (got.trees == 60).all()
    assert records < 4500  # the rows twice, and the points


def test_pairs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_PAIRS", 40)
    df = spark.createDataFrame([(k, float(k), 350.0 * (k % 2)) for k in range(20)], "k long, x double, w double").coalesce(1)
    for kind, angular in (("euclidean", []), ("mixed", ["w"])):
        out = metrics.pairwise(df, df, ("k", "k"), ["x"], angular, kind=kind)
        assert out.count() == 400 and out.rdd.getNumPartitions() == 10
