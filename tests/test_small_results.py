"""Results of a row per pair come in an order in which Parquet's runs and dictionaries keep their files small."""

import json

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import learning, metrics


def changes(values):
    return int((values[1:] != values[:-1]).sum())


def test_losses_of_the_same_workers_stand_together(spark, monkeypatch):
    """12 kinds of workers, 10 of each, by turns: a kind's errors under a tree are one run."""
    monkeypatch.setattr(learning, "LOSS_ROWS", 900)
    monkeypatch.setattr(learning, "LOSS_TREES", 30)
    rng = np.random.default_rng(0)
    kinds = [pd.DataFrame({"a": rng.integers(0, 5, 30).astype(float), "y": rng.random(30)}) for _ in range(12)]
    e = pd.concat([kinds[w % 12].sample(frac=1, random_state=w).assign(w=w) for w in range(120)])
    df = spark.createDataFrame(e)
    trees = [json.dumps(learning.tree(k[["a"]].to_numpy(), k.y.to_numpy(), 2, 5, np.random.default_rng(0))) for k in kinds]
    forest = pd.DataFrame({"w": range(120), "tree_no": 0, "tree": [trees[w % 12] for w in range(120)]})
    out = learning.federated_losses(spark.createDataFrame(forest).repartition(3), df.repartition(3), "w", ["a"], "y")
    assert out.rdd.getNumPartitions() > 12  # all tasks work, however small the rows are
    got = out.toPandas()
    assert len(got) == 14_400 and not got.duplicated(["w", "donor"]).any()
    assert changes(got.rmse.to_numpy()) < 14_400 / 5 and changes(got.donor.to_numpy()) < 14_400 / 5
    for w, d in ((0, 0), (13, 25), (119, 7)):
        k = kinds[w % 12]
        want = np.sqrt(np.mean((learning.grown(json.loads(trees[d % 12]), k[["a"]].to_numpy()) - k.y.to_numpy()) ** 2))
        assert got[(got.w == w) & (got.donor == d)].rmse.item() == pytest.approx(want)


@pytest.mark.parametrize("kind, angular", [("euclidean", []), ("mixed", ["w"])])
def test_pairs_of_equal_distance_stand_together(spark, monkeypatch, kind, angular):
    """20 places, 30 rows at each, by turns: ids and distances come in runs, and each pair once."""
    monkeypatch.setattr(metrics, "TASK_PAIRS", 100_000)
    e = pd.DataFrame({"k": range(600), "x": [float(k % 20) ** 2 for k in range(600)], "w": [float(k % 20) * 17 for k in range(600)]})
    e.loc[599, "x"] = None
    df = spark.createDataFrame([(int(k), None if x != x else x, w) for k, x, w in e.itertuples(index=False)], "k long, x double, w double").repartition(3)
    got = metrics.pairwise(df, df, ("k", "k"), ["x"], angular, kind=kind).toPandas()
    assert len(got) == 360_000 and not got.duplicated(["a", "b"]).any()
    assert changes(got.a.to_numpy()) < 360_000 / 60 and changes(got.distance.fillna(-1).to_numpy()) < 360_000 / 10
    x, w = (e[c].to_numpy() for c in ("x", "w"))
    turn = (w[got.a] - w[got.b] + 180) % 360 - 180
    np.testing.assert_allclose(got.distance, np.abs(x[got.a] - x[got.b]) + (turn if angular else 0), atol=1e-9)
