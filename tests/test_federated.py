"""The global forest against the mean of its trees, and three retrainings against a plain loop."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import federated, learning
from tidewheel.plans.catalogue import QUERIES

D0 = dt.date(2024, 1, 1)


def test_global_forest_is_the_mean_of_donated_trees(spark, monkeypatch):
    monkeypatch.setattr(federated, "LOSS_ROWS", 37)
    monkeypatch.setattr(federated, "LOSS_TREES", 4)
    rng = np.random.default_rng(0)
    e = pd.DataFrame({"w": np.repeat(np.arange(14), 20), "a": rng.random(280), "b": rng.random(280), "id": range(280)})
    e["y"] = e.a * 3 + (e.b > 0.5)
    df = spark.createDataFrame(e).repartition(3)
    forest = learning.local_forests(df, "w", ["a", "b"], "y", trees=3, depth=3)
    got = federated.global_predictions(forest, df, "id", ["a", "b"], 2).toPandas().set_index("id")
    trees = [json.loads(r.tree) for r in forest.collect() if r.tree_no < 2]
    want = np.mean([learning.grown(t, e[["a", "b"]].to_numpy()) for t in trees], axis=0)
    assert (got.trees == 28).all() and got.prediction.sort_index().to_numpy() == pytest.approx(want)
    assert federated.global_predictions(forest.limit(0), df, "id", ["a", "b"]).count() == 0


def errors(since):
    """Errors of 12 workers; from day 40, 90 and 140 on, some are far off until a training after that."""
    rng = np.random.default_rng(7)
    base = rng.random((12, 200)) * 0.2 + 1
    for start, workers in ((40, range(0, 4)), (90, range(3, 8)), (140, range(6, 12))):
        if since is None or (since - D0).days < start:
            for w in workers:
                base[w, start + w % 3 : start + w % 3 + 4] += 30
    first = 0 if since is None else (since - D0).days + 1
    return [(w, D0 + dt.timedelta(days=k), float(base[w, k])) for w in range(12) for k in range(first, 200)]


def plain(rows, clusters, spread=3.0, days=3, support=0.033, share=0.16):
    e = pd.DataFrame(rows, columns=["w", "day", "e"]).sort_values(["w", "day"])
    gone = {}
    for w, g in e.groupby("w"):
        over = (g.e > g.e.mean() + spread * g.e.std()).tolist()
        hit = [g.day.iloc[i] for i in range(days - 1, len(g)) if all(over[i - days + 1 : i + 1])]
        if hit:
            gone[w] = hit[0]
    for day in sorted(e.day.unique()):
        left = {c: [w for w, k in clusters.items() if k == c and gone.get(w, dt.date.max) > day] for c in set(clusters.values())}
        waiting = {w for w in clusters if gone.get(w, dt.date.max) <= day or len(left[clusters[w]]) / len(clusters) <= support}
        if len(waiting) / len(clusters) >= share:
            return day
    return None


def test_three_retrainings_equal_a_plain_loop(spark):
    clusters = {w: w % 3 for w in range(12)}
    table = spark.createDataFrame(list(clusters.items()), "w int, cluster int")
    got = federated.retrainings(lambda since: (spark.createDataFrame(errors(since), "w int, day date, e double"), table), "w", "day", "e")
    want, since = [], None
    while True:
        at = plain(errors(since), clusters)
        want.append((since, at))
        if at is None:
            break
        since = at
    assert got == want and len(want) == 4


def test_query_predicts_every_event(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["federated_global_forest"](spark, sf).toPandas()
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    assert len(got) == len(events) and got.prediction.between(events.value.min(), events.value.max()).all()
    assert (got.trees == events.user_id.nunique()).all()
