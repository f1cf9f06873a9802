"""Queries over whole tables: every user has a result, errors are those of all rows."""

import json

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import blocks, learning
from tidewheel.plans.catalogue import QUERIES


def events(path, users, each=8):
    rng = np.random.default_rng(1)
    n = users * each
    kinds = np.array(["click", "error", "purchase", "signup", "view"])
    pd.DataFrame({"user_id": np.repeat(np.arange(100, 100 + users), each), "event_type": kinds[rng.integers(0, 5, n)], "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, n), "s"), "value": rng.random(n) * 100}).astype({"ts": "datetime64[us]"}).to_parquet(f"{path}/events.parquet")
    return str(path)


def test_federated_losses_of_all_workers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learning, "LOSS_ROWS", 70)
    monkeypatch.setattr(learning, "LOSS_TREES", 16)
    sf = events(tmp_path, 50, 20)
    got = QUERIES["federated_losses"](spark, f"file://{sf}").toPandas()
    assert len(got) == 2500 and not got.duplicated(["user_id", "donor", "tree_no"]).any() and set(got.user_id) == set(range(100, 150))
    e = pd.read_parquet(f"{sf}/events.parquet")
    e["h"], e["d"] = e.ts.dt.hour.astype(float), e.ts.dt.weekday.astype(float)
    forest = learning.local_forests(spark.createDataFrame(e[["user_id", "h", "d", "value"]]), "user_id", ["h", "d"], "value", trees=1, depth=3).toPandas()
    again = learning.federated_losses(spark.createDataFrame(forest), spark.createDataFrame(e[["user_id", "h", "d", "value"]]), "user_id", ["h", "d"], "value").toPandas().set_index(["user_id", "donor"]).rmse
    for w, rows in e.groupby("user_id"):
        for f in forest[::7].itertuples():
            want = np.sqrt(np.mean((learning.grown(json.loads(f.tree), rows[["h", "d"]].to_numpy()) - rows.value.to_numpy()) ** 2))
            assert again[w, f.user_id] == pytest.approx(want)


def test_swarm_assigns_every_user(spark, tmp_path):
    got = QUERIES["pso_clusters"](spark, f"file://{events(tmp_path, 310)}").toPandas()
    assert len(got) == got.user_id.nunique() == 310 and 2 <= got.cluster.nunique() <= 7


def test_swarm_over_all_rows_as_over_a_matrix(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (70, 2)), rng.normal(5, 0.1, (70, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>")
    lab = learning.swarm_assigned(df, "x", "id", candidates=140, most=3, particles=6, rounds=4).toPandas().sort_values("id").cluster.to_numpy()
    assert (lab == learning.swarm_clusters((x - x.mean(0)) / (x.std(0) + 1e-9), most=3, particles=6, rounds=4)).all()


def test_nmf_errors_of_all_rows(spark, tmp_path):
    sf = events(tmp_path, 2100)
    got = QUERIES["nmf_component_errors"](spark, f"file://{sf}").toPandas().sort_values("k")
    e = pd.read_parquet(f"{sf}/events.parquet")
    v = e.pivot_table(index="user_id", columns="event_type", values="value", aggfunc="sum", fill_value=0).to_numpy()
    assert (got.frobenius**2 / got.mse).to_numpy() == pytest.approx([v.size] * 4)
    best = np.linalg.svd(v, compute_uv=False)  # no factors of rank k come closer
    for r in got.itertuples():
        mine = learning.nmf(v, r.k)
        assert np.sqrt((best[r.k :] ** 2).sum()) - 1e-6 <= r.frobenius <= 1.02 * np.linalg.norm(v - mine[0] @ mine[1])


def test_packed_blocks_have_all_rows_once(spark):
    df = spark.createDataFrame([(k, k % 3, [float(k)]) for k in range(1000)], "id int, p int, x array<double>")
    rows = blocks.packed(df, "x", ["id"], "id", "p", 64).toPandas()
    assert sorted(k for r in rows.c0 for k in r) == list(range(1000)) and rows.c0.map(len).max() <= 64
    assert all({k % 3 for k in r.c0} == {r.part} for r in rows.itertuples())


def test_medoids_and_scores_compare_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (1500, 2))
    df = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "id int, c int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert learning.kmedoids(df, "x", "id", 1).first().medoid == np.argmin(d.sum(1))
    far = df.withColumn("c", (df.id % 2).cast("int"))
    order = np.argsort(d + np.diag([np.inf] * len(x)), axis=1)[:, :10]
    assert learning.connectivity(far, "x", "c", "id").first().connectivity == pytest.approx((((order % 2) != (np.arange(1500) % 2)[:, None]) / np.arange(1, 11)).sum())
    assert not hasattr(learning, "PAIR_ROWS") and not hasattr(learning, "MEDOID_SAMPLE")


@pytest.mark.parametrize("score", ["dunn", "davies_bouldin"])
def test_swarm_by_other_scores(spark, score):
    """Three far groups are told apart, whichever score judges the centres."""
    rng = np.random.default_rng(5)
    rows = [(g * 10 + k, (np.array([(0, 0), (9, 0), (0, 9)][g]) + rng.normal(0, 0.2, 2)).tolist()) for g in range(3) for k in range(10)]
    got = learning.swarm_assigned(spark.createDataFrame(rows, "k int, x array<double>"), "x", "k", candidates=12, most=4, particles=8, rounds=8, score=score).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.cluster, set()).add(r.k // 10)
    assert len(got) == 30 and len(parts) == 3 and all(len(v) == 1 for v in parts.values())


def test_swarm_counts_equal_rows(spark, monkeypatch):
    """Equal rows meet the others once, with their number: the same choice as over a matrix with a row for each."""
    met = []
    packed = learning.packed
    monkeypatch.setattr(learning, "packed", lambda df, *a, **k: met.append(df.count()) or packed(df, *a, **k))
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(0, 1, (30, 2)), 3, axis=0), rng.normal(4, 1, (40, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>").repartition(3)
    lab = learning.swarm_assigned(df, "x", "id", candidates=130, most=4, particles=6, rounds=4).toPandas().sort_values("id").cluster.to_numpy()
    assert (lab == learning.swarm_clusters((x - x.mean(0)) / (x.std(0) + 1e-9), most=4, particles=6, rounds=4)).all()
    assert met == [70]
