"""Complete linkage against a plain agglomeration that looks for the two nearest clusters each time."""

import itertools

import numpy as np
import pytest

from tests.test_block_costs import shuffled
from tidewheel.operators import linkage
from tidewheel.plans.catalogue import QUERIES

SCHEMA = "id string, x array<double>"


def brute(points):
    clusters = {k: [k] for k in points}
    out = []
    far = lambda p, q: max(np.linalg.norm(np.array(points[a]) - np.array(points[b])) for a in clusters[p] for b in clusters[q])
    while len(clusters) > 1:
        h, p, q = min((round(far(p, q), 9), p, q) for p, q in itertools.combinations(sorted(clusters), 2))
        clusters[p] += clusters.pop(q)
        out.append((p, q, h, len(clusters[p])))
    return sorted(out), next(iter(clusters.values()), [])


@pytest.mark.parametrize("finish", [512, 5, 1])
def test_merges_and_order(spark, monkeypatch, finish):
    monkeypatch.setattr(linkage, "FINISH", finish)
    rng = np.random.default_rng(1)
    points = {f"p{k:02}": rng.normal(size=3).tolist() for k in range(26)} | {"q1": [5.0, 5.0, 5.0], "q2": [5.0, 5.0, 5.0], "q3": [5.0, 5.0, 6.0], "q4": [5.0, 6.0, 5.0]}
    df = spark.createDataFrame([*points.items(), (None, [1.0, 1.0, 1.0]), ("n", None)], SCHEMA).repartition(3)
    merges, leaves = linkage.complete_linkage(df, "x", "id")
    want, order = brute(points)
    assert sorted((r.left, r.right, round(r.height, 9), r.size) for r in merges.collect()) == want
    assert [r.id for r in leaves.orderBy("position").collect()] == order
    assert sorted(r.position for r in leaves.collect()) == list(range(len(points)))


def test_one_and_none(spark):
    for rows, n in (([("a", [1.0])], 1), ([], 0)):
        merges, leaves = linkage.complete_linkage(spark.createDataFrame(rows, SCHEMA), "x", "id")
        assert merges.count() == 0 and leaves.count() == n


def test_queries_hold_every_user(spark):
    sf = "/root/testdata/sf0.001"
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    merges = QUERIES["clustermap_merges"](spark, sf).collect()
    assert len(merges) == users - 1 and max(r.size for r in merges) == users
    order = sorted(r.position for r in QUERIES["clustermap_order"](spark, sf).collect())
    assert order == list(range(users))


def test_copies_and_large_rounds(spark, monkeypatch):
    """Copies are merged without a round each, and no pair of rows is shuffled."""
    monkeypatch.setattr(linkage, "FINISH", 4)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 2)).round(2)
    points = {f"c{k:03}": base[k % 12].tolist() for k in range(150)}
    (merges, leaves), records = shuffled(spark, lambda: [t.collect() for t in linkage.complete_linkage(spark.createDataFrame([*points.items()], SCHEMA), "x", "id")])
    want, order = brute(points)
    assert sorted((r.left, r.right, round(r.height, 9), r.size) for r in merges) == want
    assert [r.id for r in sorted(leaves, key=lambda r: r.position)] == order
    assert records < 150 * 149 / 2


@pytest.mark.parametrize("listed", [4_000_000, 0])
def test_nearest_of_large_clusters(spark, monkeypatch, listed):
    """Bounds leave out no nearest cluster, whatever the clusters' sizes; no copy of the clusters is shuffled for each group."""
    monkeypatch.setattr(linkage, "LISTED", listed)
    monkeypatch.setattr(linkage, "PRODUCT", 60)
    monkeypatch.setattr(linkage, "SLICE", 900)
    rng = np.random.default_rng(3)
    held = {f"k{k}": rng.normal(rng.uniform(-3, 3, 3), rng.choice([0.01, 1.0]), (int(rng.integers(1, 30)), 3)).round(1) for k in range(120)}
    held["k7"] = held["k3"] = np.ones((2, 3))
    df = spark.createDataFrame([(c, x.ravel().tolist(), len(x)) for c, x in held.items()], "c string, x array<double>, m long").repartition(2)
    far = {(a, b): max(float(((p - q) ** 2).sum()) for p in held[a] for q in held[b]) for a, b in itertools.combinations(sorted(held), 2)}
    got, records = shuffled(spark, lambda: linkage.nearest(df, df, "string").collect())
    assert len(got) == len(held) and (records < 7 * len(held) or not listed)  # slices that are read again give a result each
    for r in got:
        q, b = min((round(far[min(r.c, o), max(r.c, o)], 9), o) for o in held if o != r.c)
        assert (round(r.q, 9), r.b) == (q, b)
    pairs = linkage.pair_distances(df, "string").collect()
    assert {(r.a, r.b): round(r.h, 9) for r in pairs} == {k: round(v, 9) for k, v in far.items()}
