"""Quantiles per group with hot groups, against numpy and against the operators' own sorted form."""

import numpy as np
import pandas as pd
import pytest

from tests.test_block_costs import shuffled
from tidewheel.operators import quantiles
from tidewheel.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_hot_groups_equal_numpy(spark):
    rng = np.random.default_rng(1)
    parts = {
        "even": rng.normal(size=5000), "skew": np.exp(3 * rng.normal(size=4000)), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.full(2500, 7.0),
        "two": np.append(np.zeros(1500), np.ones(1500)), "small": rng.random(40), "null": np.full(30, np.nan), "pair": np.array([1.0, 2.0]), "single": np.array([3.0]),
    }
    e = pd.concat([pd.DataFrame({"k": k, "j": 1, "v": v}) for k, v in parts.items()])
    e.loc[e.k == "pair", "k"] = None
    df = spark.createDataFrame(e.astype(object).where(e.notna(), None), "k string, j int, v double").repartition(4)
    p = [0.0, 0.25, 0.4, 0.5, 0.6, 0.999, 1.0]
    for leaf in (100, 100_000):
        got = {r.k: r.q for r in quantiles.group_quantiles(df, ["k", "j"], "v", p, leaf=leaf).collect()}
        assert len(got) == len(parts)
        for k, v in parts.items():
            name = None if k == "pair" else k
            assert got[name] is None if k == "null" else got[name] == pytest.approx(np.quantile(v, p), abs=1e-12), (leaf, k)


def test_empty_table(spark):
    assert quantiles.group_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


def test_queries_are_the_same_with_every_group_hot(spark, monkeypatch):
    names = ["hypercube_stats", "boxplot_flags_by_group", "hypercube_residuals", "mesh_leaf_counts"]
    sort = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = [sort(QUERIES[n](spark, SF)) for n in names]
    monkeypatch.setattr(quantiles, "LEAF", 60)
    monkeypatch.setattr(quantiles.group_quantiles, "__defaults__", ("q", 60))
    for n, rows in zip(names, want, strict=True):
        assert sort(QUERIES[n](spark, SF)) == rows, n


def test_values_are_counted_before_they_move(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS k", "CAST(id % 7 AS DOUBLE) AS v").repartition(4).cache()
    df.count()
    got, records = shuffled(spark, lambda: quantiles.group_quantiles(df, ["k"], "v", [0.1, 0.5], leaf=100).collect())
    values = np.arange(60_000)
    assert all(r.q == pytest.approx(np.quantile(values[values % 3 == r.k] % 7, [0.1, 0.5])) for r in got) and len(got) == 3
    df.unpersist()
    assert records < 2000
