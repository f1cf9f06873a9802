"""Medoids found by bounds against plain sums of all distances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_block_costs import shuffled
from tidewheel.operators import learning


@pytest.mark.parametrize("few", [16_384, 0])
def test_dearest_members(spark, monkeypatch, few):
    monkeypatch.setattr(learning, "CANDIDATES", few)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(50, 1, (300, 6)), rng.standard_t(2, (300, 6)), np.repeat(rng.normal(-9, 0.1, (4, 6)), 20, axis=0)])
    cluster = np.repeat([0, 1, 2], [300, 300, 80])
    rows = spark.createDataFrame(pd.DataFrame({"k": range(len(x)), "x": x.tolist(), "cluster": cluster})).withColumns({"cluster": F.col("cluster").cast("int"), "_h": F.xxhash64("k")}).repartition(3)
    got = learning._dearest(rows, "k", [{"x": x[i].tolist()} for i in (0, 300, 600)])
    for c, m in enumerate(got):
        mine = x[cluster == c]
        cost = np.sqrt(((mine[:, None] - mine[None]) ** 2).sum(2)).sum(1)
        assert cost.min() == pytest.approx(np.sqrt(((mine - x[m["k"]]) ** 2).sum(1)).sum(), rel=1e-12) and cluster[m["k"]] == c


def test_few_members_are_left_and_few_rows_shuffled(spark):
    x = np.random.default_rng(5).normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, x array<double>").repartition(4)
    members = df.select("k", "x", F.lit(0).alias("cluster"), F.xxhash64("k").alias("_h"))
    possible, records = shuffled(spark, lambda: learning._possible(members, "k", np.zeros((1, 16))).collect())
    cost = np.array([np.sqrt(((x - v) ** 2).sum(1)).sum() for v in x])
    assert int(cost.argmin()) in {r.k for r in possible} and len(possible) < 300
