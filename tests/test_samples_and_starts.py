"""Draws with replacement and the best of several k-medoids starts."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import chunks, learning, sampling


def test_exactly_n_draws_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(chunks, "WHOLE", 50)
    rows = spark.createDataFrame([(k if k else None, k * 2.0) for k in range(300)], "id long, copy_of double")
    got = [sorted((r.id or 0, r.copy_of, r.copy) for r in sampling.with_replacement(rows.repartition(p), 1000, "id", 3).collect()) for p in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 1000
    counts = Counter(i for i, _, _ in got[0])
    assert all(sorted(c for i, _, c in got[0] if i == k) == list(range(1, n + 1)) for k, n in counts.items())
    n = np.array([counts.get(k, 0) for k in range(300)])
    assert 2.3 < n.var() < 4.6 and 3 < (n == 0).sum() < 22  # 1000 / 300 draws a row, so about 3.3, and e^-3.3 of the rows without one
    again = Counter(r.id or 0 for r in sampling.with_replacement(rows, 1000, "id", 4).collect())
    assert again != counts
    assert sampling.with_replacement(rows.limit(0), 10, "id").count() == 0 and sampling.with_replacement(rows, 0, "id").count() == 0


def test_best_start_has_the_least_mean_rank(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.6, (25, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    labels, table = learning.kmedoids_starts(df, "x", "id", 4, 4)
    t = table.toPandas().sort_values("start")
    ranks = pd.concat([(-t.silhouette).rank(), (-t.calinski_harabasz).rank(), t.davies_bouldin.rank()], axis=1).mean(axis=1)
    assert t.mean_rank.to_numpy() == pytest.approx(ranks.to_numpy()) and t.best.sum() == 1 and t.best.to_numpy()[ranks.to_numpy().argmin()]
    got = {r.id: r.cluster for r in labels.collect()}
    want = {r.id: r.cluster for r in learning.kmedoids(df, "x", "id", 4, 10, int(t[t.best].start.iloc[0])).collect()}
    assert got == want
    own = np.array([got[k] for k in range(100)])
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for k in range(100):
        a = dist[k][own == own[k]].sum() / max(1, (own == own[k]).sum() - 1)
        b = min(dist[k][own == c].mean() for c in set(own) - {own[k]})
        s.append((b - a) / max(a, b))
    assert t[t.best].silhouette.iloc[0] == pytest.approx(np.mean(s))
