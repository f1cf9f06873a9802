"""Curves, windows and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import hilbert

SCHEMA = "vec_id long, embedding array<float>, label int, v string, ids int, score double, query int, id string"


def rows_of(vectors, ids=None):
    return [(i, v if v is None else [None if c is None else float(c) for c in v], 1, "v", 2, 0.5, 3, "x") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]


def brute(rows, k, every=20):
    """Exact neighbours of valid rows; scores summed in order."""
    good = [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows if r[0] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    dim = max(len(v) for _, v in good)
    good = sorted({(i, tuple(np.append(v, np.zeros(dim - len(v))))) for i, v in good})
    out = []
    for q, a in {i: v for i, v in reversed(good) if i % every == 0}.items():
        scored = []
        for i, b in good:
            if i != q:
                s = 0.0
                for x, y in zip(a, b, strict=True):
                    s += x * y
                scored.append((-s, i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 3), (4, 2), (1, 6)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hilbert.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [list(rng.normal(size=6).round(2)) for _ in range(150)]
    same = list(rng.normal(size=6).round(2))
    vectors += [same] * 60 + [[1e-3 * c for c in same]] * 3 + [[5.0, 1.0]] * 2
    vectors += [None, [], [0.0] * 6, [1.0, None, 2, 3, 4, 5], [float("nan")] * 6, [float("inf"), 1, 1, 1, 1, 1]]
    rows = rows_of(vectors) + rows_of([same, same, None, [1.0] * 6], [40, 40, None, None])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == brute(rows, 7)


def test_none_few_and_no_queries(spark):
    every = F.col("vec_id") % 20 == 0
    assert hilbert.nearest(spark.createDataFrame([], SCHEMA), every).count() == 0
    assert hilbert.nearest(spark.createDataFrame(rows_of([[1.0, 2.0]] * 3, [1, 2, 3]), SCHEMA), every).count() == 0
    few = hilbert.nearest(spark.createDataFrame(rows_of([[1.0, 2.0], [3.0, -1.0]], [0, 20]), SCHEMA), every).collect()
    assert sorted(tuple(r) for r in few) == [(0, 1, 20, 1.0), (20, 1, 0, 1.0)]
    assert hilbert.nearest(spark.createDataFrame(rows_of([[1.0, 2.0]], [0]), SCHEMA), every).count() == 0


def test_recall_where_windows_are_narrower_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "LEAST", 64)
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 24)) + rng.normal(size=(4000, 24)) / 50
    loose = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1))
    for x in (flat, loose):
        df = spark.createDataFrame(rows_of(x.tolist()), SCHEMA)
        got = {tuple(r)[::2] for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0, k=10).select("query_id", "rank", "vec_id").collect()}
        x = x.astype(np.float32).astype(float)
        score = x[::20] @ x.T
        score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
        want = {(20 * q, int(i)) for q, row in enumerate(np.argsort(-score, axis=1)[:, :10]) for i in row}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
