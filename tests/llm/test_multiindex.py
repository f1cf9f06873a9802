"""Hard negatives against brute force; the heap's order and bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import multiindex

SCHEMA = "vec_id long, embedding array<double>, label int, row string, anchor int, cell string, v int, t string"


def brute(rows, every=10, positives=5, negatives=3, low=50, high=95):
    good = [(n, i, [math.floor(256 * c) for c in v], g) for n, (i, v, g) in enumerate(rows) if i is not None and g is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, a, g in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j, h) for m, j, b, h in good if m != n)
        for s, p, _ in [r for r in scored if r[2] == g][:positives]:
            fit = [r for r in scored if r[2] != g and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -r) for k, (r, j, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, g, "r", 1, "c", 2, "t") for i, v, g in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in multiindex.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def clustered(rng, n, dim=8, spread=0.1):
    centres = rng.normal(size=(6, dim))
    own = rng.integers(0, 6, n)
    return [(k, (centres[c] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for k, c in enumerate(own)]


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).tolist(), int(rng.integers(0, 3))) for k in range(200)]
    same = rng.normal(size=6).tolist()
    rows += [(300 + k, same, k % 3) for k in range(60)]
    rows += [(400 + k, [float(rng.integers(-1, 2)) for _ in range(6)], k % 2) for k in range(80)]
    rows += [(500, None, 1), (510, [1.0, None, 2.0], 1), (520, [float("nan")] * 6, 2), (530, same, None), (540, [], 1), (550, [2.0, 1.0], 2), (560, [float("inf")], 1), (None, same, 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=4, low=20, high=80) == brute(rows, positives=2, negatives=4, low=20, high=80)


def test_windows_are_certified_before_all_cells_are_seen(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 1200)
    seen = []
    scan = multiindex.scanned
    monkeypatch.setattr(multiindex, "scanned", lambda asked, *a: seen.append(asked.select(F.sum(F.size("cells"))).first()[0]) or scan(asked, *a))
    monkeypatch.setattr(multiindex, "BLOCK", 64)
    monkeypatch.setattr(multiindex, "ANCHORS", 50)
    assert mined(spark, rows) == brute(rows)
    assert sum(seen) < 0.75 * 2 * 120 * multiindex.CODES**2


def test_scores_beyond_floats_and_none(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.integers(-(2**18), 2**18, 4) / 1).tolist(), k % 2) for k in range(40)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(10, [1e12, 1.0], 1), (11, [1.0, 1.0], 1)])


def test_cells_come_in_falling_order_and_bound_their_rows():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(500, 6)))
    centres = multiindex.codebook(x[:, :3]), multiindex.codebook(x[:, 3:])
    (a, ra), (b, rb) = multiindex._nearest(x[:, :3], centres[0]), multiindex._nearest(x[:, 3:], centres[1])
    top = lambda own, values, n: np.array([values[own == k].max(initial=0) for k in range(n)])
    cell = a * multiindex.CODES + b
    cells = multiindex.Cells(centres, (top(a, ra, len(centres[0])), top(b, rb, len(centres[1]))), (np.full(len(centres[0]), 1e9), np.full(len(centres[1]), 1e9)), frozenset(cell.tolist()))
    for q in x[:20]:
        order = list(cells.falling(*(h[0] for h in cells.halves(q[None]))))
        assert sorted(c for _, c in order) == sorted(cells.used) and all(p[0] >= n[0] for p, n in zip(order, order[1:], strict=False))
        for bound, c in order:
            assert (x[cell == c] @ q <= bound).all()
