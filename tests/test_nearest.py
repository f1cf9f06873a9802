"""The nearest of many cells through boxes, against comparing with every cell."""

import numpy as np
import pandas as pd
import pytest

from tidewheel.operators import binning
from tidewheel.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_boxes_equal_all_pairs(spark, monkeypatch, dims):
    monkeypatch.setattr(binning, "INLINE_CELLS", 10)
    monkeypatch.setattr(binning, "LEAF_CELLS", 4)
    rng = np.random.default_rng(dims)
    cells = np.vstack([rng.normal(size=(300, dims)), rng.normal(size=(200, dims)) * 0.01 + 5, np.round(rng.normal(size=(200, dims)), 1), np.zeros((6, dims))])
    rows = np.vstack([rng.normal(size=(80, dims)) * 2, np.full((3, dims), 500.0), np.round(rng.normal(size=(60, dims)), 1) + 0.05, np.full((2, dims), np.nan)])
    names = [f"v{k}" for k in range(dims)]
    left = spark.createDataFrame(pd.DataFrame(rows, columns=names).assign(n=range(len(rows)))).replace(float("nan"), None).repartition(3)
    right = spark.createDataFrame(pd.DataFrame(cells, columns=names).assign(cube_id=rng.permutation(len(cells))))
    number = {tuple(r[:-1]): None for r in right.toPandas().itertuples(index=False)}
    listed = [(r.cube_id, [r[n] for n in names]) for r in right.collect()]
    got = {r.n: (r.cube_id, r.distance) for r in binning.nearest_cell(left, right, names).collect()}
    assert len(got) == len(rows) and number
    for n, row in enumerate(rows):
        if np.isnan(row).any():
            assert got[n] == (None, None)
            continue
        d, i = min((sum((a - b) * (a - b) for a, b in zip(row, c, strict=True)), i) for i, c in listed)
        assert got[n][0] == i and got[n][1] == pytest.approx(np.sqrt(d), abs=1e-12)


def test_query_is_the_same_through_boxes(spark, monkeypatch):
    want = sorted(tuple(r) for r in QUERIES["nearest_cube"](spark, SF).collect())
    monkeypatch.setattr(binning, "INLINE_CELLS", 1)
    assert sorted(tuple(r) for r in QUERIES["nearest_cube"](spark, SF).collect()) == want
