"""Comparisons of all rows with all rows: groups of blocks against plain computations, and what they shuffle."""

import numpy as np
import pandas as pd
import pytest

from tests.test_block_costs import shuffled
from tidewheel.operators import blocks, learning


@pytest.mark.parametrize("own,matrix", [(32_768, 8_000_000), (128, 900)])
def test_scores_equal_plain_ones(spark, monkeypatch, own, matrix):
    monkeypatch.setattr(blocks, "OWN", own)
    monkeypatch.setattr(blocks, "MATRIX", matrix)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4)).round(1)
    x[100:160] = x[7]  # copies: ties go to the smaller key
    lab = rng.integers(0, 3, 700)
    df = spark.createDataFrame([(k, int(c), v.tolist()) for k, (v, c) in enumerate(zip(x, lab, strict=True))], "k int, c int, x array<double>").repartition(5)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), axis=1)[:, :10]
    want = ((lab[near] != lab[:, None]) / (1 + np.arange(10))).sum()
    assert learning.connectivity(df, "x", "c", "k").first()[0] == pytest.approx(want)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = np.column_stack([d[:, lab == c].sum(1) / ((lab == c).sum() - (lab == c)) for c in range(3)])
    a, rest = mean[np.arange(700), lab], np.where(lab[:, None] == np.arange(3), np.inf, mean).min(1)
    assert learning.silhouette(df, "x", "c", "k").first()[0] == pytest.approx(((rest - a) / np.maximum(a, rest)).mean())


def test_shuffle_grows_with_the_rows(spark):
    def records(n):
        df = spark.createDataFrame(pd.DataFrame({"k": range(n), "c": np.arange(n) % 3, "x": list(np.random.default_rng(0).normal(size=(n, 2)))}))
        table = blocks.packed(df, "x", ["c", "k"], "k", size=16)
        run = lambda mine, others: pd.DataFrame({"n": [sum(len(b.x) for b in others) * len(mine.x)]})
        got, count = shuffled(spark, lambda: blocks.against_all(table, run, "n long").groupBy().sum("n").first()[0])
        assert got == n * n
        return count

    assert records(3200) < 3 * records(1600)  # with a group a block it is four times
