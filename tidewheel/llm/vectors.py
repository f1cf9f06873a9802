"""What the operators on vectors share: which vectors take part, Arrow lists as matrices, runs of equal rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column, empty: bool = False) -> Column:
    """Whether a vector is there, with components (unless empty ones count), none of them null, NaN or infinite."""
    x = lambda c: c.cast("double")
    return F.coalesce((F.size(v) >= (0 if empty else 1)) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) != float("inf"))), F.lit(False))


def width(df: DataFrame, vector: str) -> int:
    """The most components that a vector of df has; shorter ones count as ending in zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of numbers as rows of dim doubles, short ones ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stretches(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches [i, j) of rows with equal keys."""
    n = len(keys[0])
    cut = np.zeros(n, bool)
    cut[:1] = True
    for k in keys:
        cut[1:] |= k[1:] != k[:-1]
    at = np.append(np.flatnonzero(cut), n)
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, summed component by component in their order."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for k in range(a.shape[-1]):
        out += a[..., k] * b[..., k]
    return out
