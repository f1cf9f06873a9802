"""Complete-linkage clustering: merges and leaf order as rows.

Two clusters that are each other's nearest stay so whatever else is merged, so all such pairs merge in one round, and the
number of clusters falls by a share each time. No distances are kept: a round finds the nearest cluster of those whose own
or nearest one was merged, among all clusters, which stream past groups of clusters. Means, spreads and boxes of clusters
leave out those that can't be the nearest; members of the others are compared. A cluster's nearest stays so until it is
merged itself. Equal rows are one cluster from the start. The last FINISH clusters are merged in one task. Ties go to the
smaller ids, which gives the same tree however rounds fall. Work grows with the square of the different rows by
definition; what is written or shuffled grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import OWN, saved

#: Clusters that one task merges.
FINISH = 512
#: Numbers in a matrix of members' distances, and in one of clusters' bounds.
TILE, WIDE = 262_144, 1_000_000
#: Numbers in a slice of all clusters, and in all of them where they are broadcast.
SLICE, LISTED = 500_000, 4_000_000
#: Pairs of members up to which two clusters are compared in full, and a share that is more than a bound's rounding error.
PRODUCT, ROOM = 16_384, 1e-11


def _complete(own: tuple, other: tuple) -> np.ndarray:
    """Squared complete-linkage distances of clusters (ids, starts, members) with others."""
    x, y, out = own[2], other[2], []
    step = max(1, TILE // len(x))
    for k in range(0, len(y), step):
        z = y[k : k + step]
        d = np.zeros((len(x), len(z)))
        for i in range(x.shape[1]):
            d += np.subtract.outer(x[:, i], z[:, i]) ** 2
        out.append(np.maximum.reduceat(d, own[1], axis=0) if len(own[0]) < len(x) else d)
    wide = np.concatenate(out, axis=1)
    return np.maximum.reduceat(wide, other[1], axis=1) if len(other[0]) < len(y) else wide


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """The clusters c, m (members), x (members end to end) dealt evenly into so many rows of lists."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            whole = pd.concat(held)
            yield pd.DataFrame([{"c": whole["c"].tolist(), "m": whole["m"].tolist(), "x": np.concatenate(whole["x"].tolist())}])

    kind = df.schema["c"].dataType.simpleString()
    return df.select("c", "m", "x").repartition(rows).mapInPandas(pack, f"c array<{kind}>, m array<long>, x array<double>")


class _Clusters:
    """Some clusters with what bounds their distances: means, mean squares about them, radii and boxes of their members."""

    def __init__(self, c: np.ndarray, m: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.m = np.asarray(c), np.asarray(m, int)
        self.x = np.asarray(x, float).reshape(int(self.m.sum()), -1)
        self.starts = np.cumsum(self.m) - self.m
        self.rank = np.argsort(np.argsort(self.ids, kind="stable"))
        self.mean = np.add.reduceat(self.x, self.starts) / self.m[:, None]
        away = ((self.x - np.repeat(self.mean, self.m, axis=0)) ** 2).sum(1)
        self.spread, self.radius = np.add.reduceat(away, self.starts) / self.m, np.sqrt(np.maximum.reduceat(away, self.starts))
        self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)
        self.square = (self.mean**2).sum(1) + self.spread

    def members(self, k: int) -> np.ndarray:
        return self.x[self.starts[k] : self.starts[k] + self.m[k]]


def _bounds(own: _Clusters, other: _Clusters, rows: slice) -> np.ndarray:
    """The mean squared distance of members, which the largest can't be under, less more than its rounding error."""
    a, b = own.square[rows, None] * (1 - ROOM), other.square[:, None] * (1 - ROOM)
    return np.hstack([-2 * own.mean[rows], a, np.ones_like(a)]) @ np.hstack([other.mean, np.ones_like(b), b]).T


def _small(own: _Clusters, other: _Clusters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared complete-linkage distances of pairs of clusters of few members."""
    out, pairs = np.empty(len(i)), own.m[i] * other.m[j]
    part = np.cumsum(pairs) // TILE
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
        p, q, n = i[lo:hi], j[lo:hi], pairs[lo:hi]
        first = np.cumsum(n) - n
        at, wide = np.arange(n.sum()) - np.repeat(first, n), np.repeat(other.m[q], n)
        x, y = own.x[np.repeat(own.starts[p], n) + at // wide], other.x[np.repeat(other.starts[q], n) + at % wide]
        d = np.zeros(len(x))
        for k in range(x.shape[1]):
            d += (x[:, k] - y[:, k]) ** 2
        out[lo:hi] = np.maximum.reduceat(d, first)
    return out


def _large(own: _Clusters, other: _Clusters, i: int, j: int, most: float = np.inf) -> float:
    """The squared complete-linkage distance of two clusters, or any less number over `most` where it is over it.

    Only members that can be further from the other cluster than two that were found are compared.
    """
    x, y = own.members(i), other.members(j)
    u, v = np.sqrt(((x - other.mean[j]) ** 2).sum(1)), np.sqrt(((y - own.mean[i]) ** 2).sum(1))
    one = (np.zeros(1, int), np.zeros(1, int))
    far = lambda p, q: float(_complete((*one, p), (*one, q))[0, 0])
    p, q = u.argmax(), v.argmax()
    found = far(x[p : p + 1], y)
    if not found > most:
        found = max(found, far(x, y[q : q + 1]))
    if found > most:
        return found
    least = np.sqrt(found) * (1 - ROOM)
    x, y = x[u + other.radius[j] >= least], y[v + own.radius[i] >= least]
    return max(found, far(x, y)) if len(x) and len(y) else found


def _size(clusters: DataFrame) -> tuple[int, int, int]:
    """How many clusters, members and numbers there are."""
    return tuple(clusters.agg(F.count(F.lit(1)), F.sum("m"), F.sum(F.size("x"))).first())


def _past(own: DataFrame, clusters: DataFrame, run: Callable[[_Clusters, Iterator[_Clusters]], pd.DataFrame], schema: str, size: tuple[int, int, int] | None = None) -> DataFrame:
    """The rows that run(some clusters of `own`, all clusters in slices) gives, about two groups of `own` a core.

    All clusters are broadcast up to LISTED numbers. Larger ones are read again for each group; then run() may get the slices
    in several calls. Neither way shuffles more than the clusters once.
    """
    count, members, numbers = (n or 0 for n in size or _size(clusters))
    groups = int(max(1, min(count, max(2 * own.sparkSession.sparkContext.defaultParallelism, members // OWN))))
    mine = _packed(own, groups).withColumn("mine", F.spark_partition_id())
    others = _packed(clusters, int(max(1, -(-numbers // SLICE)))).toDF("c2", "m2", "x2")
    pairs = mine.crossJoin(F.broadcast(others)) if numbers <= LISTED else saved(mine, "linkage-own").hint("shuffle_replicate_nl").crossJoin(saved(others, "linkage-slices"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for _, group in groupby(rows, key=lambda r: r.mine):
            first = next(group)
            yield run(_Clusters(first.c, first.m, first.x), (_Clusters(r.c2, r.m2, r.x2) for r in chain([first], group)))

    return pairs.mapInPandas(go, schema)


def nearest(own: DataFrame, clusters: DataFrame, kind: str, size: tuple[int, int, int] | None = None) -> DataFrame:
    """c, its nearest cluster b and their squared distance q, for the clusters of `own`; the smaller id of equally near ones."""

    def run(mine: _Clusters, others: Iterator[_Clusters]) -> pd.DataFrame:
        best, at = np.full(len(mine.ids), np.inf), mine.ids.astype(object)

        def take(other: _Clusters, i: np.ndarray, j: np.ndarray, q: np.ndarray) -> None:
            order = np.lexsort((other.rank[j], q, i))
            i, j, q = i[order], j[order], q[order]
            top = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            for a, b, d in zip(i[top], other.ids[j[top]], q[top], strict=True):
                if d < best[a] or (d == best[a] and np.isfinite(d) and b < at[a]):
                    best[a], at[a] = d, b

        def compare(other: _Clusters, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> None:
            few = mine.m[i] * other.m[j] <= PRODUCT
            take(other, i[few], j[few], _small(mine, other, i[few], j[few]))
            i, j, bound = i[~few], j[~few], bound[~few]
            for k in np.argsort(bound, kind="stable"):
                if bound[k] <= best[i[k]]:
                    q = _large(mine, other, i[k], j[k], best[i[k]])
                    if q <= best[i[k]]:
                        take(other, i[k : k + 1], j[k : k + 1], np.array([q]))

        for other in others:
            _, same, there = np.intersect1d(mine.ids, other.ids, return_indices=True)
            step = max(1, WIDE // len(other.ids))
            for k in range(0, len(mine.ids), step):
                rows = slice(k, k + step)
                bound = _bounds(mine, other, rows)
                here = (same >= k) & (same < k + step)
                bound[same[here] - k, there[here]] = np.inf
                bound[np.isnan(bound)] = np.inf
                i, j = np.arange(len(bound)), bound.argmin(1)
                some = bound[i, j] <= best[rows]
                some &= np.isfinite(bound[i, j])
                compare(other, i[some] + k, j[some], bound[i[some], j[some]])
                bound[i, j] = np.inf
                i, j = np.nonzero((bound <= best[rows, None]) & np.isfinite(bound))
                bound, i = bound[i, j], i + k
                box = (np.maximum(mine.high[i] - other.low[j], other.high[j] - mine.low[i]) ** 2).max(1, initial=0.0)
                near = box <= best[i]
                compare(other, i[near], j[near], np.maximum(bound, box)[near])
        some = np.isfinite(best)
        return pd.DataFrame({"c": mine.ids[some], "b": at[some].astype(mine.ids.dtype), "q": best[some]})

    return _past(own, clusters, run, f"c {kind}, b {kind}, q double", size).groupBy("c").agg(F.min(F.struct("q", "b")).alias("_n")).select("c", "_n.b", "_n.q")


def pair_distances(clusters: DataFrame, kind: str) -> DataFrame:
    """a < b and their squared distance h, for a few clusters."""

    def run(mine: _Clusters, others: Iterator[_Clusters]) -> pd.DataFrame:
        out = []
        for other in others:
            i, j = np.nonzero(mine.ids[:, None] < other.ids[None])
            h, few = np.empty(len(i)), mine.m[i] * other.m[j] <= PRODUCT
            h[few] = _small(mine, other, i[few], j[few])
            h[~few] = [_large(mine, other, p, q) for p, q in zip(i[~few], j[~few], strict=True)]
            out.append(pd.DataFrame({"a": mine.ids[i], "b": other.ids[j], "h": h}))
        return pd.concat(out)

    return _past(clusters, clusters, run, f"a {kind}, b {kind}, h double")


def _merged(pairs: pd.DataFrame, sizes: dict) -> tuple[list[tuple], list[tuple]]:
    """Merges of some clusters by their distances, and the offset of each one's leaves in the order."""
    ids = sorted(sizes)
    at = {c: i for i, c in enumerate(ids)}
    n, count = len(ids), [sizes[c] for c in ids]
    d = np.full((n, n), np.inf)
    i, j = pairs["a"].map(at).to_numpy(int), pairs["b"].map(at).to_numpy(int)
    d[i, j] = pairs["h"].to_numpy()
    members, merges = [[k] for k in range(n)], []
    for _ in range(n - 1):
        lo, hi = divmod(int(np.argmin(d)), n)  # the upper triangle row by row: ties to the smaller ids
        h = float(d[lo, hi])
        total = sum(count[m] for m in members[lo] + members[hi])
        merges.append((ids[lo], ids[hi], h, total))
        members[lo] += members[hi]
        for k in range(n):
            if k not in (lo, hi):
                x, y = (min(lo, k), max(lo, k)), (min(hi, k), max(hi, k))
                d[x] = max(d[x], d[y]) if np.isfinite(d[x]) and np.isfinite(d[y]) else np.inf
        d[hi, :] = d[:, hi] = np.inf
    order = members[0] if n else []
    offsets = np.cumsum([0, *(count[m] for m in order)])
    return merges, [(ids[m], int(o)) for m, o in zip(order, offsets, strict=False)]


def complete_linkage(df: DataFrame, array_col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Merges (left, right: the clusters' smallest ids; height, size) and leaves (the key, position from 0 in the tree's order).

    Rows with a null key or vector are left out; keys are to be different.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(array_col).isNotNull()).select(F.col(key).alias("id"), F.col(array_col).cast("array<double>").alias("x"))
    equal = Window.partitionBy("x").orderBy("id")
    rows = saved(rows.withColumns({"cluster": F.min("id").over(Window.partitionBy("x")), "position": (F.row_number().over(equal) - 1).cast("long")}), "linkage-rows")
    leaves = rows.select("id", "cluster", "position")
    found = rows.where("position > 0").select(F.col("cluster").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("height"), (F.col("position") + 1).alias("size"))
    # c, how many rows and different ones it has, the different ones end to end
    clusters = saved(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")).select(F.col("cluster").alias("c"), "n", F.lit(1).cast("long").alias("m"), "x"), "linkage-clusters")
    near, (count, members, numbers) = None, _size(clusters)
    while count > FINISH:
        stale = clusters if near is None else clusters.join(near.select("c"), "c", "left_anti")
        fresh = nearest(stale, clusters, kind, (count, members, numbers))
        near = saved(fresh if near is None else near.unionByName(fresh), "linkage-near")
        back = near.select(F.col("c").alias("_b"), F.col("b").alias("_c"))
        mutual = near.where("c < b").join(back, (F.col("b") == F.col("_b")) & (F.col("c") == F.col("_c"))).select(F.col("c").alias("lo"), F.col("b").alias("hi"), "q")
        n = lambda side: clusters.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"))
        merged = saved(mutual.join(n("lo"), "lo").join(n("hi"), "hi").select("lo", "hi", F.sqrt("q").alias("h"), "n_lo", "n_hi"), "linkage-merged")
        fewer = merged.count()
        if not fewer:  # no distances that can be compared
            break
        count -= fewer
        found = found.unionByName(merged.select(F.col("lo").alias("left"), F.col("hi").alias("right"), F.col("h").alias("height"), (F.col("n_lo") + F.col("n_hi")).alias("size")))
        goes = merged.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"), "n_lo")
        moved = leaves.join(goes, leaves.cluster == goes._from, "left")
        leaves = saved(moved.select("id", F.coalesce("_to", "cluster").alias("cluster"), (F.col("position") + F.coalesce("n_lo", F.lit(0))).alias("position")), "linkage-leaves")
        joined = clusters.join(goes, clusters.c == goes._from, "left").groupBy(F.coalesce("_to", "c").alias("c"))
        clusters = saved(joined.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.flatten(F.collect_list("x")).alias("x")), "linkage-clusters")
        gone = merged.select(F.explode(F.array("lo", "hi")).alias("_gone"))
        near = near.join(gone, near.c == gone._gone, "left_anti").join(gone, F.col("b") == F.col("_gone"), "left_anti")
    pairs, sizes = saved(pair_distances(clusters, kind), "linkage-pairs"), clusters.select(F.col("c").alias("cluster"), F.col("n").alias("size"))

    def finish(_: tuple, rest: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        merges, order = _merged(rest, dict(zip(clusters["cluster"], clusters["size"], strict=True)))
        return pd.DataFrame([(a, b, np.sqrt(h), n, None) for a, b, h, n in merges] + [(c, None, None, None, o) for c, o in order], columns=["left", "right", "height", "size", "offset"]).astype({"size": "Int64", "offset": "Int64", "height": float})

    one = F.lit(0).alias("_g")
    ended = pairs.groupBy(one).cogroup(sizes.groupBy(one)).applyInPandas(finish, f"left {kind}, right {kind}, height double, size long, offset long")
    ended = saved(ended, "linkage-end")  # FINISH clusters at most
    last = ended.where("offset is null").drop("offset")
    offsets = ended.where("offset is not null").select(F.col("left").alias("cluster"), "offset")
    placed = leaves.join(F.broadcast(offsets), "cluster").select(F.col("id").alias(key), (F.col("position") + F.col("offset")).alias("position"))
    return found.unionByName(last), placed
