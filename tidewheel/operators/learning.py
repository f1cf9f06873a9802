"""Clustering and its scores, components, factorisation, forecasting, federated forests and drift.

Models that scale with rows use pyspark.ml. What runs in numpy works on matrices of bounded size: centroids,
tens of components, a few hundred entities per group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import Block, against_all, distances, packed, saved, summed, tasks


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def pca_importance(df: DataFrame, columns: list[str], k: int = 3, scale_to_one: bool = True) -> DataFrame:
    """feature, importance: absolute loadings, normalised per component, times the variance it explains."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(assembled(df, columns))
    loading = np.abs(model.pc.toArray())
    share = (loading / loading.sum(0)) @ model.explainedVariance.toArray()
    if scale_to_one:
        share = share / share.sum()
    return df.sparkSession.createDataFrame([(c, float(s)) for c, s in zip(columns, share, strict=True)], "feature string, importance double")


def explained_variance(df: DataFrame, columns: list[str], target: float = 0.95) -> DataFrame:
    """component, variance, running, enough (the first components that reach the target)."""
    v = PCA(k=len(columns), inputCol="features", outputCol="_pc").fit(assembled(df, columns)).explainedVariance.toArray()
    run = np.cumsum(v)
    rows = [(k + 1, float(x), float(r), bool(k == 0 or run[k - 1] < target)) for k, (x, r) in enumerate(zip(v, run, strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, running double, enough boolean")


def projected(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """df with pc1 to pc<k>; each component's largest loading is positive."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(assembled(df, columns))
    loading = model.pc.toArray()
    sign = np.sign(loading[np.abs(loading).argmax(0), np.arange(k)])
    a = vector_to_array("_pc")
    return model.transform(assembled(df, columns)).withColumns({f"pc{i + 1}": a[i] * float(sign[i]) for i in range(k)}).drop("features", "_pc")


def vectors(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def cluster_scores(df: DataFrame, array_col: str, cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of labelled vectors, from per-cluster sums; a row."""
    long = df.select(cluster, F.posexplode(array_col).alias("_d", "_x"))
    centre = long.groupBy(cluster, "_d").agg(F.avg("_x").alias("_c"))
    whole = centre.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_c"))), lambda p: p["_c"]).alias("_centre"))
    square = F.aggregate(F.zip_with(array_col, "_centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    near = df.join(whole, cluster).select(cluster, square.alias("_sq"))
    per = near.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("_sq").alias("w"), F.avg(F.sqrt("_sq")).alias("s")).toPandas().set_index(cluster).sort_index()
    c = centre.toPandas().pivot(index=cluster, columns="_d", values="_c").sort_index().to_numpy()
    n, w, s = per["n"].to_numpy(float), float(per["w"].sum()), per["s"].to_numpy(float)
    k, total = len(n), n.sum()
    overall = (c * n[:, None]).sum(0) / total
    between = float((n * ((c - overall) ** 2).sum(1)).sum())
    ch = between / (k - 1) / (w / (total - k)) if k > 1 and w > 0 else None
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    db = float(np.max((s[:, None] + s[None]) / gap, axis=1).mean()) if k > 1 else None
    return df.sparkSession.createDataFrame([(k, w, None if ch is None else float(ch), None if db is None else float(db))], "clusters int, inertia double, calinski_harabasz double, davies_bouldin double")


def silhouette(df: DataFrame, array_col: str, cluster: str, key: str) -> DataFrame:
    """Mean Euclidean silhouette of all rows against all rows, compared in blocks; rows of the same key aren't compared."""
    return silhouettes(df, array_col, [cluster], key).toDF("silhouette")


def silhouettes(df: DataFrame, array_col: str, clusters: list[str], key: str) -> DataFrame:
    """silhouette() by several columns of clusters, a column s0, s1, ... each: all rows meet all rows once."""
    names = [np.array([r[0] for r in df.select(c).distinct().orderBy(c).collect()]) for c in clusters]

    def run(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
        total, n = ([np.zeros((len(mine.x), len(m))) for m in names] for _ in range(2))
        for b in others:
            d, same = distances(mine.x, b.x), mine.columns[0][:, None] == b.columns[0][None]
            d[same] = 0
            for k, m in enumerate(names):
                member = (b.columns[k + 1][:, None] == m[None]).astype(float)
                total[k] += d @ member
                n[k] += ~same @ member
        out = {}
        for k, m in enumerate(names):
            mean = np.where(n[k] > 0, total[k] / np.maximum(n[k], 1), np.nan)
            own = mine.columns[k + 1][:, None] == m[None]
            a = mean[own]
            rest = np.where(own | np.isnan(mean), np.inf, mean).min(1)
            out[f"s{k}"] = np.where(np.isnan(a) | np.isinf(rest), 0.0, (rest - a) / np.maximum(np.maximum(a, rest), 1e-300))
        return pd.DataFrame(out)

    columns = [f"s{k}" for k in range(len(clusters))]
    return against_all(packed(df, array_col, [key, *clusters], key), run, ", ".join(f"{c} double" for c in columns)).agg(*(F.avg(c).alias(c) for c in columns))


def connectivity(df: DataFrame, array_col: str, cluster: str, key: str, neighbours: int = 10) -> DataFrame:
    """Sum of 1/rank over each row's nearest neighbours (the smaller key first on a tie) that are in another cluster; all rows in blocks."""

    def run(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
        x, square, n = mine.x, (mine.x**2).sum(1), len(mine.x)
        far, i = np.full(n, np.inf), np.zeros(0, int)  # squared distance of each row's last neighbour; the row of each neighbour
        d, keys, names = np.zeros(0), mine.columns[1][:0], mine.columns[0][:0]
        for b in others:
            other = (b.x**2).sum(1)
            room = 1e-11 * (square[:, None] + other[None])  # more than the error of the quick distance, so that no neighbour is lost
            quick = square[:, None] + other[None] - 2 * x @ b.x.T - room
            quick[mine.columns[1][:, None] == b.columns[1][None]] = np.inf
            near = quick <= far[:, None]
            if near.sum() > 4 * neighbours * n and quick.shape[1] > neighbours:
                most = np.partition(quick + 2 * room, neighbours - 1, axis=1)[:, neighbours - 1]
                near &= quick <= most[:, None]
            p, q = np.nonzero(near & np.isfinite(quick))
            if not len(p):
                continue
            new = np.concatenate([((x[p[k : k + 50_000]] - b.x[q[k : k + 50_000]]) ** 2).sum(1) for k in range(0, len(p), 50_000)])
            hit = np.zeros(n, bool)
            hit[p] = True
            old = hit[i]
            row, away = np.concatenate([i[old], p]), np.concatenate([d[old], new])
            key_, name = np.concatenate([keys[old], b.columns[1][q]]), np.concatenate([names[old], b.columns[0][q]])
            order = np.lexsort((key_, away, row))
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == neighbours - 1
            far[row[last]] = away[order[last]]
            order, row = order[rank < neighbours], row[rank < neighbours]
            i, d, keys, names = (np.concatenate(c) for c in ((i[~old], row), (d[~old], away[order]), (keys[~old], key_[order]), (names[~old], name[order])))
        order = np.lexsort((keys, d, i))
        i, names = i[order], names[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return pd.DataFrame({"c": np.bincount(i, (names != mine.columns[0][i]) / (1 + rank), n)})

    return against_all(packed(df, array_col, [cluster, key], key), run, "c double").agg(F.sum("c").alias("connectivity"))


def dunn(df: DataFrame, array_col: str, cluster: str, key: str) -> DataFrame:
    """Dunn index by cosine distance: the nearest rows of different clusters over the furthest of the same; all rows in blocks.

    Null with one cluster only, or where no cluster has two different rows; a vector of zeros is at distance 1.
    """

    def run(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        x, between, within = unit(mine.x), np.full(len(mine.x), np.inf), np.full(len(mine.x), -np.inf)
        for b in others:
            d, same = 1 - x @ unit(b.x).T, mine.columns[0][:, None] == b.columns[0][None]
            between = np.minimum(between, np.where(same, np.inf, d).min(1))
            within = np.maximum(within, np.where(same & (mine.columns[1][:, None] != b.columns[1][None]), d, -np.inf).max(1))
        return pd.DataFrame({"between": np.where(np.isinf(between), np.nan, between), "within": np.where(np.isinf(within), np.nan, within)})

    found = against_all(packed(df, array_col, [cluster, key], key), run, "between double, within double")
    return found.agg(F.try_divide(F.min("between"), F.max("within")).alias("dunn"))


def knee(curve: DataFrame, x: str, y: str, keys: list[str] = (), decreasing: bool = False) -> DataFrame:
    """keys, knee: the first x at which a concave rising (or convex falling) curve is furthest from the line between its ends.

    Both axes are scaled to 0..1. A curve of fewer than three points, or a flat one, has none (null).
    """
    w = Window.partitionBy(*keys)
    scaled = lambda c: F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
    high = 1 - scaled(y) if decreasing else scaled(y)
    rows = curve.select(*keys, F.col(x).alias("_x"), F.round(high - scaled(x), 12).alias("_d"))
    o = w.orderBy("_x")
    top = (F.col("_d") >= F.lag("_d").over(o)) & (F.col("_d") >= F.lead("_d").over(o))
    return rows.withColumn("_top", top).groupBy(*keys).agg(F.min(F.when(F.col("_top"), F.col("_x"))).alias("knee"))


def kmeans_sweep(df: DataFrame, array_col: str, key: str, ks: range = range(2, 10), seed: int = 1) -> DataFrame:
    """For each k: inertia, silhouette, Calinski-Harabasz, Davies-Bouldin."""
    data = vectors(df, array_col)
    out = None
    for k in ks:
        fitted = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data)
        row = cluster_scores(fitted, array_col, "cluster").withColumn("k", F.lit(k)).crossJoin(silhouette(fitted, array_col, "cluster", key))
        out = row if out is None else out.unionByName(row)
    return out


def gaussian_clusters(df: DataFrame, array_col: str, k: int = 2, seed: int = 1) -> DataFrame:
    data = vectors(df, array_col)
    return GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data).drop("features", "probability")


#: Rows that can be a medoid which are collected and meet all members in one pass; more of them are compared in blocks.
CANDIDATES = 16_384


def _moments(members: DataFrame, centres: np.ndarray) -> list[np.ndarray]:
    """For each cluster the sums of products of (1, z, |z|^2) with themselves, z being x less the cluster's centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for c, rows in batch.groupby("cluster"):
                z = np.array(rows["x"].tolist(), float) - centres[c]
                z = np.column_stack([np.ones(len(z)), z, (z**2).sum(1)])
                sums[c] = sums.get(c, 0) + z.T @ z
        if sums:
            yield pd.DataFrame({"cluster": list(sums), "s": [m.ravel() for m in sums.values()]})

    sent = members.select("cluster", "x").mapInPandas(run, "cluster int, s array<double>")
    found = sent.select("cluster", F.posexplode("s").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v")).toPandas()  # (dimensions + 2)^2 a cluster
    width = centres.shape[1] + 2
    out = [np.zeros((width, width)) for _ in centres]
    for c, part in found.groupby("cluster"):
        out[c] = part.sort_values("i")["v"].to_numpy().reshape(width, width)
    return out


def _possible(members: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """The members that can be their cluster's medoid, equal ones once (by least hash).

    The mean distance of a row is under the root of its mean squared one m, and by Hoelder's inequality over m^1.5 over the root of the mean of
    the squares' squares; both means follow from sums over the cluster.
    """
    moments = _moments(members, centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(moments), np.inf)
        for batch in batches:
            for c, rows in batch.groupby("cluster"):
                z = np.array(rows["x"].tolist(), float) - centres[c]
                q = (z**2).sum(1)
                e = moments[c] / moments[c][0, 0]
                w = np.column_stack([q, -2 * z, np.ones(len(z))])  # a squared distance is w . (1, z, |z|^2) of the other row
                room = 1e-9 * (q + e[0, -1])
                mean = w @ e[0]
                fourth = np.einsum("ij,jk,ik->i", w, e, w, optimize=True) + 1e-9 * (q + np.sqrt(e[-1, -1])) ** 2
                high = np.sqrt(np.maximum(mean, 0) + room)
                low = np.maximum(mean - room, 0) ** 1.5 / np.sqrt(np.maximum(fourth, 1e-300))
                best[c] = min(best[c], high.min())
                near = low <= best[c]
                if near.any():
                    yield rows[near].assign(low=low[near], high=high[near])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    rows = saved(members.select(key, "x", "cluster", "_h").mapInPandas(run, f"`{key}` {kinds[key]}, x array<double>, cluster int, _h long, low double, high double"), "medoid-near")
    least = F.broadcast(rows.groupBy("cluster").agg(F.min("high").alias("least")))
    rows = rows.join(least, "cluster").where("low <= least")
    return rows.groupBy("cluster", "x").agg(F.min(F.struct("_h", key)).alias("_m")).select("cluster", "x", "_m._h", f"_m.{key}")


def _dearest(members: DataFrame, key: str, medoids: list) -> list:
    """The medoid of each cluster: the member of least summed distance to all members, by hash on a tie."""
    kind = members.schema[key].dataType.simpleString()
    few = saved(_possible(members, key, np.array([m["x"] for m in medoids], float)), "medoid-possible")
    if few.count() <= CANDIDATES:
        held = few.toPandas()
        by = {int(c): (rows.index.to_numpy(), np.array(rows["x"].tolist(), float)) for c, rows in held.groupby("cluster")}

        def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(len(held))
            for batch in batches:
                for c, rows in batch.groupby("cluster"):
                    at, x = by[c]
                    y = np.array(rows["x"].tolist(), float)
                    for k in range(0, len(y), 512):
                        sums[at] += distances(x, y[k : k + 512]).sum(1)
            yield pd.DataFrame({"i": np.arange(len(sums)), "cost": sums})

        costs = members.select("cluster", "x").mapInPandas(cost, "i int, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).toPandas()
        held["cost"] = costs.set_index("i")["cost"]
        new = held.sort_values(["cluster", "cost", "_h"]).groupby("cluster", sort=True).head(1)
        return [{key: r[key], "x": [float(v) for v in r["x"]]} for r in new.to_dict("records")]

    def dearest(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
        cost = sum(distances(mine.x, b.x).sum(1) for b in others)
        i = np.lexsort((mine.columns[1], cost))[0]
        return pd.DataFrame([{"cluster": mine.columns[0][i], "cost": cost[i], "h": mine.columns[1][i], key: mine.columns[2][i], "x": mine.x[i]}])

    best = against_all(packed(members, "x", ["cluster", "_h", key], key, "cluster"), dearest, f"cluster int, cost double, h long, {key} {kind}, x array<double>")
    return [r.m for r in best.groupBy("cluster").agg(F.min(F.struct("cost", "h", key, "x")).alias("m")).orderBy("cluster").collect()]


def _best_medoid(medoids: list) -> Column:
    """Struct of d and c: the distance and the number of the nearest medoid of x."""
    away = lambda x, m: F.sqrt(F.aggregate(F.zip_with(x, F.array(*map(F.lit, m)), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return F.array_min(F.array(*(F.struct(away(F.col("x"), m["x"]).alias("d"), F.lit(i).alias("c")) for i, m in enumerate(medoids))))


def _medoids(rows: DataFrame, key: str, k: int, rounds: int, seed: int) -> list:
    medoids = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k).collect()
    for _ in range(rounds):
        members = rows.select(key, "x", _best_medoid(medoids)["c"].alias("cluster"), F.xxhash64(key, F.lit(seed + 1)).alias("_h"))
        new = _dearest(members, key, medoids)
        if [m[key] for m in new] == [m[key] for m in medoids]:
            break
        medoids = new
    return medoids


def _labelled(rows: DataFrame, key: str, medoids: list) -> DataFrame:
    ids = F.array(*(F.lit(int(m[key]) if not isinstance(m[key], str) else m[key]) for m in medoids))
    return rows.withColumn("_b", _best_medoid(medoids)).select(key, F.col("_b.c").alias("cluster"), F.get(ids, F.col("_b.c")).alias("medoid"), F.col("_b.d").alias("distance"))


def kmedoids(df: DataFrame, array_col: str, key: str, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """key, cluster, medoid, distance. Assignment is a map against k medoids; a cluster's new medoid is the member
    of least summed distance to all members. Bounds of that sum leave out most members; the others meet all members."""
    rows = df.select(key, F.col(array_col).cast("array<double>").alias("x"))
    return _labelled(rows, key, _medoids(rows, key, k, rounds, seed))


def kmedoids_starts(df: DataFrame, array_col: str, key: str, k: int, starts: int = 5, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """kmedoids() from several starts: the labels of the best one, and a row per start: silhouette, Calinski-Harabasz,
    Davies-Bouldin, the mean of its ranks by these (1 is the best, equal scores share their ranks) and whether it is best.

    A tie of mean ranks goes to the first start. All starts' silhouettes come from one comparison of all rows.
    """
    rows = df.select(key, F.col(array_col).cast("array<double>").alias("x"))
    fitted = [_medoids(rows, key, k, rounds, seed + start) for start in range(starts)]
    names = [f"_c{start}" for start in range(starts)]
    labelled = saved(rows.select(key, "x", *(_best_medoid(m)["c"].alias(c) for c, m in zip(names, fitted, strict=True))), "medoid-starts")
    scores, between = [], silhouettes(labelled, "x", names, key).first()
    for start, name in enumerate(names):
        own = cluster_scores(labelled, "x", name).first()
        scores.append((start, between[start], own.calinski_harabasz, own.davies_bouldin))
    table = pd.DataFrame(scores, columns=["start", "silhouette", "calinski_harabasz", "davies_bouldin"])  # a row per start
    ranks = [table["silhouette"].rank(ascending=False), table["calinski_harabasz"].rank(ascending=False), table["davies_bouldin"].rank()]
    table["mean_rank"] = sum(ranks) / len(ranks)
    best = int(table["mean_rank"].fillna(np.inf).to_numpy().argmin())
    table["best"] = table["start"] == best
    return _labelled(rows, key, fitted[best]), df.sparkSession.createDataFrame(table, "start int, silhouette double, calinski_harabasz double, davies_bouldin double, mean_rank double, best boolean")


def nmf(v: np.ndarray, k: int, rounds: int = 200, w: np.ndarray | None = None, h: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates; given h, only w is fitted."""
    rng = np.random.default_rng(seed)
    fixed = h is not None
    w = rng.random((len(v), k)) + 0.1 if w is None else w
    h = rng.random((k, v.shape[1])) + 0.1 if h is None else h
    for _ in range(rounds):
        w = w * (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        if not fixed:
            h = h * (w.T @ v) / np.maximum((w.T @ w) @ h, 1e-12)
    return w, h


def nmf_path(v: np.ndarray, ks: list[int], seed: int = 0) -> list[dict]:
    """Errors for numbers of components, largest first, each started from the strongest parts of the last."""
    out, w, h = [], None, None
    for k in sorted(ks, reverse=True):
        if w is not None:
            top = np.argsort(-(np.linalg.norm(w, axis=0) * np.linalg.norm(h, axis=1)))[:k]
            w, h = w[:, top], h[top]
            for _ in range(50):
                w = w * (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
                h = h * (w.T @ v) / np.maximum((w.T @ w) @ h, 1e-12)
        else:
            w, h = nmf(v, k, seed=seed)
        e = v - w @ h
        out.append({"k": k, "frobenius": float(np.linalg.norm(e)), "mse": float((e**2).mean()), "r2": float(1 - (e**2).sum() / ((v - v.mean()) ** 2).sum())})
    return out


def _nmf_pass(df: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """W'V, W'W and the squared error over all rows, W being each row's weights for h."""
    k, m = h.shape

    def run(b: pd.DataFrame) -> np.ndarray:
        v = np.array(b["x"].tolist(), float).reshape(len(b), -1)
        w, _ = nmf(v, k, 100, w=np.ones((len(v), k)), h=h)
        return np.concatenate([(w.T @ v).ravel(), (w.T @ w).ravel(), [((v - w @ h) ** 2).sum()]])

    got = summed(df, ["x"], run, k * m + k * k + 1)
    return got[: k * m].reshape(k, m), got[k * m : -1].reshape(k, k), float(got[-1])


def nmf_components(df: DataFrame, h: np.ndarray, passes: int = 60, least: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Components fitted on all rows from h on, W'W and the squared error under them; df has the vectors as x.

    A pass fits every row's weights in its task and sums W'V and W'W, which are all that the update of h needs; passes
    end when the error falls by less than `least` of itself.
    """
    wv, ww, error = _nmf_pass(df, h)
    for _ in range(passes):
        new = h
        for _ in range(50):
            new = new * wv / np.maximum(ww @ new, 1e-12)
        wv2, ww2, error2 = _nmf_pass(df, new)
        if error2 > error:
            break
        done, h, wv, ww, error = error - error2 <= least * error, new, wv2, ww2, error2
        if done:
            break
    return h, ww, error


def nmf_fitted(df: DataFrame, array_col: str, k: int, seed: int = 0) -> np.ndarray:
    """k components of all rows."""
    rows = saved(df.select(F.col(array_col).cast("array<double>").alias("x")), "nmf-rows")
    head = rows.first()
    return np.zeros((k, 0)) if head is None else nmf_components(rows, np.random.default_rng(seed).random((k, len(head.x))) + 0.1)[0]


def nmf_errors(df: DataFrame, array_col: str, ks: list[int], seed: int = 0) -> DataFrame:
    """k, frobenius, mse, r2 over all rows, largest k first, each started from the strongest parts of the last."""
    rows = saved(df.select(F.col(array_col).cast("array<double>").alias("x")), "nmf-rows")
    n, mean = rows.select(F.explode("x").alias("v")).agg(F.count("v"), F.avg("v")).first()
    spread = rows.select(F.explode("x").alias("v")).agg(F.sum((F.col("v") - F.lit(mean)) * (F.col("v") - F.lit(mean)))).first()[0]
    out, h, ww = [], None, None
    for k in sorted(ks, reverse=True) if n else []:
        if h is None:
            h = np.random.default_rng(seed).random((k, len(rows.first().x))) + 0.1
        else:
            h = h[np.argsort(-(np.sqrt(np.diag(ww)) * np.linalg.norm(h, axis=1)))[:k]]
        h, ww, error = nmf_components(rows, h)
        out.append((k, float(np.sqrt(error)), float(error / n), float(1 - error / spread)))
    return df.sparkSession.createDataFrame(out, "k int, frobenius double, mse double, r2 double")


def nmf_weights(df: DataFrame, key: str, array_col: str, h: np.ndarray) -> DataFrame:
    """Weights of given components for every row, in batches."""

    def run(batches):
        for b in batches:
            v = np.array(b["x"].tolist(), float).reshape(len(b), -1)
            w, _ = nmf(v, len(h), 100, w=np.ones((len(v), len(h))), h=h)
            yield pd.DataFrame({key: b[key], "weights": list(w)})

    rows = df.select(key, F.col(array_col).cast("array<double>").alias("x"))
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, weights array<double>")


def welch(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density: Hann windows overlapping by half, mean removed, averaged."""
    segment = min(segment, len(x))
    step = max(1, segment // 2)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = [x[i : i + segment] for i in range(0, len(x) - segment + 1, step)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * win)) ** 2 for p in parts], axis=0) / (rate * (win**2).sum())
    power[1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / rate), power


def spectra(df: DataFrame, keys: list[str], order: str, value: str, rate: float, segment: int) -> DataFrame:
    """keys, frequency, power of each group's series."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, p = welch(rows.sort_values(order)[value].to_numpy(float), rate, segment)
        return pd.DataFrame({k: [v] * len(f) for k, v in zip(keys, key, strict=True)} | {"frequency": f, "power": p})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", frequency double, power double")


def short_time_spectra(df: DataFrame, keys: list[str], position: str, value: str, rate: float, segment: int) -> DataFrame:
    """keys, segment, frequency, power: of each stretch of `segment` readings, stretches overlapping by half.

    `position` counts a series' readings; stretch s starts at s x segment / 2, and those not full go. Each stretch is a
    group of its own, so a series need not fit in a task.
    """
    if segment < 2 or segment % 2:
        raise ValueError("segment must be even")
    half = F.floor(F.col(position) / (segment // 2)).cast("long")
    cut = df.select(*keys, F.explode(F.array(half, half - 1)).alias("segment"), F.col(position).alias("_i"), F.col(value).cast("double").alias("_v")).na.drop(subset=["_v"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "segment"]
        if len(rows) != segment:
            return pd.DataFrame([], columns=[*names, "frequency", "power"])
        f, p = welch(rows.sort_values("_i")["_v"].to_numpy(), rate, segment)
        return pd.DataFrame({k: [v] * len(f) for k, v in zip(names, key, strict=True)} | {"frequency": f, "power": p})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return cut.groupBy(*keys, "segment").applyInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "segment long, frequency double, power double")


def bands(psd: DataFrame, keys: list[str], at: str, value: str, edges: list[tuple[float, float]]) -> DataFrame:
    """Sum and count per band, both ends closed; a row may be in two bands. The band is found in the row, without a join."""
    hit = F.filter(F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in edges)), lambda e: (F.col(at) >= e["lo"]) & (F.col(at) <= e["hi"]))
    rows = psd.select(*keys, value, F.explode(hit).alias("_e"))
    return rows.groupBy(*keys, F.col("_e.lo").alias("lo"), F.col("_e.hi").alias("hi")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> dict:
    """A regression tree as nested dicts, splitting on random features at quantiles."""
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return {"v": float(y.mean()) if len(y) else 0.0}
    best = (np.inf, 0, 0.0)
    for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 3 + 1)]:
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9))):
            left = x[:, f] <= cut
            if least <= left.sum() <= len(y) - least:
                err = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if err < best[0]:
                    best = (err, int(f), float(cut))
    if not np.isfinite(best[0]):
        return {"v": float(y.mean())}
    left = x[:, best[1]] <= best[2]
    return {"f": best[1], "t": best[2], "l": tree(x[left], y[left], depth - 1, least, rng), "r": tree(x[~left], y[~left], depth - 1, least, rng)}


def grown(t: dict, x: np.ndarray) -> np.ndarray:
    if "v" in t:
        return np.full(len(x), t["v"])
    left = x[:, t["f"]] <= t["t"]
    out = np.zeros(len(x))
    out[left], out[~left] = grown(t["l"], x[left]), grown(t["r"], x[~left])
    return out


def local_forests(df: DataFrame, worker: str, features: list[str], target: str, trees: int = 5, depth: int = 5, seed: int = 0) -> DataFrame:
    """worker, tree_no, tree (JSON): each worker's own forest on its own rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[features].to_numpy(float), rows[target].to_numpy(float)
        out = []
        for k in range(trees):
            rng = np.random.default_rng([seed, k])
            pick = rng.integers(0, len(y), len(y))
            out.append({worker: key[0], "tree_no": k, "tree": json.dumps(tree(x[pick], y[pick], depth, 5, rng))})
        return pd.DataFrame(out)

    kind = df.schema[worker].dataType.simpleString()
    return df.groupBy(worker).applyInPandas(run, f"{worker} {kind}, tree_no int, tree string")


def _flat(text: str) -> list[list[float]]:
    """A tree's nodes as rows of feature, cut, left, right, value; a leaf leads to itself."""
    nodes: list[list[float]] = []

    def put(t: dict) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, t.get("v", 0.0)])
        if "v" not in t:
            nodes[at][:4] = [t["f"], t["t"], put(t["l"]), put(t["r"])]
        return at

    put(json.loads(text))
    return nodes


def tree_tables(trees: list[str]) -> np.ndarray:
    """Trees as one table: a row of nodes for each, padded with leaves to the same number."""
    flat = [_flat(t) for t in trees]
    most = max(map(len, flat))
    return np.array([f + [[0, np.inf, k, k, 0.0] for k in range(len(f), most)] for f in flat])


def predictions(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Predictions of every tree (rows) for every row of x (columns)."""
    feature, left, right = (table[:, :, k].astype(np.int64) for k in (0, 2, 3))
    at, t, r = np.zeros((len(table), len(x)), np.int64), np.arange(len(table))[:, None], np.arange(len(x))[None]
    while True:
        to = np.where(x[r, feature[t, at]] <= table[:, :, 1][t, at], left[t, at], right[t, at])
        if (to == at).all():
            return table[:, :, 4][t, at]
        at = to


#: Rows and trees of a block: a task compares one block of each at a time.
LOSS_ROWS, LOSS_TREES = 8000, 256
#: Points times workers a row up to which errors are products, and the share of its parts below which a difference is taken from the rows.
LOSS_CELLS, LOSS_LEFT = 16, 1e-3


def squared_errors(p: np.ndarray, at: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Summed squared errors of trees (rows) for workers (columns): the trees' predictions at points, each row's point and value, rows by worker.

    Where points repeat they are products with the workers' counts and sums at the points; those that would lose digits
    by it, and all where points hardly repeat, are taken row by row.
    """
    starts, points = np.r_[0, np.cumsum(counts)[:-1]], p.shape[1]
    if points * len(counts) > LOSS_CELLS * len(y):
        return np.concatenate([np.add.reduceat((q[:, at] - y[None]) ** 2, starts, axis=1) for q in np.array_split(p, -(-len(p) // 16))])
    known = y[np.isfinite(y)]
    middle = known.mean() if len(known) else 0.0
    q, z = p - middle, y - middle
    cell = np.repeat(np.arange(len(counts)) * points, counts) + at
    n, s = (np.bincount(cell, v, len(counts) * points).reshape(len(counts), points) for v in (None, z))
    with np.errstate(invalid="ignore", over="ignore"):
        whole = (q * q) @ n.T.astype(float) + np.add.reduceat(z * z, starts)[None]
        total = whole - 2 * (q @ s.T)
        again = ~((total >= LOSS_LEFT * whole) & np.isfinite(total))
        for w in np.flatnonzero(again.any(0)):
            rows = slice(starts[w], starts[w] + counts[w])
            total[again[:, w], w] = ((p[again[:, w]][:, at[rows]] - y[rows]) ** 2).sum(1)
    return total


def _row_of_lists(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns], names)


def tree_blocks(forest: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Blocks of up to `size` trees: a list per column, their nodes as `table`, parsed once, their number, and which of them are alike.

    Trees with columns come in the order of their text, so that those alike share blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in forest.schema.fields}
    given = saved(forest.select(*columns, "tree"), "given-trees")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                texts, seen = b.column(len(columns)).to_pylist(), {}
                table, alike = tree_tables(texts), [seen.setdefault(t, len(seen)) for t in texts]
                yield _row_of_lists([*b.columns[: len(columns)], pa.array(table.ravel()), pa.array([len(table)], pa.int32()), pa.array(alike, pa.int32())], [*columns, "table", "trees", "alike"])

    parts = max(1, min(tasks(forest.sparkSession), given.count() // (4 * size)))
    few = given.repartitionByRange(parts, "tree", *columns).sortWithinPartitions("tree", *columns) if columns else given.repartition(parts)
    schema = ", ".join([*(f"{c} array<{kinds[c]}>" for c in columns), "table array<double>", "trees array<int>", "alike array<int>"])
    return saved(few.mapInArrow(bundle, schema), "tree-blocks")


def all_pairs(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Every block of rows with every block of trees, all trees in turn for a block of rows; neither side's product is shuffled."""
    n, most = max(1, rows.count()), 4 * tasks(rows.sparkSession)
    dealt = rows.repartition(min(n, most)).hint("shuffle_replicate_nl")  # where rows were broadcast, the few parts of trees would be all tasks
    return dealt.crossJoin(trees.repartition(max(1, min(trees.count(), most // min(n, most) * 4))))


def federated_losses(forest: DataFrame, df: DataFrame, worker: str, features: list[str], target: str, donated: int = 1) -> DataFrame:
    """worker, donor, tree_no, rmse: every worker's error under the trees that workers donate (the first `donated` of each).

    The donated trees are the global model. Rows and trees meet in blocks. A worker whose rows fit in one block has its
    errors there and then, so that they aren't shuffled; those of a larger worker are summed by tree. There may be any
    number of rows and trees; the result has workers x trees rows by definition. Workers of the same rows, and trees that
    are alike, are judged once a block and stand beside each other in the result, which keeps its files small.
    """
    kind = df.schema[worker].dataType.simpleString()
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(F.col(worker).alias("w"), *(F.col(c).cast("double").alias(f) for f, c in zip(names, features, strict=True)), F.col(target).cast("double").alias("y"))
    of = rows.groupBy(F.col("w").alias("_w")).agg(F.count(F.lit(1)).alias("of"), F.bit_xor(F.xxhash64("y", *names)).alias("alike"))  # the same rows have the same
    rows = rows.join(of, F.col("w").eqNullSafe(F.col("_w"))).select("w", *names, "y", "of", "alike")
    rows = rows.repartitionByRange("alike", "w", F.xxhash64("y", *names)).sortWithinPartitions("alike", "w", "y", *names)
    size = LOSS_ROWS

    def block(b: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole workers in one block, rows of parts of a worker in another."""
        coded = b.column(0).combine_chunks().dictionary_encode("encode")
        code, total = coded.indices.to_numpy(), b.column("of").to_numpy()
        whole = np.bincount(code)[code] == total
        for done in (True, False):
            mine = np.flatnonzero(whole == done)
            mine = mine[np.argsort(code[mine], kind="stable")]
            if len(mine):
                x = np.column_stack([b.column(f).to_numpy()[mine] for f in names]) if names else np.zeros((len(mine), 0))
                points, at = np.unique(x, axis=0, return_inverse=True)
                here, counts = np.unique(code[mine], return_counts=True)
                at, y, ends, first = at.ravel(), b.column("y").to_numpy()[mine], np.cumsum(counts), {}
                spans = [slice(e - n, e) for e, n in zip(ends, counts, strict=True)]
                alike = np.array([first.setdefault((at[s].tobytes(), y[s].tobytes()), len(first)) for s in spans])
                once = np.unique(alike, return_index=True)[1]  # of workers with the same rows the first
                at, y = (np.concatenate([v[spans[k]] for k in once]) for v in (at, y))
                lists = [coded.dictionary.take(pa.array(here)), pa.array(counts[once]), pa.array(points.ravel()), pa.array(at), pa.array(y), pa.array([done]), pa.array(alike)]
                yield _row_of_lists(lists, ["workers", "counts", "x", "at", "y", "whole", "same"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            left = held if left is None else pa.concat_tables([left, held])
            while left.num_rows > size:
                code = left.column(0).combine_chunks().slice(0, size + 1).dictionary_encode("encode").indices.to_numpy()
                starts = np.flatnonzero(code[1:] != code[:-1]) + 1  # a block ends with a worker, if one ends in it
                end = int(starts[-1]) if len(starts) else size
                yield from block(left.slice(0, end))
                left = left.slice(end)
        if left is not None and left.num_rows:
            yield from block(left)

    row_blocks = saved(rows.mapInArrow(pack, f"workers array<{kind}>, counts array<long>, x array<double>, at array<long>, y array<double>, whole array<boolean>, same array<long>"), "loss-rows")
    given = tree_blocks(forest.where(F.col("tree_no") < donated).select(F.col(worker).alias("donors"), F.col("tree_no").cast("int").alias("numbers"), "tree"), ["donors", "numbers"], LOSS_TREES)

    def judge(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    workers, counts, x, at, y, _, same, donors, numbers, table, trees, alike = (b.column(k)[i].values for k in range(12))
                    n, counts, at, same, alike = trees[0].as_py(), *(v.to_numpy() for v in (counts, at, same, alike))
                    x = x.to_numpy().reshape(at.max() + 1, -1)
                    different = table.to_numpy().reshape(n, -1, 5)[np.unique(alike, return_index=True)[1]]
                    total = squared_errors(predictions(different, x), at, y.to_numpy(zero_copy_only=False), counts)
                    total, counts = total[alike][:, same], counts[same]
                    of, by = pa.array(np.tile(np.arange(len(workers)), n)), pa.array(np.repeat(np.arange(n), len(workers)))
                    pair = [workers.take(of), donors.take(by), numbers.take(by)]
                    last = [pa.array(np.sqrt(total / counts[None]).ravel())] if whole else [pa.array(total.ravel()), pa.array(np.tile(counts, n))]
                    yield pa.RecordBatch.from_arrays([*pair, *last], [worker, "donor", "tree_no", "rmse"] if whole else ["w", "donor", "tree_no", "e", "n"])

        return run

    done, parts = (row_blocks.where(F.col("whole")[0] == w) for w in (True, False))
    out = all_pairs(done, given).mapInArrow(judge(True), f"{worker} {kind}, donor {kind}, tree_no int, rmse double")
    part = all_pairs(parts, given).mapInArrow(judge(False), f"w {kind}, donor {kind}, tree_no int, e double, n long")
    return out.unionByName(part.groupBy("w", "donor", "tree_no").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("rmse")).withColumnRenamed("w", worker))


def _swarm(n: int, cost: Callable[[list[np.ndarray]], list[float]], most: int, particles: int, rounds: int, seed: int) -> np.ndarray:
    """The choice of centres among n candidates that a binary particle swarm finds cheapest; cost() judges a round's choices together."""
    rng = np.random.default_rng(seed)

    def judged(pos: np.ndarray) -> np.ndarray:
        out = np.full(len(pos), np.inf)
        fit = [k for k, p in enumerate(pos) if 2 <= p.sum() <= most]
        if fit:
            out[fit] = cost([np.flatnonzero(pos[k]) for k in fit])
        return out

    pos = rng.random((particles, n)) < min(0.5, most / 2 / n)
    vel = rng.normal(0, 1, (particles, n))
    best, score = pos.copy(), judged(pos)
    for _ in range(rounds):
        lead = best[np.argmin(score)]
        vel = 0.7 * vel + 1.4 * rng.random((particles, n)) * (best.astype(float) - pos) + 1.4 * rng.random((particles, n)) * (lead.astype(float) - pos)
        pos = rng.random((particles, n)) < 1 / (1 + np.exp(-(vel - np.log(max(1.0, 2 * n / most)))))
        now = judged(pos)
        better = now < score
        best[better], score[better] = pos[better], now[better]
    return np.flatnonzero(best[np.argmin(score)]) if np.isfinite(score.min()) else np.zeros(0, int)


def swarm_clusters(x: np.ndarray, most: int = 7, particles: int = 20, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Labels from a binary particle swarm over which rows are centres, by silhouette; for matrices of workers."""
    n = len(x)
    d = distances(x, x)

    def cost(c: np.ndarray) -> float:
        lab = np.argmin(d[:, c], axis=1)
        mean = np.column_stack([d[:, lab == k].sum(1) / max(1, (lab == k).sum()) for k in range(lab.max() + 1)])
        own = mean[np.arange(n), lab]
        mean[np.arange(n), lab] = np.inf
        other = mean.min(1)
        return -float(np.mean((other - own) / np.maximum(np.maximum(other, own), 1e-12)))

    c = _swarm(n, lambda round_: [cost(c) for c in round_], most, particles, rounds, seed)
    return np.argmin(d[:, c], axis=1) if len(c) else np.zeros(n, int)


#: Steps of scaled coordinates within which rows are equal, far under the error of a distance between near rows.
EQUAL = 1e-10


def swarm_assigned(df: DataFrame, array_col: str, key: str, candidates: int = 300, most: int = 7, particles: int = 20, rounds: int = 30, seed: int = 0, score: str = "silhouette") -> DataFrame:
    """key, cluster of every row: the nearest of the centres that a binary swarm chooses.

    The swarm's dimensions are `candidates` rows drawn by hash; each choice is judged by all rows: by their silhouette or
    Dunn's index (`dunn`), all rows against all rows, or by the Davies-Bouldin index (`davies_bouldin`), two scans.
    Coordinates are scaled by the mean and deviation of all rows. Rows whose scaled coordinates agree to EQUAL count as equal
    when choices are judged: sums made in another order differ by their last bits.
    """
    rows = saved(df.select(key, F.col(array_col).cast("array<double>").alias("x")), "swarm-rows")
    long = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not long:
        return rows.select(key, F.lit(0).alias("cluster"))
    mean, spread = np.array([r.m for r in long]), np.array([r.s for r in long]) + 1e-9
    some = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(candidates).orderBy(key).select("x").collect()
    seat = (np.array([r.x for r in some]) - mean) / spread
    blocks = None
    if score != "davies_bouldin":  # equal rows are one with their number; neighbours share blocks, so that few clusters meet in one
        nearest = F.pandas_udf(lambda x: pd.Series(np.argmin(distances((np.array(x.tolist(), float).reshape(len(x), -1) - mean) / spread, seat), axis=1)), "int")
        place = F.pandas_udf(lambda x: pd.Series(list(np.rint((np.array(x.tolist(), float).reshape(len(x), -1) - mean) / spread / EQUAL) + 0.0)), "array<double>")
        different = rows.groupBy(place("x").alias("_place")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.min("x").alias("x"))
        blocks = packed(different.withColumn("cell", nearest("x")), "x", ["n", "first"], "cell")

    def cost(choices: list[np.ndarray]) -> list[float]:
        ends = np.cumsum([0, *map(len, choices)])

        def labels(y: np.ndarray) -> np.ndarray:
            """The cluster of each row under each choice, numbered over all choices."""
            near = distances(y, seat)
            return np.column_stack([np.argmin(near[:, c], axis=1) + e for c, e in zip(choices, ends, strict=False)])

        def run(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
            x = (mine.x - mean) / spread
            left = np.column_stack([-2 * x, (x**2).sum(1), np.ones(len(x))])
            total, size = np.zeros((len(x), ends[-1])), np.zeros(ends[-1])
            for b in others:
                y, n = (b.x - mean) / spread, b.columns[0].astype(float)
                sets, at = np.unique(labels(y), axis=0, return_inverse=True)  # rows of the same clusters are summed first
                of, member = np.zeros((len(y), len(sets))), np.zeros((len(sets), ends[-1]))
                of[np.arange(len(y)), at.ravel()] = n
                member[np.arange(len(sets))[:, None], sets] = 1
                size += of.sum(0) @ member
                right, step = np.column_stack([y, np.ones(len(y)), (y**2).sum(1)]).T, max(1, 65_536 // len(y))
                for i in range(0, len(x), step):
                    d = left[i : i + step] @ right
                    np.sqrt(np.maximum(d, 0, out=d), out=d)
                    total[i : i + step] += d @ of @ member
            out, at, mine_of, n = [], np.arange(len(x)), labels(x), mine.columns[0]
            for k, (e, f) in enumerate(zip(ends, ends[1:], strict=False)):
                far, lab = np.where(size[e:f] > 0, total[:, e:f] / np.maximum(size[e:f], 1), np.inf), mine_of[:, k] - e
                own = far[at, lab]
                far[at, lab] = np.inf
                other = far.min(1)
                s = np.where(np.isinf(other), 0.0, (other - own) / np.maximum(np.maximum(np.where(np.isinf(other), 0.0, other), own), 1e-12))
                out.append((k, float((s * n).sum()), int(n.sum())))
            return pd.DataFrame(out, columns=["k", "s", "n"])

        got = {r.k: r.c for r in against_all(blocks, run, "k int, s double, n long").groupBy("k").agg((-F.sum("s") / F.sum("n")).alias("c")).collect()}
        return [got[k] for k in range(len(choices))]

    def pairs(choices: list[np.ndarray]) -> list[float]:
        """Minus Dunn's index of each choice: nearest rows of different clusters over the farthest of one."""

        def run(mine: Block, others: Iterator[Block]) -> pd.DataFrame:
            x = (mine.x - mean) / spread
            near, gap, wide = distances(x, seat), np.full(len(choices), np.inf), np.zeros(len(choices))
            for b in others:
                y = (b.x - mean) / spread
                d, far = distances(x, y), distances(y, seat)
                for k, c in enumerate(choices):
                    same = np.argmin(near[:, c], axis=1)[:, None] == np.argmin(far[:, c], axis=1)[None]
                    gap[k] = min(gap[k], d[~same].min(initial=np.inf))
                    wide[k] = max(wide[k], d[same].max(initial=0.0))
            return pd.DataFrame({"k": range(len(choices)), "gap": gap, "wide": wide})

        got = {r.k: (r.gap, r.wide) for r in against_all(blocks, run, "k int, gap double, wide double").groupBy("k").agg(F.min("gap").alias("gap"), F.max("wide").alias("wide")).collect()}
        return [-got[k][0] / max(got[k][1], 1e-12) if np.isfinite(got[k][0]) else np.inf for k in range(len(choices))]

    def centres(choices: list[np.ndarray]) -> list[float]:
        """Davies-Bouldin index of each choice: two scans, of sums and of distances per cluster."""

        def scan(of: list[np.ndarray] | None) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
                for batch in batches:
                    y = (np.array(batch["x"].tolist(), float).reshape(len(batch), -1) - mean) / spread
                    near = distances(y, seat)
                    for k, c in enumerate(choices):
                        lab = np.argmin(near[:, c], axis=1)
                        for j in np.unique(lab).tolist():
                            z = y[lab == j]
                            t = z.sum(0) if of is None else np.sqrt(((z - of[k][j]) ** 2).sum(1)).sum(keepdims=True)
                            s, n = total.get((k, j), (0.0, 0))
                            total[k, j] = s + t, n + len(z)
                yield pd.DataFrame([(k, j, s.tolist(), n) for (k, j), (s, n) in total.items()], columns=["k", "j", "s", "n"])

            parts = rows.mapInPandas(run, "k int, j int, s array<double>, n long").select("k", "j", "n", F.posexplode("s").alias("i", "s")).groupBy("k", "j", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
            out: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
            for r in sorted(parts, key=lambda r: r.i):
                s, _ = out.get((r.k, r.j), (np.zeros(0), 0))
                out[r.k, r.j] = np.append(s, r.s), r.n
            return out

        sums = scan(None)
        middle = [np.array([sums[k, j][0] / sums[k, j][1] if (k, j) in sums else np.full(len(mean), np.nan) for j in range(len(c))]) for k, c in enumerate(choices)]
        wide, out = scan(middle), []
        for k, c in enumerate(choices):
            full = [j for j in range(len(c)) if (k, j) in wide]
            s, m = np.array([wide[k, j][0][0] / wide[k, j][1] for j in full]), middle[k][full]
            gap = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)) + np.where(np.eye(len(full)), np.inf, 0)
            out.append(float(np.max((s[:, None] + s[None]) / np.maximum(gap, 1e-12), axis=1).mean()) if len(full) > 1 else np.inf)
        return out

    judge = {"silhouette": cost, "dunn": pairs, "davies_bouldin": centres}[score]
    c = _swarm(len(seat), judge, most, particles, rounds, seed)

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        y = (np.array(x.tolist(), float).reshape(len(x), -1) - mean) / spread
        return pd.Series(np.argmin(distances(y, seat[c]), axis=1) if len(c) else np.zeros(len(x), int))

    return rows.select(key, nearest("x").alias("cluster"))


def drift_flags(daily: DataFrame, worker: str, day: str, error: str, spread: float = 3.0, days: int = 3) -> DataFrame:
    """worker, day, over_threshold, drift: `days` days in a row above the worker's mean + spread x standard deviation."""
    cut = daily.groupBy(worker).agg((F.avg(error) + spread * F.stddev_samp(error)).alias("_cut"))
    w = Window.partitionBy(worker).orderBy(day).rowsBetween(1 - days, 0)
    rows = daily.join(cut, worker).withColumn("over_threshold", F.coalesce(F.col(error) > F.col("_cut"), F.lit(False)))
    drift = (F.count(F.lit(1)).over(w) >= days) & (F.min(F.col("over_threshold").cast("int")).over(w) == 1)
    return rows.select(worker, day, "over_threshold", drift.alias("drift"))


def drift_days(flags: DataFrame, clusters: DataFrame, worker: str, day: str, cluster: str = "cluster", support: float = 0.033, share: float = 0.16) -> DataFrame:
    """day, n_new, n_waiting, retrain: how many workers move to the global model on a day, and whether a retraining is due.

    `flags` are those of drift_flags since the last training; `clusters` has a row per worker. A worker moves on its first
    day of drift, or once its cluster's model serves `support` of all workers or fewer. Retraining is due while at least
    `share` of all workers wait for it: the first such day ends the period, and flags and clusters start anew. Days without
    moves are left out; workers without flags stay, flags of others don't count.
    """
    gone = flags.groupBy(worker).agg(F.min(F.when(F.col("drift"), F.col(day))).alias("_gone"))
    bound = clusters.agg(F.count(F.lit(1)).alias("_all")).crossJoin(F.broadcast(flags.agg(F.min(day).alias("_start"))))  # one row each
    moves = clusters.select(worker, F.col(cluster).alias("_c")).join(gone, worker, "left").groupBy("_c", "_gone").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_c")
    so_far = F.coalesce(F.sum(F.when(F.col("_gone").isNotNull(), F.col("n"))).over(w.orderBy("_gone")), F.lit(0))
    left = (F.sum("n").over(w) - so_far) / F.col("_all") <= support
    few = F.sum("n").over(w) / F.col("_all") <= support
    closed = moves.crossJoin(F.broadcast(bound)).withColumn("_closed", F.when(few, F.col("_start")).when(left, F.col("_gone")))
    closed = closed.withColumn("_closed", F.min("_closed").over(w))
    per = closed.groupBy(F.least("_gone", "_closed").alias(day), "_all").agg(F.sum("n").alias("n_new")).where(F.col(day).isNotNull())
    run = F.sum("n_new").over(Window.orderBy(day))  # a row per day
    return per.withColumn("n_waiting", run).select(day, "n_new", "n_waiting", (F.col("n_waiting") / F.col("_all") >= share).alias("retrain"))


#: Training folds of each strategy, from first to last, counted from the fold that is predicted; None is the very first.
STRATEGIES = {"last": (-1, -1), "1_month": (-1, -1), "6_months": (-6, -1), "1_year": (-12, -1), "1_month_year_before": (-12, -12), "all_before": (None, -1)}


def walk_forward(df: DataFrame, keys: list[str], time_col: str, features: list[str], target: str, fold: str, model: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, strategy: str = "all_before", split: object = None) -> DataFrame:
    """keys, fold, mae, n: each fold (say, a month) predicted from those that the strategy trains on.

    "train_test_split" trains once on the folds up to `split` and predicts each later one. A fold is predicted where the
    whole window of its strategy is there. Every fold of every key is a group of its own, so no task holds a series.
    """
    fit = model or forest_model
    rows = df.select(*keys, time_col, *dict.fromkeys([*features, target, fold])).na.drop(subset=[*features, target])
    folds = rows.select(*keys, fold).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(fold)))
    trained, tested = (folds.select(*keys, F.col(fold).alias(name), F.col("_i").alias(i)) for name, i in (("_from", "_j"), ("_test", "_i")))
    both = tested.join(trained, keys) if keys else tested.join(F.broadcast(trained))
    if strategy == "train_test_split":
        pairs = both.where((F.col("_from") <= F.lit(split)) & (F.col("_test") > F.lit(split)))
    else:
        first, last = STRATEGIES[strategy]
        pairs = both.where((F.col("_j") <= F.col("_i") + last) & (F.lit(True) if first is None else (F.col("_j") >= F.col("_i") + first) & (F.col("_i") + first >= 1)))
    pairs = pairs.select(*keys, "_from", "_test")
    train = rows.withColumnRenamed(fold, "_from").join(pairs, [*keys, "_from"])
    test = rows.withColumnRenamed(fold, "_test").join(pairs.select(*keys, "_test").distinct(), [*keys, "_test"])

    def run(key: tuple, seen: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(seen) or not len(asked):
            return pd.DataFrame([], columns=[*keys, fold, "mae", "n"])
        seen, asked = seen.sort_values(time_col, kind="stable"), asked.sort_values(time_col, kind="stable")
        p = fit(seen[features].to_numpy(float), seen[target].to_numpy(float), asked[features].to_numpy(float))
        return pd.DataFrame([[*key, float(np.abs(p - asked[target].to_numpy(float)).mean()), len(asked)]], columns=[*keys, fold, "mae", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    train, test = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (train, test))  # columns of their own
    grouped = train.groupBy(*keys, "_test").cogroup(test.groupBy(*keys, "_test"))
    return grouped.applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, fold]) + ", mae double, n long")


def mean_model(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.full(len(z), y.mean())


def forest_model(x: np.ndarray, y: np.ndarray, z: np.ndarray, trees: int = 10, depth: int = 6) -> np.ndarray:
    out = np.zeros(len(z))
    for k in range(trees):
        rng = np.random.default_rng(k)
        pick = rng.integers(0, len(y), len(y))
        out += grown(tree(x[pick], y[pick], depth, 3, rng), z) / trees
    return out


def persistence_model(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The first feature, as in 'the same as yesterday'."""
    return z[:, 0]
