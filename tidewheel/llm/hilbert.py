"""Approximate nearest neighbours by largest inner product, from windows on several shifted Hilbert curves.

1. Equal vectors are one entry with their k + 1 smallest ids, so that masses of copies cost one row and ties among
   them are exact. Entries get one more component, which brings all to one length: the largest inner product with a
   query is then the smallest distance from the query scaled to that length.
2. Each of CURVES curves projects entries and queries on DIMS random directions of its own, shifts the cells of its
   grid and gives the places on the Hilbert curve. Spark range-partitions them by curve, place and id (the id splits
   equal places), so that every row has a position on its curve.
3. A query looks at the entries less than `window` positions away on each curve. The window is measured: for SAMPLE
   queries the true neighbours are found by comparing with all entries, and the window is the smallest that holds
   TARGET of them on some curve. Vectors of few real dimensions need narrow windows; without structure they have to be
   wide, for any index.
4. Curves are cut in blocks of positions; a query meets the blocks of its windows, at most ten a curve whatever the
   window, and the entries of a block stream past its queries. Per query and block the best k + 1 entries go on; they
   are merged by query, with scores summed in double precision on the original vectors.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id; shorter vectors count as ending in zeros; rows that repeat an id and its vector count once, a query whose id has
several vectors takes the smallest; no row of a query's own id is among its neighbours; ties go to the smaller id;
fewer than k candidates give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, partitions, saved
from tidewheel.llm.vectors import finite, in_order, matrix, stretches, width

CURVES, DIMS, BITS = 8, 8, 7
#: Queries that measure the window, and the share of their neighbours that it has to hold.
SAMPLE, TARGET = 256, 0.95
#: Positions of the narrowest window, and the fewest of a block.
LEAST = 1024
SCORES = 4 << 20
RESULT = "query_id long, rank int, vec_id long, score double"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates under 2**bits, by turning and reflecting the halves
    of the cube from the coarsest to the finest level; dimensions x bits <= 63."""
    x = cells.astype(np.int64)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            upper = (x[:, d] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            if d:
                x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[:, d] >> level) & 1
    return place


class Curves:
    """Directions, shifts and grids of the curves; the same for every task and run."""

    def __init__(self, dim: int, length: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS):
        self.dim, self.length, self.bits = dim, length, bits
        rng = np.random.default_rng(20_011)
        self.axes = [np.linalg.qr(rng.normal(size=(dim + 1, min(dims, dim + 1))))[0] for _ in range(curves)]
        self.shift = [rng.random(a.shape[1]) / 2 for a in self.axes]

    def lifted(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Entries with the component that they lack to the common length, queries scaled to it."""
        norm2 = (x**2).sum(1)
        scale = np.where(query, self.length / np.sqrt(norm2), 1)
        rest = np.where(query, 0, np.sqrt(np.maximum(0, self.length**2 - norm2)))
        return np.column_stack([x * scale[:, None], rest])

    def projected(self, x: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
        y = self.lifted(x, query)
        return [y @ a for a in self.axes]

    def places(self, x: np.ndarray, query: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for y, s, a, b in zip(self.projected(x, query), self.shift, low, high, strict=True):
            unit = (y - a) / np.where(b > a, b - a, 1)
            out.append(hilbert_index(np.clip((unit + s) / 1.5 * (1 << self.bits), 0, (1 << self.bits) - 1), self.bits))
        return out


def entries(rows: DataFrame, k: int) -> DataFrame:
    """id, ids (the k + 1 smallest, in order) and v, a row per different vector; each task sends on no more than k + 1 ids
    of a vector. The entries' own ids ascend with their smallest ids, so that ties fall alike."""
    first = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    ids = first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return ids.orderBy(F.col("ids")[0], "v").select(F.monotonically_increasing_id().alias("id"), "ids", "v")


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Per row, the columns of the highest scores, `most` at most, and ties to the smaller id among those taken."""
    if scores.shape[1] > most:
        take = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    else:
        take = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    s, i = np.take_along_axis(scores, take, 1), np.take_along_axis(np.broadcast_to(ids, scores.shape), take, 1)
    return np.take_along_axis(take, np.lexsort((i, -s), axis=1), 1)


class Top:
    """The best `most` entries of some queries over entries that come in parts."""

    def __init__(self, queries: np.ndarray, most: int):
        self.q, self.most = queries, most
        self.score, self.id = np.full((len(queries), 0), -np.inf), np.zeros((len(queries), 0), np.int64)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        step, parts = max(1, SCORES // max(1, len(x))), []
        for a in range(0, len(self.q), step):
            q = self.q[a : a + step]
            take = _best(q @ x.T, ids, self.most)
            parts.append((in_order(q[:, None, :], x[take]), ids[take]))
        score = np.hstack([self.score, np.vstack([p[0] for p in parts])])
        each = np.hstack([self.id, np.vstack([p[1] for p in parts])])
        by = np.lexsort((each, -score), axis=1)[:, : self.most]
        self.score, self.id = np.take_along_axis(score, by, 1), np.take_along_axis(each, by, 1)


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(values.ravel(), kind))


def _bounds(rows: DataFrame, curves: Curves) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Least and greatest projection of the entries on every direction, a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            x = matrix(batch.column(0), curves.dim)
            if len(x):
                y = np.hstack(curves.projected(x, np.zeros(len(x), bool)))
                low = y.min(0) if low is None else np.minimum(low, y.min(0))
                high = y.max(0) if high is None else np.maximum(high, y.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = rows.select("v").mapInArrow(run, "d int, low double, high double").groupBy("d").agg(F.min("low"), F.max("high")).collect()
    both = np.array([r[1:] for r in sorted(found, key=lambda r: r[0])])
    cut = np.cumsum([a.shape[1] for a in curves.axes])[:-1]
    return np.split(both[:, 0], cut), np.split(both[:, 1], cut)


def placed(rows: DataFrame, curves: Curves, low: list[np.ndarray], high: list[np.ndarray]) -> DataFrame:
    """curve, pos (0, 1, ... along the curve), query, id, v of every row on every curve."""
    kind = rows.schema["v"].dataType.simpleString()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = batch.column(0).to_numpy(zero_copy_only=False)
            for c, place in enumerate(curves.places(matrix(batch.column(2), curves.dim), query, low, high)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), c), pa.int32()), pa.array(place), *batch.columns], ["curve", "place", "query", "id", "v"])

    spark = rows.sparkSession
    by = ["curve", "place", "id"]
    keyed = rows.select("query", "id", "v").mapInArrow(key, f"curve int, place long, query boolean, id long, v {kind}")
    table = saved(keyed.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "hilbert-placed")
    part = F.shiftright("_m", 33).cast("int").alias("_part")
    counts = table.groupBy(part, "curve").count().orderBy("_part", "curve").collect()  # a row per task and one more per curve
    seen, offsets, inside = {}, [], {}
    for p, c, n in counts:
        offsets.append((p, c, seen.get(c, 0) - inside.get(p, 0)))
        seen[c], inside[p] = seen.get(c, 0) + n, inside.get(p, 0) + n
    shift = spark.createDataFrame(offsets, "_part int, curve int, _off long")
    pos = (F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_off")).alias("pos")
    out = table.withColumn("_part", part).join(F.broadcast(shift), ["_part", "curve"]).select("curve", pos, "query", "id", "v")
    out._scratch_path = table._scratch_path  # noqa: SLF001
    return out


def _exact(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """q and id of the k nearest entries of each of a few queries, the one that is the query's own row left out."""
    ids, q = np.array([r.id for r in queries]), np.zeros((len(queries), dim))
    for row, r in zip(q, queries, strict=True):
        row[: len(r.v)] = r.v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Top(q, k + 1)
        for batch in batches:
            if batch.num_rows:
                top.add(matrix(batch.column(1), dim), batch.column(0).to_numpy())
        n, m = top.id.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(top.id.ravel()), pa.array(top.score.ravel())], ["q", "id", "score"])

    found = rows.select("id", "v").mapInArrow(run, "q long, id long, score double").join(rows.where(F.size("ids") == 1).select("id", F.col("ids")[0].alias("_lone")), "id", "left")
    found = found.where("_lone is null or _lone <> q")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k).select("q", "id")


def measured_window(at: DataFrame, rows: DataFrame, queries: DataFrame, dim: int, k: int, target: float = TARGET, sample: int = SAMPLE) -> int:
    """The smallest window that holds `target` of the true neighbours of `sample` queries on one curve or another."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    pairs = _exact(rows, some, dim, k)
    near = F.broadcast(pairs)  # sample x k rows at most
    theirs = at.where("not query").select("curve", "pos", "id").join(near, "id")
    own = at.where("query").select("curve", F.col("pos").alias("own"), F.col("id").alias("q")).join(F.broadcast(pairs.select("q").distinct()), "q")
    away = theirs.join(own, ["curve", "q"]).groupBy("q", "id").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("away"))
    steps = sorted(r.away for r in away.select("away").collect())
    return steps[math.ceil(target * len(steps)) - 1] + 1 if steps else 0


def search(at: DataFrame, dim: int, window: int, most: int) -> DataFrame:
    """query_id, ids, scores: the best `most` entries of each block that a query's window touches."""
    size = max(LEAST, -(-window // 4))
    block = F.floor(F.col("pos") / size).cast("long")
    low, high = F.floor(F.greatest(F.col("pos") - window, F.lit(0)) / size).cast("long"), F.floor((F.col("pos") + window) / size).cast("long")
    asking = at.where("query").withColumn("block", F.explode(F.sequence(low, high)))
    dealt = asking.unionByName(at.where("not query").withColumn("block", block)).select("curve", "block", "query", "id", "v", "pos")
    dealt = dealt.repartition(partitions(at.sparkSession), "curve", "block").sortWithinPartitions("curve", "block", F.desc("query"), "pos").drop("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, top = None, [], [], None

        def result() -> Iterator[pa.RecordBatch]:
            if top is not None and top.id.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), _listed(top.id, pa.int64()), _listed(top.score, pa.float64())], ["query_id", "ids", "scores"])

        for batch in batches:
            curve, block, query, each = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = matrix(batch.column(4), dim)
            for i, j in stretches(curve, block, query):
                if here != (curve[i], block[i]):
                    yield from result()
                    here, ids, vectors, top = (curve[i], block[i]), [], [], None
                if query[i]:
                    ids.append(each[i:j])
                    vectors.append(x[i:j])
                elif ids:
                    top = top or Top(np.vstack(vectors), most)
                    top.add(x[i:j], each[i:j])
        yield from result()

    return dealt.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")


def merged(found: DataFrame, most: int) -> DataFrame:
    """query_id, ids, scores: the best `most` different entries of each query; its lists stay lists on the way."""
    dealt = found.repartition(partitions(found.sparkSession), "query_id").sortWithinPartitions("query_id")

    def best(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        scores = np.concatenate([p[1] for p in parts])[first]
        by = np.lexsort((ids, -scores))[:most]
        return ids[by], scores[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def rows(done: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            at = pa.array(np.cumsum([0, *(len(d[1]) for d in done)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([d[c] for d in done]))) for c in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), *lists], ["query_id", "ids", "scores"])

        for batch in batches:
            query, done = batch.column(0).to_numpy(), []
            ids, scores = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            cut = np.append(0, np.cumsum(np.asarray(batch.column(1).value_lengths())))
            for i, j in stretches(query):
                if query[i] != here and parts:
                    done.append((here, *best(parts)))
                    parts = []
                here = query[i]
                parts.append((ids[cut[i] : cut[j]], scores[cut[i] : cut[j]]))
                if len(parts) > 8:  # a query over many batches holds no more than its best
                    parts = [best(parts)]
            if done:
                yield rows(done)
        if parts:
            yield rows([(here, *best(parts))])

    return dealt.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is a query, the nearest first."""
    spark = df.sparkSession
    valid = df.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), "_q")
    valid = valid.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda c: c != 0))
    rows = saved(entries(valid.drop("_q"), k), "hilbert-entries")
    queries = saved(valid.where("_q").groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v")), "hilbert-queries")
    dim = width(rows, "v")
    if not dim or not queries.head(1):
        discard(rows, queries)
        return spark.createDataFrame([], RESULT)
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).first()[0]
    curves = Curves(dim, math.sqrt(norm2))
    both = rows.select(F.lit(False).alias("query"), "id", "v").unionByName(queries.select(F.lit(True).alias("query"), "id", "v"))
    at = placed(both, curves, *_bounds(rows, curves))
    window = max(LEAST, measured_window(at, rows, queries, dim, k, target))
    found = merged(search(at, dim, window, k + 1), k + 1).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query_id", F.col("e.ids").alias("id"), F.col("e.scores").alias("score"))
    each = found.join(rows.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    out = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    out = saved(out.select("query_id", "rank", "vec_id", "score"), "hilbert-nearest")
    discard(at, rows, queries)
    return out
