"""Hard negatives from an inverted multi-index: exact searches by inner product within windows of scores.

1. Vectors are scaled and floored to integers, so that scores are exact. Each half of a vector has a codebook of CODES
   centres, fitted on SAMPLE rows; every row falls in the cell of its nearest centre of either half. Codebooks, radii
   (the farthest row of a centre) and cells are CODES or CODES**2 rows.
2. For an anchor, a row's score is at most the sum of two half scores: the centre's, and the radius times the anchor's
   length, or the longest half vector's. A heap over the two lists of half scores gives the cells in falling order of
   that sum (multi-sequence), STEPS cells a round.
3. A round joins the anchors' cells with the blocks that hold the cells' rows (a large cell is several, a block at
   most about BLOCK rows); a task holds one block and the anchors stream past it. For each of an anchor's targets, a
   range of scores within or outside its label, the best few rows of a block go on and are merged by anchor.
4. A target is certified, and leaves the rounds, when its last wanted row scores more than the next cell's bound or
   the bound is under its range. All others see every cell in the last round, so results are exact.

Positives are a search without limits within the label; each gives a range for its negatives, a search outside it.
Vectors without structure have loose bounds and visit all cells: the price of exactness for any index.

Cases: rows without an id, with a null label or vector, or with a component that is null or not finite take no part;
shorter vectors count as ending in zeros, an empty one as zeros; rows that repeat an id are rows of their own, and an
anchor is no partner of itself; ties go to the smaller id; scores need 55 bits at most, else ValueError; fewer
partners give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, partitions, saved
from tidewheel.llm.vectors import finite, matrix, stretches, width

#: Centres of a half, rows that fit them, passes of the fit.
CODES, SAMPLE, PASSES = 16, 8192, 8
#: Cells of the rounds; the last one takes all that are left.
STEPS = (16, 48, CODES * CODES)
BLOCK = 2048
#: Anchors that share a copy of a block.
ANCHORS = 65_536
SCORES = 2 << 20
FLOAT_EXACT, KEY_EXACT, LARGEST, MOST = 1 << 53, 1 << 50, 1 << 55, 1 << 62
TARGETS = "array<struct<t:int,lo:bigint,hi:bigint>>"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def codebook(x: np.ndarray, codes: int = CODES, passes: int = PASSES) -> np.ndarray:
    """Centres of the rows of x: spread starts (each the farthest row from those taken), then Lloyd's passes."""
    rows = np.unique(x, axis=0)
    centres = [rows[len(rows) // 2]]
    away = ((rows - centres[0]) ** 2).sum(1)
    while len(centres) < min(codes, len(rows)):
        centres.append(rows[int(away.argmax())])
        away = np.minimum(away, ((rows - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(passes):
        own = _nearest(x, c)[0]
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, np.array([np.bincount(own, x[:, k], len(c)) for k in range(x.shape[1])]).T / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(1))


@dataclass
class Cells:
    """Centres, radii and longest half vectors of both halves, and the numbers (a * CODES + b) of the cells in use."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    longest: tuple[np.ndarray, np.ndarray]
    used: frozenset[int]

    def halves(self, v: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores with each anchor, per half a row per anchor."""
        cut, out = self.centres[0].shape[1], []
        for half, c, r, most in zip((v[:, :cut], v[:, cut:]), self.centres, self.radii, self.longest, strict=True):
            length = np.sqrt((half**2).sum(1))[:, None]
            out.append(np.minimum(half @ c.T + length * r, length * most))
        return out

    def falling(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """Bound and number of the cells in use, the highest bound first."""
        a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
        x, y = first[a].tolist(), second[b].tolist()
        heap = [(-(x[0] + y[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (cell := a[i] * CODES + b[j]) in self.used:
                yield -bound + 1e-6 * (1 + abs(bound)), cell
            if j + 1 < len(y):
                heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
            if not j and i + 1 < len(x):  # each cell is reached from the one before it in its row, a row from the row before
                heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def indexed(rows: DataFrame, dim: int, magnitude: int) -> tuple[DataFrame, Cells]:
    """The rows with their cell and block, and the cells."""
    cut = dim // 2
    some = rows.select("vec_id", "row", "v").orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("v").toArrow()
    x = matrix(some.column("v"), dim)
    centres = codebook(x[:, :cut]), codebook(x[:, cut:])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(3), dim)
            (a, ra), (b, rb) = _nearest(v[:, :cut], centres[0]), _nearest(v[:, cut:], centres[1])
            length = [np.sqrt((h**2).sum(1)) for h in (v[:, :cut], v[:, cut:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((a * CODES + b).astype(np.int32)), *map(pa.array, (ra, rb, *length))], ["row", "vec_id", "label", "v", "cell", "r0", "r1", "n0", "n1"])

    kind = rows.schema["v"].dataType.simpleString()
    dealt = saved(rows.select("row", "vec_id", "label", "v").mapInArrow(assign, f"row long, vec_id long, label long, v {kind}, cell int, r0 double, r1 double, n0 double, n1 double"), "multi-rows")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in ("r0", "r1", "n0", "n1")))
    found = cells.collect()  # CODES ** 2 rows at most
    radii, longest = ([np.zeros(len(c)) for c in centres] for _ in range(2))
    for r in found:
        for half, code in enumerate(divmod(r.cell, CODES)):
            radii[half][code] = max(radii[half][code], r[f"r{half}"])
            longest[half][code] = max(longest[half][code], r[f"n{half}"])
    blocks = rows.sparkSession.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in found], "cell int, blocks int")
    table = dealt.select("row", "vec_id", "label", "v", "cell").join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    table._scratch_path = dealt._scratch_path  # noqa: SLF001
    return table, Cells(centres, tuple(radii), tuple(longest), frozenset(r.cell for r in found))


def planned(state: DataFrame, cells: Cells, dim: int, seen: int, take: int) -> DataFrame:
    """The anchors with the `take` cells to visit after the first `seen`, and the bound of the one after them (null: none)."""
    kind = state.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, bounds = [], []
            for first, second in zip(*cells.halves(matrix(batch.column(2), dim)), strict=True):
                here, bound = [], None
                for n, (b, cell) in enumerate(cells.falling(first, second)):
                    if n >= seen + take:
                        bound = b
                        break
                    if n >= seen:
                        here.append(cell)
                lists.append(here)
                bounds.append(bound)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(bounds, pa.float64())], ["anchor", "own", "v", "targets", "cells", "bound"])

    return state.select("anchor", "own", "v", "targets").mapInArrow(run, f"anchor long, own long, v {kind}, targets {TARGETS}, cells array<int>, bound double")


def _taken(score: np.ndarray, ok: np.ndarray, k: int, key_exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores among those that are ok in each row; columns ascend by id, ties to the first."""
    n = score.shape[1]
    if key_exact:
        key = np.where(ok, score * n + np.arange(n - 1, -1, -1), -MOST)
        by = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), score.shape)
    else:
        by = np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score, ~ok), axis=1)[:, :k]
    row = np.repeat(np.arange(len(score)), by.shape[1])
    column = by.ravel()
    real = ok[row, column]
    return row[real], column[real]


def scanned(asked: DataFrame, table: DataFrame, dim: int, k: int, same: bool, magnitude: int, copies: int) -> DataFrame:
    """anchor, t, vec_id, score: the best k rows of each visited block for each target."""
    kind = table.schema["v"].dataType.simpleString()
    spark = table.sparkSession
    blocks = table.select("cell", "blocks").distinct()  # CODES ** 2 rows at most
    asking = asked.select("anchor", "own", "v", "targets", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell")
    asking = asking.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "copy": F.pmod(F.xxhash64("anchor"), F.lit(copies)).cast("int")})
    asking = asking.select("cell", "block", "copy", F.lit(True).alias("asks"), F.col("anchor").alias("row"), F.lit(None).cast("long").alias("vec_id"), F.col("own").alias("label"), "v", "targets")
    held = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("cell", "block", "copy", F.lit(False).alias("asks"), "row", "vec_id", "label", "v", F.lit(None).cast(TARGETS).alias("targets"))
    by = ["cell", "block", "copy"]
    dealt = asking.unionByName(held).repartition(partitions(spark), *by).sortWithinPartitions(*by, "asks", "vec_id").select(*by, "asks", "row", "vec_id", "label", "v", "targets")
    exact = np.float64 if magnitude < FLOAT_EXACT else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for batch in batches:
            cell, block, copy, asks, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            label, v = batch.column(6).to_numpy(), matrix(batch.column(7), dim).astype(exact)
            for i, j in stretches(cell, block, copy, asks):
                if here != (cell[i], block[i], copy[i]):
                    here, rows = (cell[i], block[i], copy[i]), []
                if not asks[i]:
                    rows.append((row[i:j], batch.column(5).slice(i, j - i).to_numpy(), label[i:j], v[i:j]))
                elif rows:
                    rows = [tuple(np.concatenate(part) for part in zip(*rows, strict=True))]
                    who, ids, labels, x = rows[0]
                    targets = batch.column(8).slice(i, j - i)
                    flat, sizes = targets.flatten(), np.asarray(targets.value_lengths())
                    t, lo, hi = (flat.field(c).to_numpy() for c in range(3))
                    own = np.repeat(np.arange(i, j), sizes)
                    step = max(1, SCORES // len(x))
                    for a in range(0, len(own), step):
                        u = own[a : a + step]
                        first, which = np.unique(u, return_inverse=True)
                        score = (v[first] @ x.T).astype(np.int64)[which]
                        ok = (score >= lo[a : a + step, None]) & (score <= hi[a : a + step, None]) & (row[u][:, None] != who)
                        ok &= (label[u][:, None] == labels) if same else (label[u][:, None] != labels)
                        r, c = _taken(score, ok, k, magnitude < KEY_EXACT)
                        yield pa.RecordBatch.from_arrays([pa.array(row[u][r]), pa.array(t[a : a + step][r], pa.int32()), pa.array(ids[c]), pa.array(score[r, c])], ["anchor", "t", "vec_id", "score"])

    return dealt.select(*by, "asks", "row", "vec_id", "label", F.col("v").cast(kind), "targets").mapInArrow(run, "anchor long, t int, vec_id long, score long")


def visit(anchors: DataFrame, table: DataFrame, cells: Cells, dim: int, k: int, same: bool, magnitude: int) -> DataFrame:
    """anchor, t, n, vec_id, score: the first k rows of each target of the anchors (anchor, own, v, targets)."""
    copies = -(-max(1, anchors.count()) // ANCHORS)
    by = Window.partitionBy("anchor", "t").orderBy(F.desc("score"), "vec_id")
    state, seen, found, old = anchors, 0, None, []
    for take in STEPS:
        asked = saved(planned(state, cells, dim, seen, take), "multi-asked")
        new = scanned(asked, table, dim, k, same, magnitude, copies)
        new = new if found is None else new.unionByName(found.drop("n"))
        last, found = found, saved(new.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k), "multi-found")
        kth = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.when(F.col("n") == k, F.struct("t", "score")))).alias("kth"))
        lost = lambda s: (F.coalesce(F.try_element_at("kth", s["t"]), F.lit(-MOST)) <= F.col("bound")) & (s["lo"] <= F.col("bound"))
        state = asked.where("bound is not null").join(kth, "anchor", "left").select("anchor", "own", "v", F.filter("targets", lost).alias("targets")).where(F.size("targets") > 0)
        state = saved(state, "multi-open")
        seen += take
        discard(asked, *([last] if last is not None else []), *old)
        old = [state]
        if not state.head(1):
            break
    discard(*old)
    return found


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are an anchor's best other rows of its label; negatives of a positive the best rows of other labels that
    score low % to high % of the positive's score. Components count as floor(scale * x).
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    rows = df.withColumn("_a", F.coalesce(is_anchor, F.lit(False))).where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector), empty=True))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.col("_a").alias("anchor")), "multi-input")
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if largest is None or not rows.where("anchor").head(1):
        discard(rows)
        return spark.createDataFrame([], RESULT)
    dim = max(2, width(rows, "v"))
    if (magnitude := int(largest) ** 2 * dim) >= LARGEST:
        raise ValueError(f"scores of up to {magnitude} don't fit: scale the vectors down")
    table, cells = indexed(rows, dim, magnitude)
    anchors = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("label").alias("own"), "v")
    everything = F.array(F.struct(F.lit(0).alias("t"), F.lit(-MOST).alias("lo"), F.lit(MOST).alias("hi"))).cast(TARGETS)
    near = visit(anchors.withColumn("targets", everything), table, cells, dim, positives, True, magnitude)
    near = near.select("anchor", F.col("n").cast("int").alias("t"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    part = lambda share: F.expr(f"(positive_score * {share} - pmod(positive_score * {share}, 100)) div 100")  # noqa: E731  floor of a hundredth
    ranges = near.withColumns({"lo": -part(-low), "hi": part(high)}).where("lo <= hi")
    targets = ranges.groupBy("anchor").agg(F.collect_list(F.struct("t", "lo", "hi")).cast(TARGETS).alias("targets"))
    far = visit(anchors.join(targets, "anchor"), table, cells, dim, negatives, False, magnitude)
    names = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = far.select("anchor", "t", F.col("n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor", "t"]).join(names, "anchor")
    out = saved(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "multi-negatives")
    discard(rows, table, near, far)
    return out
