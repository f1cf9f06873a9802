"""Bins of one or more variables, and the statistics of their cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import quantiles
from tidewheel.operators.blocks import saved


@dataclass(frozen=True)
class Bins:
    """Edges of a variable; intervals are closed on the right, the first one on both sides."""

    variable: str
    edges: tuple[float, ...]

    @classmethod
    def equal(cls, df: DataFrame, variable: str, edges: int = 20) -> Bins:
        """`edges` equally spaced edges from minimum to maximum: one interval less."""
        lo, hi = df.agg(F.min(variable), F.max(variable)).first()
        return cls(variable, tuple(np.linspace(lo, hi, edges).tolist()))

    @property
    def mids(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def rounded_mids(self, digits: int = 3) -> list[float]:
        """Middles of edges rounded to as many decimals as keep them apart, the first lowered by one unit of it."""
        while digits < 16 and len({round(e, digits) for e in self.edges}) < len(self.edges):
            digits += 1
        e = [round(x, digits) for x in self.edges]
        e[0] = round(self.edges[0] - 10**-digits, digits)
        return [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)]

    def number(self, x: Column | None = None) -> Column:
        """0-based interval of a value; null outside the edges."""
        x = F.col(self.variable) if x is None else x
        edges = F.array(*(F.lit(float(e)) for e in self.edges))
        above = F.size(F.filter(edges, lambda e: e < x))
        return F.when((x >= self.edges[0]) & (x <= self.edges[-1]), F.greatest(above - 1, F.lit(0)))

    def label(self, x: Column | None = None, style: str = "exact") -> Column:
        mids = self.mids if style == "exact" else self.rounded_mids()
        return F.get(F.array(*map(F.lit, mids)), self.number(x))


def histogram_2d(df: DataFrame, a: Bins, b: Bins) -> DataFrame:
    """Rows per cell, empty ones included, with a dense 0-based id; cells are as many as the bins make."""
    counts = df.select(a.number().alias("i"), b.number().alias("j")).where("i is not null and j is not null").groupBy("i", "j").count()
    spark = df.sparkSession
    cells = spark.createDataFrame([(i, j, x, y, i * len(b.mids) + j) for i, x in enumerate(a.mids) for j, y in enumerate(b.mids)], f"i int, j int, {a.variable} double, {b.variable} double, cell_id int")
    return cells.join(counts, ["i", "j"], "left").select(a.variable, b.variable, "cell_id", F.coalesce("count", F.lit(0)).alias("n"))


def cells(df: DataFrame, bins: list[Bins], targets: list[str], low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Per occupied cell: its bin labels and, for every target, median, mean, sum, count, min, max and two percentiles.

    One shuffle for all targets where the table is small; else sums are taken on the map side and percentiles per target,
    a hot cell's over many tasks.
    """
    keys = [f"{b.variable}_bin" for b in bins]
    rows = df.withColumns({k: b.label() for k, b in zip(keys, bins, strict=True)}).na.drop(subset=keys)
    wanted, small = [0.5, low, high], rows.limit(quantiles.LEAF + 1).count() <= quantiles.LEAF
    aggs = []
    for t in targets:
        c = F.col(t)
        aggs += [F.percentile(c, F.array(*map(F.lit, wanted))).alias(f"_q_{t}")] if small else []
        aggs += [F.avg(c).alias(f"{t}_mean"), F.sum(c).alias(f"{t}_sum"), F.count(c).alias(f"{t}_count"), F.min(c).alias(f"{t}_min"), F.max(c).alias(f"{t}_max")]
    out = rows.groupBy(*keys).agg(*aggs)
    for t in [] if small else targets:
        out = out.join(quantiles.group_quantiles(rows, keys, t, wanted, f"_q_{t}"), keys, "left")
    return out.withColumns({f"{t}_{n}": F.col(f"_q_{t}")[i] for t in targets for i, n in enumerate(("median", "lower_bound", "upper_bound"))}).drop(*(f"_q_{t}" for t in targets))


def numbered(cube: DataFrame, by: str, keys: list[str], name: str = "cube_id") -> DataFrame:
    """0-based ids by a statistic, highest first, ties by the keys; one row per cell, so a small table."""
    return cube.withColumn(name, F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), *keys)) - 1)


#: Cells that each row is compared with one by one; more are found through boxes.
INLINE_CELLS = 2_000
#: Cells of the smallest boxes, and the number of halvings per dimension at most.
LEAF_CELLS, DEEPEST = 16, 24


def nearest_cell(rows: DataFrame, cells_: DataFrame, columns: list[str], cell_id: str = "cube_id") -> DataFrame:
    """Id of the nearest cell (Euclidean, ties by id) and its distance for each row, whatever the number of cells.

    Few cells are gathered in one array and compared in the row. Others are indexed as data: boxes of cells, a grid halved
    level by level. Each row goes down the levels with the boxes that can still hold its nearest cell, those no farther
    than the far corner or the mean cell of another, and meets the cells of the last ones; rows with a null coordinate get none.
    """
    if cells_.limit(INLINE_CELLS + 1).count() > INLINE_CELLS:
        return _nearest_by_boxes(rows, cells_, columns, cell_id)
    listed = cells_.agg(F.sort_array(F.collect_list(F.struct(F.col(cell_id).alias("id"), *columns))).alias("_cells"))
    away = lambda c: sum(((F.col(k) - c[k]) * (F.col(k) - c[k]) for k in columns[1:]), (F.col(columns[0]) - c[columns[0]]) * (F.col(columns[0]) - c[columns[0]]))
    best = F.array_min(F.transform("_cells", lambda c: F.struct(away(c).alias("d"), c["id"].alias("id"))))
    return rows.crossJoin(F.broadcast(listed)).withColumn("_b", best).withColumns({cell_id: F.col("_b.id"), "distance": F.sqrt(F.col("_b.d"))}).drop("_cells", "_b")


def _nearest_by_boxes(rows: DataFrame, cells_: DataFrame, columns: list[str], cell_id: str) -> DataFrame:
    dims = range(len(columns))
    cells_ = saved(cells_.na.drop(subset=columns).select(F.col(cell_id).alias("_id"), *(F.col(c).cast("double").alias(f"_c{k}") for k, c in zip(dims, columns, strict=True))), "cells")
    asked = saved(rows.withColumn("_r", F.monotonically_increasing_id()), "nearest-rows")  # read twice, under one number
    ends = cells_.agg(*(f(f"_c{k}") for k in dims for f in (F.min, F.max))).first()
    deepest = min(DEEPEST, 62 // len(columns))

    def box(level: int) -> Column:
        """The number of a cell's box: its place along each dimension, `level` bits of each."""
        unit = [(F.col(f"_c{k}") - ends[2 * k]) / ((ends[2 * k + 1] - ends[2 * k]) or 1.0) for k in dims]
        places = [F.least(F.floor(u * 2**level), F.lit(2**level - 1)).cast("long") for u in unit]
        return sum((F.shiftleft(p, level * k) for k, p in enumerate(places)), F.lit(0).cast("long"))

    depth = 1
    while depth < deepest and cells_.groupBy(box(depth)).count().agg(F.max("count")).first()[0] > LEAF_CELLS:
        depth += 1
    square = lambda x: x * x
    summed = lambda part: sum((part(k) for k in dims), F.lit(0.0))
    near = summed(lambda k: square(F.greatest(F.col(f"_lo{k}") - F.col(f"_x{k}"), F.col(f"_x{k}") - F.col(f"_hi{k}"), F.lit(0.0))))
    far = summed(lambda k: square(F.greatest(F.abs(F.col(f"_x{k}") - F.col(f"_lo{k}")), F.abs(F.col(f"_x{k}") - F.col(f"_hi{k}")))))
    mean = summed(lambda k: square(F.col(f"_x{k}") - F.col(f"_mid{k}")) + F.col(f"_var{k}"))  # the nearest cell is no farther than the mean
    point = [f"_x{k}" for k in dims]
    state = asked.na.drop(subset=columns).select("_r", *(F.col(c).cast("double").alias(x) for c, x in zip(columns, point, strict=True)), F.lit(0).cast("long").alias("_in"))
    for level in range(1, depth + 1):
        ranges = [f(f"_c{k}").alias(f"_{n}{k}") for k in dims for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg), ("var", F.var_pop))]
        boxes = cells_.groupBy(box(level - 1).alias("_in"), box(level).alias("_box")).agg(*ranges)
        state = state.join(boxes, "_in").select("_r", *point, "_box", near.alias("_near"), F.min(F.least(far, mean)).over(Window.partitionBy("_r")).alias("_most"))
        state = state.where(F.col("_near") <= F.col("_most") * (1 + 1e-9)).select("_r", *point, F.col("_box").alias("_in"))
    away = sum((square(F.col(f"_x{k}") - F.col(f"_c{k}")) for k in dims), F.lit(0.0))
    best = state.join(cells_.withColumn("_in", box(depth)), "_in").groupBy("_r").agg(F.min(F.struct(away.alias("d"), "_id")).alias("_b"))
    return asked.join(best, "_r", "left").withColumns({cell_id: F.col("_b._id"), "distance": F.sqrt(F.col("_b.d"))}).drop("_r", "_b")


def residuals(df: DataFrame, bins: list[Bins], target: str, least: int = 0) -> DataFrame:
    """<target>_expected (its cell's median) and res_<target> = expected - actual; cells of at most `least` rows give none."""
    keys = [f"{b.variable}_bin" for b in bins]
    rows = df.withColumns({k: b.label() for k, b in zip(keys, bins, strict=True)})
    known = rows.na.drop(subset=keys)
    mid = quantiles.group_quantiles(known, keys, target, [0.5]).select(*keys, F.col("q")[0].alias(f"{target}_expected"))
    if least:
        mid = mid.join(known.groupBy(*keys).agg(F.count(target).alias("_n")).where(F.col("_n") > least).drop("_n"), keys)
    return rows.join(mid, keys, "left").withColumn(f"res_{target}", F.col(f"{target}_expected") - F.col(target))


def refine(df: DataFrame, variables: list[str], bins: int = 8, tolerance: float = 0.05, levels: int = 3, most: int | None = None, target: str | None = None) -> DataFrame:
    """Adaptive mesh: cells holding `tolerance` of the rows or more are split in halves per dimension, level by level.

    Returns a row per leaf: level, index per dimension, rows and, with a target, its median, std, min and max. Each level is one aggregation; the cells to split
    are joined, not collected.
    """
    n = df.na.drop(subset=variables).count()
    ends = df.agg(*(f(v).alias(f"{k}_{v}") for v in variables for k, f in (("lo", F.min), ("hi", F.max)))).first()
    start = int(2 ** np.ceil(np.log2(bins)))
    unit = [F.try_divide(F.col(v) - F.lit(float(ends[f"lo_{v}"])), F.lit(float(ends[f"hi_{v}"] - ends[f"lo_{v}"]))) for v in variables]
    limit = max(1, int(np.ceil(tolerance * n))) if most is None else most + 1
    open_ = df.na.drop(subset=variables).select(*(u.alias(f"_u{k}") for k, u in enumerate(unit)), *([F.col(target).alias("_t")] if target else []))
    stats = {"std": F.stddev_samp("_t"), "min": F.min("_t"), "max": F.max("_t")} if target else {}
    out, width = None, start
    for level in range(levels + 1):
        index = [F.least(F.floor(F.col(f"_u{k}") * width), F.lit(width - 1)).cast("int").alias(f"i{k}") for k in range(len(variables))]
        keyed = open_.withColumns({f"i{k}": c for k, c in enumerate(index)})
        names = [f"i{k}" for k in range(len(variables))]
        counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("count"), *(c.alias(k) for k, c in stats.items()))
        if target:
            counts = counts.join(quantiles.group_quantiles(keyed, names, "_t", [0.5]).select(*names, F.col("q")[0].alias("median")), names)
        counts = saved(counts, "mesh-level")  # a row per cell, read for the leaves and for the next levels
        last = level == levels
        leaves = (counts if last else counts.where(F.col("count") < limit)).select(F.lit(level).alias("level"), *names, F.col("count").alias("n"), *(["median", *stats] if target else []))
        out = leaves if out is None else out.unionByName(leaves)
        if not last:
            open_ = keyed.join(counts.where(F.col("count") >= limit).select(*names), names, "left_semi").drop(*names)
        width *= 2
    return out


def cube_model(df: DataFrame, bins: list[Bins], targets: list[str], least: int = 5, low: float = 0.4, high: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Rows with <t>_expected and res_<t> = actual - expected for every target, and the cells (cube_id, statistics) they come from.

    Cells of at most `least` rows of a target are left out; a row whose own cell isn't there takes the nearest one's
    medians. Rows and cells meet on the bins' labels, so an id means the same cell on both sides.
    """
    keys = [f"{b.variable}_bin" for b in bins]
    cube = numbered(cells(df, bins, targets, low, high), f"{targets[0]}_mean", keys)
    for t in targets:
        cube = cube.where(F.col(f"{t}_count") > least)
    ids = cube.select(*keys, "cube_id")
    rows = df.withColumns({k: b.label() for k, b in zip(keys, bins, strict=True)}).join(ids, keys, "left")
    here, lost = rows.where("cube_id is not null"), rows.where("cube_id is null").drop("cube_id")
    values = ids.select("cube_id", *(F.col(k).alias(b.variable) for k, b in zip(keys, bins, strict=True)))
    found = nearest_cell(lost.na.drop(subset=[b.variable for b in bins]), values, [b.variable for b in bins]).drop("distance")
    expected = cube.select("cube_id", *(F.col(f"{t}_median").alias(f"{t}_expected") for t in targets))
    out = here.unionByName(found.select(*here.columns)).join(expected, "cube_id").drop(*keys)
    return out.withColumns({f"res_{t}": F.col(t) - F.col(f"{t}_expected") for t in targets}), cube
