"""Exact quantiles (linear interpolation) of columns too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.chunks import Chunks, numbered

#: Values that the last step may sort in one task.
LEAF = 200_000


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], leaf: int = LEAF) -> list[float | None]:
    """Quantiles as numpy's default method has them, nulls and NaN left out.

    Each wanted rank is bracketed by approximate quantiles until at most `leaf` distinct values are between
    the brackets; only those reach one task. Every narrowing is one scan with map-side aggregation.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(probabilities)
    return [_at(values, p * (n - 1), n, leaf) for p in probabilities]


def _at(values: DataFrame, rank: float, n: int, leaf: int) -> float:
    lo_rank = int(rank)
    below, inside, span = 0, n, values
    while inside > leaf:
        eps = 1 / 2000
        share = (lo_rank - below) / max(1, inside - 1)
        a, b = span.select(F.percentile_approx("v", F.array(F.lit(max(0.0, share - eps)), F.lit(min(1.0, share + eps))), 20_000)).first()[0]
        less, within = span.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when((F.col("v") >= a) & (F.col("v") <= b), 1))).first()
        if not below + less <= lo_rank < below + less + within:
            a, b, less, within = None, None, 0, inside  # bracket missed: sort what is left
            break
        if a == b or within == inside:
            below, inside, span = below + less, within, span.where((F.col("v") >= a) & (F.col("v") <= b))
            break
        below, inside, span = below + less, within, span.where((F.col("v") >= a) & (F.col("v") <= b))
    counts = span.groupBy("v").count().orderBy("v")
    seen, low = below, None
    for v, c in counts.toLocalIterator():
        seen += c
        if low is None and seen > lo_rank:
            low = v
            if seen > lo_rank + 1 or rank == lo_rank or lo_rank + 1 >= n:
                return low
        elif low is not None:
            return low + (rank - lo_rank) * (v - low)
    upper = values.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return low + (rank - lo_rank) * ((upper if upper is not None else low) - low)


def group_quantiles(df: DataFrame, keys: list[str], column: str, probabilities: list[float], out: str = "q", leaf: int = LEAF) -> DataFrame:
    """keys, out: exact quantiles per group as an array in the order of `probabilities` (null for a group without values).

    Equal values are counted first, on the map side, so that later steps see each value of a group once. Groups of at
    most `leaf` rows altogether are then sorted by key. Else the counts are range-partitioned by group and value, in
    chunks whose totals are carried along, so that no task holds a hot group and there is one shuffle more, not a scan a round.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("_v"))
    listed = F.array(*map(F.lit, probabilities))
    if values.limit(leaf + 1).count() <= leaf:
        return values.groupBy(*keys).agg(F.percentile("_v", listed).alias(out))
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_count"))
    c = Chunks([*keys])
    rows = numbered(counts, [*keys], "_v")
    known = F.col("_v").isNotNull() & ~F.isnan("_v")
    rows = rows.withColumn("_count", F.when(known, F.col("_count")).otherwise(0))
    every = Window.partitionBy(*keys)  # a row a chunk
    rows = c.carried(rows, {"_s": F.sum("_count")}, {"_base": F.coalesce(F.sum("_s").over(c.earlier), F.lit(0)), "_n": F.sum("_s").over(every)})
    rows = rows.withColumn("_to", F.sum("_count").over(c.so_far) + F.col("_base"))
    rank = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    # the first values whose running counts pass the ranks on both sides of a quantile
    first = lambda at: F.min(F.when(known & (F.col("_to") > at), F.col("_v")))
    sides = [x for k, p in enumerate(probabilities) for x in (first(F.floor(rank(p))).alias(f"_x{k}"), first(F.least(F.floor(rank(p)) + 1, F.col("_n") - 1)).alias(f"_y{k}"))]
    found = rows.groupBy(*keys).agg(*sides, F.first("_n").alias("_n"))
    at = [F.col(f"_x{k}") + (rank(p) - F.floor(rank(p))) * (F.col(f"_y{k}") - F.col(f"_x{k}")) for k, p in enumerate(probabilities)]
    return found.select(*keys, F.when(F.col("_n") > 0, F.array(*at)).alias(out))
