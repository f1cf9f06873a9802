"""Long series in chunks: a key's rows, in order, over many tasks, with what a chunk needs of those before and after it.

Rows are range-partitioned by key and order, so that a hot key is spread and equal times stay together. Each chunk is
summed up in one row; carrying values from chunk to chunk is a window over these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import saved, tasks

#: Rows up to which a series stays with its key, in one window partition.
WHOLE = 200_000


def is_long(df: DataFrame) -> bool:
    return df.limit(WHOLE + 1).count() > WHOLE


def numbered(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """df with _chunk (ascending along each key) and _k, the order of its rows in a chunk."""
    parts = max(tasks(df.sparkSession), -(-df.count() // WHOLE))
    out = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_k", F.monotonically_increasing_id())
    return saved(out.withColumn("_chunk", F.shiftright("_k", 33).cast("int")), "chunks")


class Chunks:
    """Windows within the chunks of numbered rows, and values carried over them."""

    def __init__(self, keys: list[str]):
        self.keys = [*keys]
        self.rows = Window.partitionBy("_chunk", *keys).orderBy("_k")
        self.so_far = self.rows.rowsBetween(Window.unboundedPreceding, 0)
        self.to_come = Window.partitionBy("_chunk", *keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
        along = Window.partitionBy(*keys).orderBy("_chunk")
        self.next_to = along
        self.earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        self.later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, rows: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """rows with the `carry` columns, window expressions over the chunks' summaries."""
        ends = rows.groupBy("_chunk", *self.keys).agg(*(c.alias(n) for n, c in summary.items()))
        names = {k: f"_key{i}" for i, k in enumerate(self.keys)}
        ends = ends.select("_chunk", *self.keys, *(c.alias(n) for n, c in carry.items()))
        ends = ends.select(F.col("_chunk").alias("_c"), *(F.col(k).alias(n) for k, n in names.items()), *carry)
        meet = F.col("_chunk") == F.col("_c")
        for k, n in names.items():
            meet &= F.col(k).eqNullSafe(F.col(n))
        return rows.join(ends, meet).drop("_c", *names.values())


def first_last(value: Column, last: bool) -> Column:
    """The value of a chunk's first or last row."""
    return (F.max_by if last else F.min_by)(value, F.col("_k"))


def runs(df: DataFrame, on: Column, order: str, keys: list[str], label: str) -> DataFrame:
    """events.label_runs over chunks."""
    c = Chunks(keys)
    rows = numbered(df.withColumn("_on", on), keys, order)
    rows = rows.withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(c.rows), F.lit(False))).cast("long"))
    summary = {"_head": first_last(F.col("_on"), False), "_tail": first_last(F.col("_on"), True), "_n": F.sum("_new")}
    goes_on = (F.col("_head") & F.coalesce(F.lag("_tail").over(c.next_to), F.lit(False))).cast("long")
    before = c.carried(rows, summary, {"_less": goes_on, "_own": F.col("_n") - goes_on})
    # the runs of the chunks before: a second, tiny window over the corrected counts
    base = c.carried(before, {"_own": F.first("_own"), "_less": F.first("_less")}, {"_base": F.coalesce(F.sum("_own").over(c.earlier), F.lit(0))})
    number = F.col("_base") + F.sum("_new").over(c.so_far) - F.col("_less")
    return base.withColumn(label, F.when(F.col("_on"), number).otherwise(0).cast("int")).select(*df.columns, label)


def merged_runs(df: DataFrame, on: Column, t: Column, order: str, merge: float, period: float | None, keys: list[str], label: str) -> DataFrame:
    """events.label_runs_merged over chunks; t in microseconds."""
    c = Chunks(keys)
    rows = numbered(df.withColumns({"_on": on, "_t": t}), keys, order)
    flagged = F.when(F.col("_on"), F.col("_t"))
    rows = c.carried(rows, {"_tail": first_last(F.col("_on"), True), "_seen": F.max(flagged)}, {"_row0": F.lag("_tail").over(c.next_to), "_t0": F.max("_seen").over(c.earlier)})
    previous = F.coalesce(F.last(flagged, ignorenulls=True).over(c.rows.rowsBetween(Window.unboundedPreceding, -1)), F.col("_t0"))
    gap = F.col("_t") - previous
    joined = (gap <= merge) & ((gap > F.lit(period)) | F.coalesce(F.lag("_on").over(c.rows), F.col("_row0")))
    rows = rows.withColumn("_new", (F.col("_on") & ~F.coalesce(joined, F.lit(False))).cast("long"))
    opens = F.when(F.col("_on"), F.col("_new"))
    rows = c.carried(rows, {"_n": F.sum("_new"), "_open": F.min_by(F.col("_new"), F.when(F.col("_on"), F.col("_k")))}, {"_base": F.coalesce(F.sum("_n").over(c.earlier), F.lit(0)), "_next0": F.last("_open", ignorenulls=True).over(c.later)})
    rows = rows.withColumns({"_run": F.col("_base") + F.sum("_new").over(c.so_far), "_next": F.coalesce(F.last(opens, ignorenulls=True).over(c.to_come), F.col("_next0"))})
    bridged = ~F.col("_on") & (F.col("_run") > 0) & (F.col("_next") == 0)  # the next flagged row goes on with the run before
    return rows.withColumn(label, F.when(F.col("_on") | F.coalesce(bridged, F.lit(False)), F.col("_run")).otherwise(0).cast("int")).select(*df.columns, label)


def positions(df: DataFrame, order: str, keys: list[str], extra: dict[str, tuple[Column, Column]] | None = None) -> tuple[DataFrame, Chunks]:
    """Numbered rows with _i, their position along the key from 1; `extra` are (summary, carry) by name, which may use _i."""
    c = Chunks(keys)
    rows = c.carried(numbered(df, keys, order), {"_n": F.count(F.lit(1))}, {"_base": F.coalesce(F.sum("_n").over(c.earlier), F.lit(0))})
    rows = rows.withColumn("_i", F.col("_base") + F.row_number().over(c.rows)).drop("_base")
    if extra:
        rows = c.carried(rows, {n: s for n, (s, _) in extra.items()}, {n: k for n, (_, k) in extra.items()})
    return rows, c


def interpolated(df: DataFrame, value: str, order: str, keys: list[str], out: str) -> DataFrame:
    """resample.interpolate over chunks."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i"), F.col(value).cast("double").alias("v")))
    c = Chunks(keys)
    extra = {"_p0": (F.max(known), F.last("_p0", ignorenulls=True).over(c.earlier)), "_q0": (F.min(known), F.last("_q0", ignorenulls=True).over(c.later))}
    rows, c = positions(df, order, keys, extra)
    rows = rows.withColumns({"_p": F.coalesce(F.last(known, ignorenulls=True).over(c.so_far), F.col("_p0")), "_q": F.coalesce(F.last(known, ignorenulls=True).over(c.to_come), F.col("_q0"))})
    p, q = F.col("_p"), F.col("_q")
    between = p["v"] + (q["v"] - p["v"]) * F.try_divide(F.col("_i") - p["_i"], q["_i"] - p["_i"])
    filled = rows.withColumn("_filled", F.coalesce(F.col(value).cast("double"), between, p["v"]))
    names = [*df.columns, *([out] if out not in df.columns else [])]
    return filled.select(*(F.col("_filled").alias(n) if n == out else F.col(n) for n in names))


def with_halos(df: DataFrame, order: str, keys: list[str], halo: int, size: int | None = None) -> DataFrame:
    """Rows with _i (position along the key), _part and _mine: parts of `size` rows of a key, and copies of `halo` rows
    of the parts before and after each, which aren't its own."""
    size = size or max(4 * halo, WHOLE // 4)
    rows, _ = positions(df, order, keys)
    part = lambda i: F.floor(i / size).cast("long")
    at = F.col("_i") - 1
    copies = rows.withColumns({"_own": part(at), "_part": F.explode(F.sequence(F.greatest(part(at - halo), F.lit(0)), part(at + halo)))})
    return copies.withColumn("_mine", F.col("_own") == F.col("_part")).drop("_own", "_chunk", "_k")
