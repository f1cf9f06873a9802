"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share BUDGET times all
   words; a target stops at CAP times its source's words and the excess is shared again by weight.
2. Quotas: a source's documents fall into hashed blocks (one per BLOCK_DOCS documents, MAX_BLOCKS at most). Its
   quota is whole passes over all blocks, then blocks in a permuted order until the target, the last one cut.
3. Split: the exact block quotas of every source are split down a tree over the output shards, each node
   drawing its left half by the multivariate hypergeometric law.
4. Draw: a shard takes the next run of each source's permuted blocks, disjoint from all other shards', and
   orders its documents by hash. A document is taken as often as shards draw its block; of the one block that the
   target cuts, documents come in hashed order to within half a document of the target.

There are as many shards as SHARD_WORDS words each make, two at least where there are two blocks, and no more than
MAX_QUOTAS over the number of sources: the driver sees one row per source and those quotas, never documents. Every
draw depends on ids and SEED only, so reruns agree.

Cases: null text has no words, a document without words is never taken; a null source is a source of its own,
the last; rows repeating an id are drawn each by its own source and text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, body, partitions, saved

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2.0
BLOCK_DOCS, MAX_BLOCKS = 64, 1 << 16
SHARD_WORDS, MAX_QUOTAS = 1_000_000, 1 << 22
SEED = 17
#: Sources up to which the table of sources is broadcast; beyond it, it is joined on salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 16


def targets(sizes: list[int], budget: float = BUDGET, cap: float = CAP, weights: tuple = WEIGHTS) -> list[float]:
    """Words to take of each source, in order: shares by weight, none above cap times its size."""
    total, w = budget * sum(sizes), [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        share = total / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * share > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = w[i] * share
            break
        for i in over:
            out[i] = cap * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas (shards x sources) that sum to `blocks`: at each node the left half's share is one hypergeometric draw."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals") if have.sum() else have * 0
        todo += [(mid, hi, have - left), (lo, mid, left)]
    return out


def _with(rows: DataFrame, small: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows joined with a table of a row per source (or source and block): broadcast while small, else salted."""
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), keys)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "_salt"]).drop("_salt")


class _Plan(NamedTuple):
    sources: DataFrame  # _null, _src, s, source_size, target, _blocks
    n_sources: int
    blocks: DataFrame  # s, block, _cut (whether the target cuts its last draw), _left (words that draw may take), _shards (of its draws)
    n_blocks: int
    seed: int


def _size(text_col: str) -> Column:
    return F.regexp_count(body(text_col), F.lit(WORD)).cast("long")


def _source(source_col: str) -> list[Column]:
    return [F.col(source_col).isNull().alias("_null"), F.coalesce(F.col(source_col), F.lit("")).alias("_src")]


def _planned(sized: DataFrame, seed: int, shards: int | None) -> _Plan:
    """What shards draw, from doc_id, _null, _src, size."""
    spark = sized.sparkSession
    per = sized.groupBy("_null", "_src").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    per.sort(key=lambda r: (r._null, r._src))  # Python compares strings by code point
    want = targets([r.words for r in per])
    blocks = [int(min(MAX_BLOCKS, max(1, -(-r.n // BLOCK_DOCS)))) for r in per]
    full = [int(t // r.words) if r.words else 0 for t, r in zip(want, per, strict=True)]
    rest = [t - f * r.words for t, f, r in zip(want, full, per, strict=True)]
    table = [(r._null, r._src, k, int(r.words), float(t), b, f, float(x)) for k, (r, t, b, f, x) in enumerate(zip(per, want, blocks, full, rest, strict=True))]
    sources = spark.createDataFrame(table, "_null boolean, _src string, s int, source_size long, target double, _blocks int, _full int, _rest double")
    rows = _with(sized, sources, ["_null", "_src"], len(per)).withColumn("block", _block(seed))

    held = rows.groupBy("s", "block", "_full", "_rest").agg(F.sum("size").alias("_words"))
    order = Window.partitionBy("s").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    held = held.withColumn("_end", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("_rest") - (F.col("_end") - F.col("_words"))  # what is still wanted when the block's turn comes
    draws = F.col("_full") + (left > 0).cast("int")
    held = saved(held.select("s", "block", draws.alias("_draws"), ((left > 0) & (F.col("_words") > left)).alias("_cut"), left.alias("_left")), "mix-blocks")

    quotas = np.zeros(len(per), np.int64)
    for r in held.groupBy("s").agg(F.sum("_draws").alias("n")).collect():
        quotas[r.s] = r.n
    many = -(-int(sum(want)) // SHARD_WORDS)
    shards = shards or max(1, min(max(2, many), int(quotas.sum()), MAX_QUOTAS // max(1, len(per))))
    until = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    runs = spark.createDataFrame([(k, [int(x) for x in until[:, k]]) for k in range(len(per))], "s int, _until array<long>")
    draw = held.where("_draws > 0").select("s", "block", F.explode(F.expr("sequence(1, _draws)")).alias("draw"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("block", "draw", F.lit(seed + 3)), "block", "draw")) - 1
    draw = draw.withColumn("_rank", rank).join(F.broadcast(runs) if len(per) <= BROADCAST_SOURCES else runs, "s")
    draw = draw.withColumn("shard", F.size(F.filter("_until", lambda u: u <= F.col("_rank"))))
    drawn = draw.groupBy("s", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "shard"))), lambda x: x["shard"]).alias("_shards"))
    table = held.join(drawn, ["s", "block"], "left").select("s", "block", "_cut", "_left", F.coalesce("_shards", F.array().cast("array<int>")).alias("_shards"))
    return _Plan(sources.drop("_full", "_rest"), len(per), saved(table, "mix-draws"), sum(blocks), seed)


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_blocks")).cast("int")


def _drawn(rows: DataFrame, plan: _Plan, size: Column, some: Column) -> DataFrame:
    """rows (doc_id, _null, _src, _order and others) with source_size, target, shards, places: of each time they are taken."""
    rows = _with(rows, plan.sources, ["_null", "_src"], plan.n_sources).withColumn("block", _block(plan.seed)).drop("_null", "_src", "_blocks")
    rows = _with(rows, plan.blocks, ["s", "block"], plan.n_blocks)
    turn = Window.partitionBy("s", "block").orderBy(F.xxhash64("doc_id", F.lit(plan.seed + 2)), "doc_id", "_order")
    cut = rows.where("_cut").withColumn("_size", size)
    upto = F.sum("_size").over(turn.rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_last", upto - F.col("_size") / 2 < F.col("_left")).drop("_size")
    rows = rows.where("not _cut").withColumn("_last", F.lit(True)).unionByName(cut)
    times = F.when(some, F.size("_shards") - F.when(F.col("_last"), 0).otherwise(1)).otherwise(0)
    rows = rows.withColumn("shards", F.slice("_shards", F.lit(1), times))
    return rows.withColumn("places", F.transform("shards", lambda x, i: F.xxhash64(F.col("doc_id"), i, F.lit(plan.seed + 4)))).drop("s", "block", "_cut", "_left", "_shards", "_last", "_order")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return saved(docs.select(F.col(id_col).alias("doc_id"), *_source(source_col), _size(text_col).alias("size"), F.xxhash64(text_col).alias("_order")), "mix-sizes")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, shards (array: the output shard of each copy), places (array: order in it)."""
    sized = _sized(docs, id_col, text_col, source_col)
    out = _drawn(sized, _planned(sized, seed, shards), F.col("size"), F.col("size") > 0).withColumn("copies", F.size("shards"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards", "places")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shards: int | None = None) -> DataFrame:
    """row (docs' columns as a struct), shard, place: the rows of docs as often as the mix takes them, dealt to shards and in a shard's order."""
    plan = _planned(_sized(docs, id_col, text_col, source_col), seed, shards)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), *_source(source_col), F.xxhash64(text_col).alias("_order"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = _drawn(rows, plan, F.regexp_count(text, F.lit(WORD)).cast("long"), text.rlike(WORD))
    dealt = rows.select("row", F.explode(F.arrays_zip(F.col("shards").alias("shard"), F.col("places").alias("place"))).alias("c")).select("row", "c.shard", "c.place")
    return dealt.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", "place")
