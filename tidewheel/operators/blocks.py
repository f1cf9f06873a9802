"""Rows in blocks: comparisons of all rows with all rows, and sums over all rows, without a limit on their number.

A block is a row of lists. Some blocks make a group, which meets every block of its part in one stream, so that a task
holds a group and a block at a time. There are about two groups a core, until a group has OWN rows: up to there what is
shuffled grows with the rows, and beyond with their square over OWN.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block at most; smaller tables have smaller blocks, which changes how the work is dealt and no result.
BLOCK = 1024

#: Rows of a group at most, and numbers in a matrix of a group's rows with those of a block that meets it.
OWN, MATRIX = 32_768, 8_000_000

#: Blocks whose numbers are broadcast at most; more of them are shuffled.
LISTED = 1_000_000

Block = namedtuple("Block", "number x columns")

_own: dict[str, str] = {}


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir (a temporary one where that is unset in local mode) and read back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewheel-"))
    path = f"{root.rstrip('/')}/tidewheel/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def packed(df: DataFrame, array_col: str, columns: list[str], key: str, part: str | None = None, size: int | None = None) -> DataFrame:
    """block, part, x (the rows' vectors end to end) and a list per column; blocks have rows of one part only."""
    n = df.count()
    size = size or int(np.clip(-(-n // 32), 64, BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.lit(0).alias("part") if part is None else F.col(part).cast("int").alias("part"), F.col(array_col).cast("array<double>").alias("x"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(key).alias("_key"))
    names = [f"c{i}" for i in range(len(columns))]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[int, pd.DataFrame] = {}

        def row(p: int, b: pd.DataFrame) -> dict:
            return {"part": p, "x": np.concatenate(b["x"].tolist())} | {c: b[c].tolist() for c in names}

        for batch in batches:
            out = []
            for p, b in batch.groupby("part"):
                b = pd.concat([left.pop(p), b]) if p in left else b
                while len(b) >= size:
                    out.append(row(p, b.iloc[:size]))
                    b = b.iloc[size:]
                if len(b):
                    left[p] = b
            if out:
                yield pd.DataFrame(out)
        if left:
            yield pd.DataFrame([row(p, b) for p, b in left.items()])

    schema = ", ".join(["part int", "x array<double>", *(f"{c} array<{kinds[k]}>" for c, k in zip(names, columns, strict=True))])
    dealt = rows.repartition(max(1, n // (4 * size)), "_key").sortWithinPartitions("_key", *names).drop("_key")
    return saved(dealt.mapInPandas(pack, schema).select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def _blocks(batch: pd.DataFrame) -> Iterator[tuple[int, bool, Block]]:
    names = [c for c in batch.columns if c not in ("mine", "own", "block", "part", "x")]
    for r in batch.itertuples(index=False):
        cols = [np.array(getattr(r, c)) for c in names]
        yield r.mine, r.own, Block(int(r.block), np.asarray(r.x, float).reshape(len(cols[0]), -1), cols)


def _together(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    return Block(blocks[0].number, np.concatenate([b.x for b in blocks]), [np.concatenate(c) for c in zip(*(b.columns for b in blocks), strict=True)])


def against_all(blocks: DataFrame, run: Callable[[Block, Iterator[Block]], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that run(group of blocks, every block of its part) gives for each group; blocks come in slices of their rows."""
    spark = blocks.sparkSession
    mine = blocks.select("part", "block")
    n = mine.count()
    most = int(np.clip(n // (2 * spark.sparkContext.defaultParallelism), 1, max(1, OWN // BLOCK)))
    at = F.floor((F.row_number().over(Window.partitionBy("part").orderBy("block")) - 1) / most)  # two numbers a block
    grouped = mine.withColumn("mine", F.xxhash64("part", at)).select(F.col("part").alias("_part"), F.col("block").alias("_block"), "mine")
    groups = grouped.groupBy("_part", "mine").count().select(F.col("_part").alias("part"), "mine")
    few = n <= LISTED
    with_own = blocks.join(F.broadcast(grouped) if few else grouped, F.col("block") == F.col("_block")).withColumn("_of", F.col("mine")).drop("_part", "_block", "mine")
    pairs = with_own.join(F.broadcast(groups) if few else groups, "part").withColumn("own", F.col("_of") == F.col("mine")).drop("_of")
    pairs = pairs.repartition(tasks(spark), "mine").sortWithinPartitions("mine", F.desc("own"), "block")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in groupby(chain.from_iterable(map(_blocks, batches)), key=lambda p: p[0]):
            held, rest = [], []
            for _, own, b in group:
                if not own:
                    rest.append(b)
                    break
                held.append(b)
            whole = _together(held)
            step = max(1, MATRIX // len(whole.x))
            others = chain(held, rest, (b for _, _, b in group))
            yield run(whole, (Block(b.number, b.x[i : i + step], [c[i : i + step] for c in b.columns]) for b in others for i in range(0, len(b.x), step)))

    return pairs.mapInPandas(go, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def summed(df: DataFrame, columns: list[str], run: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of run(batch), `width` numbers; a batch sends one row."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([run(b)], columns=[f"s{i}" for i in range(width)])

    out = df.select(*columns).mapInPandas(go, ", ".join(f"s{i} double" for i in range(width)))
    return np.array([v or 0.0 for v in out.agg(*(F.sum(f"s{i}") for i in range(width))).first()])
