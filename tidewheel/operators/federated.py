"""The global forest of a federation, and its retraining: donated trees scored for all rows, periods between trainings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.blocks import saved, tasks
from tidewheel.operators.learning import LOSS_ROWS, LOSS_TREES, all_pairs, drift_days, drift_flags, predictions, tree_blocks


#: Blocks of points whose sums a task holds before it hands them on.
HELD = 64


def global_predictions(forest: DataFrame, df: DataFrame, key: str, features: list[str], donated: int = 1) -> DataFrame:
    """key, prediction, trees: the mean of the trees that workers donate (the first `donated` of each) for every row.

    Rows of equal features have equal predictions, so trees meet the different points of feature space only, in blocks;
    a task adds up what its trees say of a block, and the sums meet the rows by their features. There may be any number
    of rows, points and trees. Keys tell rows apart; rows with a null feature are left out; without trees there are no rows.
    """
    n = len(features)
    names = [f"f{i}" for i in range(n)]
    rows = df.na.drop(subset=features).select(F.col(key), *((F.col(c).cast("double") + 0.0).alias(f) for f, c in zip(names, features, strict=True)))
    size = LOSS_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                x = pa.array(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)], ["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for x, s in held.values():
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(s)], [*names, "s"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                block, x, table, trees = (b.column(c)[i] for c in range(4))
                x, block = x.values.to_numpy().reshape(-1, n), block.as_py()
                if block not in held and len(held) >= HELD:
                    yield from handed()
                total = predictions(table.values.to_numpy().reshape(trees.values[0].as_py(), -1, 5), x).sum(0)
                held[block] = (x, held[block][1] + total if block in held else total)
        yield from handed()

    given = tree_blocks(forest.where(F.col("tree_no") < donated), [], LOSS_TREES)
    count = given.agg(F.sum(F.col("trees")[0]).cast("long")).first()[0] or 0
    points = saved(rows.select(*names).distinct(), "global-points")
    packs = max(1, min(tasks(df.sparkSession), points.count() // size))
    blocks = saved(points.repartition(packs).mapInArrow(pack, "x array<double>").select(F.monotonically_increasing_id().alias("block"), "x"), "global-blocks")
    # every point is scored by every block of trees: the model's own definition
    fields = ", ".join(f"{f} double" for f in names)
    sums = all_pairs(blocks, given).mapInArrow(add, f"{fields}, s double")
    scored = saved(sums.groupBy(*names).agg((F.sum("s") / F.lit(count)).alias("prediction")), "global-scores")
    return rows.join(scored, names).select(key, "prediction", F.lit(count).cast("long").alias("trees"))


def retrainings(trained: Callable[[date | None], tuple[DataFrame, DataFrame]], worker: str, day: str, error: str, cluster: str = "cluster", spread: float = 3.0, days: int = 3, support: float = 0.033, share: float = 0.16, most: int = 100) -> list[tuple[date | None, date | None]]:
    """Periods (the day the models were trained on, None at first, and the day a retraining is due, None at last).

    trained(since) gives the daily errors by worker after that day under the models trained on the data up to it, and
    the clusters of the workers. A period is learning.drift_flags and drift_days on these; only its one day comes to
    the driver.
    """
    out: list[tuple[date | None, date | None]] = []
    since = None
    while len(out) < most:
        daily, clusters = trained(since)
        daily = saved(daily.select(worker, day, error), "daily-errors")
        due = drift_days(drift_flags(daily, worker, day, error, spread, days), clusters, worker, day, cluster, support, share)
        at = due.where("retrain").agg(F.min(day)).first()[0]
        out.append((since, at))
        if at is None:
            break
        since = at
    return out
