"""Distances between tables, distributions, regression errors, ROC curves, confusion matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.blocks import saved


def matrix_distances(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Frobenius, its square and root, Manhattan and cosine distance of two long tables (cells missing on one side are 0)."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full").na.fill(0.0, ["_a", "_b"])
    d, sq = F.col("_a") - F.col("_b"), lambda c: F.sum(c * c)
    out = j.agg(sq(d).alias("frobenius_squared"), F.sum(F.abs(d)).alias("manhattan"), (1 - F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sqrt(sq(F.col("_a"))) * F.sqrt(sq(F.col("_b"))))).alias("cosine"))
    return out.withColumns({"frobenius": F.sqrt("frobenius_squared"), "frobenius_root": F.sqrt(F.sqrt("frobenius_squared"))})


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def kde(df: DataFrame, value: str, bandwidth: float = 1.0, points: int = 1000) -> DataFrame:
    """x, density: Gaussian kernel density on a grid from minimum to maximum. A task sends a sum per grid point, not rows."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    grid = np.linspace(lo, hi, points) if n else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for batch in batches:
            v = batch.column(0).to_numpy()
            for part in np.array_split(v, len(v) // 1024 + 1):
                total += np.exp(-0.5 * ((grid[:, None] - part[None]) / bandwidth) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array(total)], ["x", "total"])

    return rows.mapInArrow(run, "x double, total double").groupBy("x").agg((F.sum("total") / (n * bandwidth * np.sqrt(2 * np.pi))).alias("density"))


def histogram_intersection(a: DataFrame, b: DataFrame, bin_col: str, height: str, width: float = 1.0) -> DataFrame:
    j = a.select(bin_col, F.col(height).alias("_a")).join(b.select(bin_col, F.col(height).alias("_b")), bin_col)
    return j.agg(F.sum(F.least(F.col("_a") * width, F.col("_b") * width)).alias("intersection"))


def regression_errors(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """rmse, nrmse, mae, rae, rrse, mape; the relative errors compare with the mean of the observations."""
    m = df.agg(F.avg(obs).alias("_m"))
    r = df.crossJoin(F.broadcast(m))
    o, p = F.col(obs), F.col(pred)
    e = o - p
    return r.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), (F.sqrt(F.avg(e * e)) / F.avg(o)).alias("nrmse"), F.avg(F.abs(e)).alias("mae"),
        F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(F.col("_m") - o))).alias("rae"),
        F.sqrt(F.try_divide(F.sum(e * e), F.sum((F.col("_m") - o) * (F.col("_m") - o)))).alias("rrse"),
        F.avg(F.abs(F.try_divide(e, o))).alias("mape"),
    )


#: Ranges of scores that the ROC curve's running sums are split over.
ROC_PARTS = 64


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr for each distinct score, predicting positive at it or above.

    Counts per score are summed within ranges of scores, then the ranges' own totals are added, so no task
    holds all scores.
    """
    per = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) != 1).cast("long")).alias("n"))
    cuts = sorted(set(per.select(F.percentile_approx("threshold", [k / ROC_PARTS for k in range(1, ROC_PARTS)])).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("threshold"))) if cuts else F.lit(0)
    per = per.withColumn("part", part)
    totals = per.groupBy("part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # ROC_PARTS rows
    every = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_p", "_n")), *(F.sum(c).over(every).alias(f"{c}1") for c in ("_p", "_n")))
    run = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(totals), "part").withColumns({"tp": F.sum("p").over(run) + F.col("_p0"), "fp": F.sum("n").over(run) + F.col("_n0")})
    return out.select("threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("_p1")).alias("tpr"), F.try_divide(F.col("fp"), F.col("_n1")).alias("fpr"))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve: the chance that a positive outranks a negative, ties counting half."""
    c = roc_curve(df, score, truth)
    per = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("_here"), F.sum((F.col(truth) != 1).cast("long")).alias("_other"))
    j = c.join(per, "threshold")
    return j.agg(F.try_divide(F.sum(F.col("_other") * (F.col("tp") - F.col("_here") / 2)), F.max("tp") * F.max("fp")).alias("auc"))


def tpr_at_fpr(curve: DataFrame, fpr: float) -> DataFrame:
    """Highest TPR among thresholds whose FPR is at most the given one."""
    return curve.where(F.col("fpr") <= fpr).agg(F.max("tpr").alias("tpr"))


def fpr_at_tpr(curve: DataFrame, tpr: float) -> DataFrame:
    """FPR where the TPR first exceeds the given one; 0 if it never does."""
    return curve.where(F.col("tpr") > tpr).agg(F.coalesce(F.min("fpr"), F.lit(0.0)).alias("fpr"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def binary_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(c.cast("long"))
    out = df.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    out = out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def student_tail(t: float, n: float) -> float:
    """P(|T| > |t|) for Student's t with n degrees of freedom: the incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    x, a, b = n / (n + t * t), n / 2, 0.5
    if x in (0.0, 1.0):
        return x
    if flip := x > (a + 1) / (a + b + 2):
        x, a, b = 1 - x, b, a
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d, f = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-30), 1.0
    f = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or 1e-30), 1 + k / c or 1e-30
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * f if flip else front * f


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, n, t and p (two-sided) of the linear correlation of two columns, rows with a null left out; one row."""
    row = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    out = row.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r"))))
    tail = F.pandas_udf(lambda t, n: t.combine(n, lambda a, b: student_tail(a, b - 2) if a == a and b > 2 else None).astype("float64"), "double")
    return out.withColumn("p", tail(F.col("t").cast("double"), F.col("n")))


def mahalanobis(df: DataFrame, columns: list[str], out: str = "distance") -> DataFrame:
    """Each row's distance from the columns' means under their inverse covariance; null where a column is.

    Means and covariances are one row of sums; the inverse is made on the driver from that row.
    """
    import numpy as np

    known = df.na.drop(subset=columns)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    row = known.agg(*aggs).first()
    if row[0] is None or any(v is None for v in row):
        return df.withColumn(out, F.lit(None).cast("double"))
    k = range(len(columns))
    inverse = np.linalg.pinv(np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in k] for i in k], float))
    away = [F.col(c) - F.lit(float(row[f"m{i}"])) for i, c in enumerate(columns)]
    square = sum((F.lit(float(inverse[i, j])) * away[i] * away[j] for i in k for j in k), F.lit(0.0))
    return df.withColumn(out, F.when(square > 0, F.sqrt(square)).when(square <= 0, 0.0))


#: Rows of a side up to which pairwise distances broadcast it; beyond, both sides are dealt in blocks.
BROADCAST_ROWS, BLOCKS = 500_000, 64
#: Pairs that a task of pairwise() makes, as long as there are fewer than PAIR_TASKS tasks and a task has TILE rows of the right side.
TASK_PAIRS, PAIR_TASKS = 2_000_000, 8_000
#: Rows of the right side that a left row meets before the next one.
TILE = 256


def pairwise(left: DataFrame, right: DataFrame, ids: tuple[str, str], columns: list[str], angular: list[str] = (), boundary: float = 360.0, kind: str = "euclidean") -> DataFrame:
    """ids of both sides and their distance, a row per pair: Euclidean, or the sum of absolute and signed angular differences ("mixed").

    Pairs come in tiles of rows of near values: a row's id stays for a tile's width, few ids take turns, and equal
    distances stand together, so that Parquet's runs and dictionaries keep a written result small.
    """
    from tidewheel.functions.angles import angular_distance

    n, both = len(columns), [*columns, *angular]
    a = left.select(*(F.col(c).alias(f"_a{i}") for i, c in enumerate(both)), F.col(ids[0]).alias("a"))
    b = right.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(both)), F.col(ids[1]).alias("b"))
    n_a, n_b = a.count(), b.count()
    # a number of partitions that adaptive execution keeps: the input is small, the pairs are many
    parts = max(1, min(PAIR_TASKS, n_a * n_b // TASK_PAIRS, max(n_b // TILE, 4 * right.sparkSession.sparkContext.defaultParallelism)))
    if max(n_a, n_b) <= BROADCAST_ROWS:
        tile = F.floor(F.monotonically_increasing_id() / min(TILE, max(1, n_b // parts)))
        b = saved(b.orderBy(*b.columns).withColumn("_tile", tile), "pair-tiles")
        same = lambda batches: batches
        a = a.orderBy(*a.columns).mapInArrow(same, a.schema)  # a step that keeps the order, which a join may drop
        met = b.select("_tile").distinct().repartition(parts).crossJoin(F.broadcast(a))
        # and one that hands rows on as they come: in one step with the next join all pairs of a tile would be held
        pairs = met.mapInArrow(same, met.schema).join(F.broadcast(b), "_tile")
    else:
        pairs = b.repartition(parts).crossJoin(F.broadcast(a) if n_a <= BROADCAST_ROWS else a.repartition(BLOCKS))
    if kind == "euclidean":
        distance = F.sqrt(sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(n)), F.lit(0.0)))
    else:
        distance = sum((F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(n)), F.lit(0.0)) + sum((angular_distance(F.col(f"_a{i}"), F.col(f"_b{i}"), boundary) for i in range(n, len(both))), F.lit(0.0))
    return pairs.select("a", "b", distance.alias("distance"))
