"""Gearbox vibration: spectra, bands of orders, fingerprints of operating modes, and distances to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import clean, learning, metrics

RATE, SEGMENT, LEAST_RPM = 20_480, 10_240, 10
#: Bands of orders: 50 of width 2, from 0.5 on. Fixed values.
BANDS = [(0.5 + 2 * k, 2.5 + 2 * k) for k in range(50)]
SAMPLE = ["sample", "direction", "rpm", "torque"]
#: Rows of spectra that profiles are fitted on, and operating modes that a sample is compared with at most.
FIT_ROWS, MODES = 20_000, 5_000


def by_direction(vibration: DataFrame, time_col: str = "i") -> DataFrame:
    """sample, direction, rpm, torque, i, v: the axes under each other. Rows need a sample and their position in it."""
    return vibration.unpivot(["sample", "rpm", "torque", time_col], ["x", "y", "z"], "direction", "v")


def orders(long: DataFrame, time_col: str = "i", rate: float = RATE, segment: int = SEGMENT, bands: list[tuple[float, float]] = BANDS) -> DataFrame:
    """Power per band of orders (frequency over turns a second), both ends of a band closed; too slow samples go."""
    psd = learning.spectra(long.where(F.col("rpm") > LEAST_RPM), SAMPLE, time_col, "v", rate, segment)
    return learning.bands(psd.withColumn("order", F.col("frequency") / (F.col("rpm") / 60)), SAMPLE, "order", "power", bands)


def profiles(banded: DataFrame, bands: list[tuple[float, float]] = BANDS) -> DataFrame:
    """A row per sample and direction: its bands as one array of shares that sum to 1, 0 for empty bands."""
    filled = banded.groupBy(*SAMPLE).agg(F.map_from_entries(F.collect_list(F.struct("lo", "total"))).alias("m"), F.sum("total").alias("all"))
    each = F.array(*(F.coalesce(F.try_divide(F.element_at("m", F.lit(float(lo))), F.col("all")), F.lit(0.0)) for lo, _ in bands))
    return filled.where("all > 0").select(*SAMPLE, each.alias("profile"))


def components(profiled: DataFrame, k: int, rows: int = FIT_ROWS, seed: int = 0) -> np.ndarray:
    """k components of a bounded sample of profiles (`rows`, those of the smallest hashes)."""
    some = profiled.orderBy(F.xxhash64("sample", "direction", F.lit(seed)), "sample", "direction").limit(rows).select("profile").collect()
    return learning.nmf(np.array([r.profile for r in some], float), k, seed=seed)[1]


def weights(profiled: DataFrame, h: np.ndarray) -> DataFrame:
    """profiled with the weights of fixed components."""
    keyed = profiled.withColumn("_k", F.concat_ws("|", "sample", "direction"))
    return keyed.join(learning.nmf_weights(keyed, "_k", "profile", h), "_k").drop("_k")


def parts(healthy: DataFrame, share: float = 0.75, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of the undamaged gearbox; a sample's rows stay together, dealt by a hash of its name."""
    low = F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(10_000)) < round(share * 10_000)
    return healthy.where(low), healthy.where(~low)


def balanced(undamaged: DataFrame, pitted: DataFrame, seed: int = 0) -> DataFrame:
    """Test rows of both kinds: pitted samples of modes that the undamaged ones have, as many samples as there are of those."""
    shared = pitted.join(undamaged.select("rpm", "torque").distinct(), ["rpm", "torque"], "left_semi")
    drawn = clean.hashed_sample(shared.select("sample").distinct(), "sample", undamaged.select("sample").distinct().count(), seed)
    return undamaged.unionByName(shared.join(drawn, "sample", "left_semi"))


def operating_modes(profiled: DataFrame) -> DataFrame:
    """torque, rpm, mode: numbered from 1, by torque, then speed; a row per mode."""
    return profiled.select("torque", "rpm").distinct().withColumn("mode", F.row_number().over(Window.orderBy("torque", "rpm")))


def fingerprints(weighted: DataFrame) -> DataFrame:
    """Mean weights per mode and direction."""
    modes = operating_modes(weighted)
    rows = weighted.join(F.broadcast(modes.limit(MODES)) if modes.limit(MODES + 1).count() <= MODES else modes, ["torque", "rpm"])
    per = rows.select("mode", "direction", F.posexplode("weights").alias("k", "w")).groupBy("mode", "direction", "k").agg(F.avg("w").alias("w"))
    return per.groupBy("mode", "direction").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("fingerprint"))


def distances(weighted: DataFrame, prints: DataFrame) -> DataFrame:
    """sample, rpm, torque, mode, distance: cosine distance of a sample's directions, joined end to end, to every mode's."""
    joined = lambda df, keys, column: df.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("direction", column))), lambda x: x[column])).alias(column))
    own, modes = joined(weighted, ["sample", "rpm", "torque"], "weights"), joined(prints, ["mode"], "fingerprint")
    n = modes.count()
    if n > MODES:
        raise ValueError(f"{n} modes; at most {MODES} are compared with every sample")
    every = modes.agg(F.collect_list(F.struct("mode", "fingerprint")).alias("m"))  # one row of at most MODES fingerprints
    pairs = own.crossJoin(F.broadcast(every)).select("sample", "rpm", "torque", "weights", F.explode("m").alias("m"))
    return pairs.select("sample", "rpm", "torque", F.col("m.mode").alias("mode"), metrics.cosine(F.col("weights"), F.col("m.fingerprint")).alias("distance"))


def own_distances(distanced: DataFrame, modes: DataFrame) -> DataFrame:
    """Each sample's distance to its own mode (null if that mode has no fingerprint), and its level of damage from its name."""
    own = modes.select("torque", "rpm", F.col("mode").alias("own_mode"))
    per = distanced.join(own, ["torque", "rpm"], "left").groupBy("sample", "rpm", "torque").agg(F.max(F.when(F.col("mode") == F.col("own_mode"), F.col("distance"))).alias("distance"))
    level = F.coalesce(F.regexp_extract("sample", r"pitting_level_(\d)", 1).try_cast("int"), F.lit(0))
    return per.withColumns({"pitting_level": level, "pitting": F.contains(F.col("sample"), F.lit("pitting_level_"))})
