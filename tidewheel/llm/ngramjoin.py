"""Similarity self-join on word shingles with Bayesian candidate pruning.

Documents are sets of 5-word shingles; a link is a Jaccard similarity of THRESHOLD or more.

1. Sign: every document's distinct shingles give BANDS x ROWS MinHash values. Documents with equal sets form a
   copy class, one vertex from here on; copies are never expanded into pairs.
2. Candidates: vertices that share a band's values share a bucket. First each bucket's members are compared with
   its smallest member, which joins most of a group at the price of one pair a member. Then, in buckets that
   still hold several parts, every member is compared with those of the other parts, in tiles of BUCKET x BUCKET.
   So any two members of a bucket end up in one part or were compared and dropped.
3. Prune: a comparison takes STEP MinHash values at a time. With a uniform prior, the similarity's posterior
   after m matches in n is Beta(m+1, n-m+1); once P(similarity >= THRESHOLD) is under TOLERANCE the pair is dropped.
4. Verify exactly: surviving pairs cut the vertices into small neighbourhoods. Within each, all pairs are verified
   on the full shingle sets (two independent 64-bit hashes of a shingle's bytes must agree), in tiles bounded in
   documents and in shingles, that yield one row per document (its number of links and the root of its linked
   part), not one per pair.
5. Groups are the connected components of verified links.

A link of similarity s is missed if its documents share no bucket, with probability (1 - s**ROWS)**BANDS: 7.6e-6 at
0.8, under 1e-9 from 0.85 on, or if pruning is wrong, with probability TOLERANCE, and if then no third
document joins the two neighbourhoods.

Scale: step 2 reads a bucket's members once per tile only where it holds several parts, so its price is the square
of the *unlike* members of one bucket, and step 4's the square of a neighbourhood's different texts, both over
the tile's size; copies cost nothing.

Cases: documents of fewer than 5 words have one shingle, all their words; null, empty and blank texts have
none and are linked to nothing, not even to each other; rows that repeat an id are judged each by its own text; a
null id takes its copies' group if there are any, and otherwise has a null one; ties of similarity don't matter; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidewheel.llm.common import discard, saved
from tidewheel.llm.graph import components
from tidewheel.llm.words import FIRST, SECOND, U, Words, chunks, mix, spans

SHINGLE, THRESHOLD = 5, Fraction(4, 5)
BANDS, ROWS = 64, 8
#: MinHash values kept for pruning, as 16 bits each, and how many are compared at a time.
KEPT, STEP, TOLERANCE = 256, 32, 1e-6
#: Documents, and shingles, on a side of a verified tile.
TILE, TILE_SHINGLES = 512, 1 << 19
#: Members of a bucket on a side of a tile of comparisons.
BUCKET = 512

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_C = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * U(2) + U(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, end to end, as two independent hashes (sorted by the first), and where each text's begin (and the end)."""
    words = Words(raw, at)
    n = np.diff(words.first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), m)
    lo = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(words.first[:-1], m)
    hi = np.minimum(lo + k, words.first[1:][doc])
    h = spans(words.hashes(1), lo, hi, FIRST)
    order = np.lexsort((h, doc))
    g = spans(words.hashes(2), lo, hi, SECOND)[order]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], g[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def minhashes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima (uint32) of each non-empty set."""
    x = (h >> U(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(x * a + b, begin) for a, b in zip(_A, _B, strict=True)], 1)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, c1, c2 (the set's identity), n, bands, sketch; n is 0 and bands and sketch null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(2), 1 << 20):
                h, g, begin = shingle_sets(raw, at)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                c1, c2 = (np.zeros(j - i, np.int64) for _ in range(2))
                bands, sketch = [None] * (j - i), [None] * (j - i)
                if len(some):
                    start = begin[some]
                    c1[some] = np.add.reduceat(mix(h), start).view(np.int64)
                    c2[some] = np.add.reduceat(mix(g), start).view(np.int64)
                    low = minhashes(h, start)
                    key = mix((low.reshape(len(some), BANDS, ROWS).astype(np.uint64) * _C).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    for r, d in enumerate(some):
                        bands[d], sketch[d] = key[r], low[r, :KEPT].astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(c1), pa.array(c2), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "text_hash", "c1", "c2", "n", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, c1 long, c2 long, n long, bands array<long>, sketch binary")


@lru_cache(8)
def least_matches(kept: int, step: int, threshold: Fraction, tolerance: float) -> list[tuple[int, int]]:
    """(n, fewest matches in n with which P(similarity >= threshold) is still `tolerance` or more).

    Under a uniform prior that probability is the chance of at most m successes in n + 1 trials of `threshold`.
    """
    t, out = float(threshold), []
    for n in range(step, kept + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two sketch matrices stay candidates, comparing STEP more values of those left at a time."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in least_matches(KEPT, STEP, THRESHOLD, TOLERANCE):
        matches[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series) -> pd.Series:
    matrix = lambda s: np.frombuffer(b"".join(s), "<u2").reshape(len(s), KEPT)
    return pd.Series(survivors(matrix(a), matrix(b)))


def _across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between members of a tile, or of two, that are of different parts: one for each two parts that have any."""
    _, i, j = key
    v, part, tile = rows["v"].to_numpy(), rows["part"].to_numpy(), rows["tile"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(rows), KEPT)
    others, a, b, met = np.flatnonzero(tile == j), [], [], {}
    for k in np.flatnonzero(tile == i).tolist():
        known = met.setdefault(part[k], [part[k]])
        rest = others[others > k] if i == j else others
        rest = rest[~np.isin(part[rest], known)]
        rest = rest[survivors(np.broadcast_to(sketch[k], (len(rest), KEPT)), sketch[rest])]
        new, first = np.unique(part[rest], return_index=True)
        known += new.tolist()
        a += [v[k]] * len(new)
        b += v[rest[first]].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def neighbourhoods(bands: DataFrame, sketches: DataFrame) -> DataFrame:
    """v, label: vertices that pairs sharing a bucket and surviving pruning join, over others or directly."""
    rows = bands.select("v", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("v").alias("lead"), F.max("v").alias("_last"), F.count(F.lit(1)).alias("n")).where("lead != _last").drop("_last")
    rows = saved(rows.join(shared, "key"), "join-buckets")
    pairs = rows.where("v != lead").select("lead", "v").distinct()
    pairs = pairs.join(sketches.withColumnRenamed("sketch", "_s"), "v").join(sketches.select(F.col("v").alias("lead"), F.col("sketch").alias("_t")), "lead")
    led = components(pairs.where(_likely("_s", "_t")).select(F.col("lead").alias("a"), F.col("v").alias("b")))
    # buckets of two are settled; of the others, those that the leaders left in several parts are compared across them
    parts = rows.where("n > 2").select("v", "key").join(led, "v", "left").select("v", "key", F.coalesce("label", "v").alias("part"))
    parts = saved(parts, "join-parts")
    several = parts.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"), F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("tiles")).where("_lo != _hi").select("key", "tiles")
    left = parts.join(several, "key").join(sketches, "v").withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    left = left.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"i": F.least("tile", "_o"), "j": F.greatest("tile", "_o")})
    across = left.select("key", "i", "j", "v", "part", "tile", "sketch").groupBy("key", "i", "j").applyInPandas(_across, "a long, b long").distinct()
    label = lambda c: led.select(F.col("v").alias(c), F.col("label").alias(f"_{c}"))
    across = across.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(across)
    all_ = led.select("v", F.col("label").alias("old")).unionByName(joined.select("v", F.col("v").alias("old"))).distinct()
    merged = all_.join(joined.select(F.col("v").alias("old"), "label"), "old", "left").select("v", F.coalesce("label", "old").alias("label"))
    out = saved(merged.groupBy("v").agg(F.min("label").alias("label")), "join-blocks")
    discard(rows, parts, led, joined)
    return out


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a tile, or between two, of documents with whole shingle sets; root joins what is linked."""
    _, i, j = key
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    n = np.array([len(s) for s in sets], np.int64)
    side = rows["tile"].to_numpy() == i
    doc = np.repeat(np.arange(len(sets)), n)
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = np.concatenate([np.frombuffer(s, np.uint64) for s in rows["again"]])
    second = np.zeros(len(value), np.uint64)
    second[column] = again
    if (second[column] != again).any():  # different shingles with one first hash: told apart by the second
        _, column, times = np.unique(np.stack([np.concatenate(sets), again], 1), axis=0, return_inverse=True, return_counts=True)
        column = column.reshape(-1)
    use = times[column] > 1
    doc, column = doc[use], (np.cumsum(times > 1) - 1)[column[use]]
    left = np.flatnonzero(side)
    right = left if i == j else np.flatnonzero(~side)
    common = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[doc[a:b], column[a:b] - start] = 1
        common += (dense[left] @ dense[right].T).astype(np.int64)
    linked = common * THRESHOLD.denominator >= (n[left][:, None] + n[right][None, :] - common) * THRESHOLD.numerator
    if i == j:
        np.fill_diagonal(linked, False)
    copies = rows["copies"].to_numpy(np.int64)
    links = np.zeros(len(sets), np.int64)
    links[left] = linked @ copies[right]
    if i != j:
        links[right] = linked.T @ copies[left]
    full = np.zeros((len(sets), len(sets)), bool)
    full[np.ix_(left, right)] = linked
    full |= full.T
    root = np.arange(len(sets))
    while True:
        near = np.where(full, root[None, :], len(sets)).min(1, initial=len(sets))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            break
        root = new
    v = rows["v"].to_numpy()
    return pd.DataFrame({"v": v, "links": links, "root": v[root]})


def exact_links(docs: DataFrame, blocks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, links, root from verifying all pairs within each block (v, label, first, c1, c2, n, copies)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(0), 1 << 20):
                h, g, begin = shingle_sets(raw, at)
                c1, c2 = (np.array([mix(x[a:b]).sum(dtype=np.uint64) for a, b in zip(begin, begin[1:], strict=False)], np.uint64).view(np.int64) for x in (h, g))
                # of rows with one id, those of the class: a text that the id has elsewhere goes
                own = np.flatnonzero((c1 == batch.column(1).slice(i, j - i).to_numpy()) & (c2 == batch.column(2).slice(i, j - i).to_numpy()))
                cut = lambda x: pa.array([x[begin[d] : begin[d + 1]].tobytes() for d in own], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(pa.array(own)) for c in range(3, 7)), cut(h), cut(g)], ["v", "label", "copies", "tiles", "shingles", "again"])

    number = F.count(F.lit(1))
    sizes = blocks.groupBy("label").agg(number.alias("_n"), F.greatest(F.ceil(number / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")).where("_n > 1").drop("_n")
    wanted = blocks.join(sizes, "label").select("first", "c1", "c2", "v", "label", "copies", "tiles")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    if wanted.join(texts.groupBy("_id").agg(number.alias("_n")).where("_n > 1"), F.col("first").eqNullSafe(F.col("_id")), "left_semi").head(1):
        texts = texts.dropDuplicates()
    sets = texts.join(wanted, F.col("_id").eqNullSafe(F.col("first"))).select("text", "c1", "c2", "v", "label", "copies", "tiles").mapInArrow(whole, "v long, label long, copies long, tiles int, shingles binary, again binary")
    sets = sets.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    paired = sets.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = paired.withColumns({"i": F.least("tile", "_o"), "j": F.greatest("tile", "_o")})
    return paired.select("label", "i", "j", "v", "tile", "copies", "shingles", "again").groupBy("label", "i", "j").applyInPandas(_tile, "v long, links long, root long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of its group of linked documents), n_links (documents similar to it), copy_of (smallest id with an equal shingle set), n_shingles, text_hash."""
    signed = saved(sign(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "join-signed")
    worded = signed.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "row"))
    classes = worded.groupBy("c1", "c2", "n").agg(least.alias("_least"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("c1", "c2", "n", "copies", F.col("_least.doc_id").alias("first"), F.col("_least.row").alias("row"))
    classes = saved(classes.withColumn("v", F.monotonically_increasing_id()), "join-classes")  # numbers hold once they are written
    reps = worded.select("row", "bands", "sketch").join(classes.select("row", "v"), "row")
    sketches = saved(reps.select("v", "sketch"), "join-sketches")
    blocks = neighbourhoods(reps.select("v", "bands"), sketches).join(classes.drop("row"), "v")
    checked = saved(exact_links(docs, blocks, id_col, text_col), "join-checked")
    links = checked.groupBy("v").agg(F.sum("links").alias("_links"))
    groups = components(checked.where("v != root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(links, "v", "left").join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = per_class.groupBy("label").agg(F.min("first").alias("class_id"))
    per_class = per_class.join(least, "label").select("c1", "c2", F.col("first").alias("copy_of"), "class_id", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "text_hash", "c1", "c2", "n").join(per_class, ["c1", "c2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.col("n").alias("n_shingles"), "text_hash")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, the smallest id's, of each group; rows that repeat an id and its text are one document."""
    stay = ngram_join(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_stay"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]) & (F.xxhash64(docs[text_col]) == stay["_hash"]), "left_semi")
