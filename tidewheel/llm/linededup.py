"""Line dedup that can be undone: exact reference counts per line key, fronted by sharded cuckoo filters.

State: `refs`, one row per (key, document, text) with the line positions, and one cuckoo filter per shard holding
every live key. insert() asks the filters first: keys they don't know are new for certain and counted within the
batch; the rest are looked up in refs, those found are recounted. Every key that refs don't hold is put into the
filters, so delete(), which removes a document's references, can take the keys that lose their last one out of
them without taking another key's fingerprint. `several` has the keys that several documents hold, kept up by
insert() and delete(), which recount only the keys they touch; drops() joins refs with it.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least MIN_CHARS
code points found in several documents lose their lines everywhere but in the smallest document id.

Cases: a null or empty text is one empty line; repeated lines of one document count as one reference and go
or stay together; rows repeating an id are one document for the counts, and each loses lines of its own text only;
a null id takes part as the smallest, and can be deleted; deleting from an index without documents, or ids it
doesn't hold, changes nothing; other columns are ignored; an empty table gives no rows.

Scale: keys are reduced to (key, document) before any shuffle, and to one row per key before a filter shard
sees them, so a line held by a third of the documents is one row there; shards hold SHARD_KEYS keys each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import SPACES, ascii_lower, body, discard, saved

MIN_CHARS = 10
SHARD_KEYS = 200_000
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, either of which finds the other."""

    def __init__(self, keys: int = 64, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _print(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.int64).view(np.uint64)
        return (h % np.uint64(65535) + np.uint64(1)).astype(np.uint16), ((h >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one = self._print(keys)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[self._other(one, fp)] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 400) -> bool:
        """Keys that aren't in it yet. False if they don't fit; the filter is then to be built anew, larger."""
        fp, at = self._print(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(rounds):
            if not len(fp):
                return True
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            start = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            free = self.table[at] == 0
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            fits = rank < free.sum(1)
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at, rank = fp[~fits], at[~fits], rank[~fits]
            if turn == 0:
                at = self._other(at, fp)
            elif len(fp):  # the first of each full bucket takes a slot, whose holder moves on to its other bucket
                first = np.r_[True, at[1:] != at[:-1]]
                full = np.flatnonzero(first & (self.table[at] != 0).all(1))
                s = rng.integers(0, SLOTS, len(full))
                held = self.table[at[full], s].copy()
                self.table[at[full], s] = fp[full]
                fp[full] = held
                at[full] = self._other(at[full], held)
        return not len(fp)

    def remove(self, keys: np.ndarray) -> None:
        """Keys that are in it: one fingerprint of each goes."""
        fp, one = self._print(keys)
        for f, a, b in zip(fp, one, self._other(one, fp), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == f)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


def line_refs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key (128 bits of SHA-256), doc_id, t (hash of the text), lines (positions): a row per key, document and text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.posexplode(F.split(body(text_col), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "t", "pos", F.btrim(ascii_lower(F.col("line")), F.lit(SPACES)).alias("_key")).where(F.char_length("_key") >= min_chars)
    digest = F.substring(F.unhex(F.sha2(F.col("_key").cast("binary"), 256)), 1, 16)
    return keys.groupBy(digest.alias("key"), "doc_id", "t").agg(F.collect_list("pos").alias("lines"))


class LineIndex:
    """Documents' lines under exact reference counts; refs and filters are tables in the shared folder."""

    def __init__(self, spark: SparkSession, shard_keys: int = SHARD_KEYS):
        self.spark, self.shard_keys, self.shards = spark, shard_keys, 0
        self.refs: DataFrame | None = None
        self.several: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _prints(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return keys.select(F.pmod(F.shiftright(h, 40), F.lit(self.shards)).cast("int").alias("shard"), h.alias("print"), "key")

    def insert(self, docs: DataFrame, **columns) -> DataFrame:
        """Add documents whose ids are not in the index. Returns the keys that the filters took for known ones.

        Only those are looked up in the exact references and recounted with them if they are there; all other keys
        are counted within the batch. The filters get every key that has no references, false positives included.
        """
        new = saved(line_refs(docs, **columns), "line-refs")
        if not self.shards:
            self.shards = max(1, -(-new.select(F.approx_count_distinct("key")).first()[0] // self.shard_keys))
        keys = new.select("key").distinct()
        if self.refs is None:
            flagged, fresh, touched = self._prints(keys).limit(0), keys, new
            self.filters = self.spark.createDataFrame([], "shard int, data binary")
        else:
            flagged = saved(self._asked(keys), "line-flagged")
            held = saved(self.refs.join(flagged.select("key"), "key", "left_semi"), "line-known")
            known = held.select("key").distinct()
            fresh, touched = keys.join(known, "key", "left_anti"), held.unionByName(new)
            self.several = self.several.join(known, "key", "left_anti")

        def add(key: tuple, old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
            box = CuckooFilter.load(old["data"].iloc[0]) if len(old) else CuckooFilter(len(fresh))
            data = box.dump() if box.insert(fresh["print"].to_numpy(np.int64)) else b""  # too full: built anew from the exact table
            return pd.DataFrame({"shard": [key[0]], "data": [data]})

        done = saved(self.filters.groupBy("shard").cogroup(self._prints(fresh).drop("key").groupBy("shard")).applyInPandas(add, "shard int, data binary"), "line-filters")
        again = _several(touched)
        self.several = saved(again if self.several is None else self.several.unionByName(again), "line-counts")  # apart, so that a skewed join can be split
        self.refs = new if self.refs is None else saved(self.refs.unionByName(new), "line-refs")
        self.filters = self._rebuilt(done)
        return flagged.select("shard", "print")

    def _rebuilt(self, done: DataFrame) -> DataFrame:
        """The filters of `done`; shards that overflowed are built anew from the exact table."""
        good, full = done.where("length(data) > 0").select("shard", "data"), done.where("length(data) = 0").select("shard")
        if not full.head(1):
            return good

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            h, size = rows["print"].to_numpy(np.int64), 2 * len(rows)
            while not (box := CuckooFilter(size)).insert(h):
                size *= 2
            return pd.DataFrame({"shard": [key[0]], "data": [box.dump()]})

        again = self._prints(self.refs.select("key").distinct()).drop("key").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(build, "shard int, data binary")
        return saved(good.unionByName(again), "line-filters")

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out again: their references, and from the filters the keys nobody else holds."""
        if self.refs is None:
            return
        ids = ids.select(F.col(id_col).alias("_id")).distinct()
        theirs = F.col("doc_id").eqNullSafe(F.col("_id"))
        left = saved(self.refs.join(ids, theirs, "left_anti"), "line-refs")
        touched = saved(self.refs.join(ids, theirs, "left_semi").select("key").distinct(), "line-touched")
        again = saved(left.join(touched, "key", "left_semi"), "line-known")
        gone = self._prints(touched.join(again.select("key").distinct(), "key", "left_anti")).drop("key")
        self.several = saved(self.several.join(touched, "key", "left_anti").unionByName(_several(again)), "line-counts")

        def drop(key: tuple, known: pd.DataFrame, dead: pd.DataFrame) -> pd.DataFrame:
            box = CuckooFilter.load(known["data"].iloc[0])
            box.remove(dead["print"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [key[0]], "data": [box.dump()]})

        self.filters = saved(self.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInPandas(drop, "shard int, data binary"), "line-filters")
        self.refs = left

    def _asked(self, keys: DataFrame) -> DataFrame:
        """The keys, with shard and print, that the filters have."""

        def probe(key: tuple, known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            seen = CuckooFilter.load(known["data"].iloc[0]).contains(asked["print"].to_numpy(np.int64)) if len(known) else np.zeros(len(asked), bool)
            return asked[seen]

        prints = self._prints(keys)
        return self.filters.groupBy("shard").cogroup(prints.groupBy("shard")).applyInPandas(probe, prints.schema)

    def maybe_known(self, docs: DataFrame, **columns) -> DataFrame:
        """The (shard, print) of these documents' keys that the filters have: no key of the index is missed."""
        return self._asked(line_refs(docs, **columns).select("key").distinct()).select("shard", "print")

    def counts(self) -> DataFrame:
        """key, n_docs, first_doc over the live references."""
        return _counted(self.refs)

    def drops(self) -> DataFrame:
        """doc_id, t, dropped (line positions): the lines that lose to a smaller document id."""
        lost = self.refs.join(self.several, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        return lost.groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("dropped"))


def _first(refs: DataFrame):
    """The smallest document of a key; a null one is smaller than all others."""
    return F.when(F.max(F.col("doc_id").isNull()), F.lit(None).cast(refs.schema["doc_id"].dataType)).otherwise(F.min("doc_id"))


def _counted(refs: DataFrame) -> DataFrame:
    per = refs.select("key", "doc_id").distinct()
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), _first(refs).alias("first_doc"))


def _several(refs: DataFrame) -> DataFrame:
    """key, first_doc of the keys that several documents hold."""
    known = F.count("doc_id")
    many = (F.min("doc_id") != F.max("doc_id")) | ((known > 0) & (known < F.count(F.lit(1))))
    return refs.groupBy("key").agg(_first(refs).alias("first_doc"), many.alias("_many")).where("_many").drop("_many")


def dedup_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (docs' columns as a struct), doc_id, n_lines, n_dropped, kept (the text without its dropped lines)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.split(body(text_col), "\n", -1).alias("lines"))
    gone = drops.select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t"), "dropped")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup_lines() against an index of these documents themselves."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs, id_col=id_col, text_col=text_col)
    return dedup_lines(docs, index.drops(), id_col, text_col)
