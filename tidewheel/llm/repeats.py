"""Substring dedup: words covered by a repeat of SIZE words or more, found by recompression.

1. Every text is parsed by the same rounds of run and pair naming (recompression.py). Each window of SIZE words
   has an anchor, a name that its words alone decide; consecutive windows with one anchor form a stretch. A
   task emits one row per stretch: anchor, a hash of the stretch's words, document, start, windows. Anchor and hash
   come from independent hashes of the words. The anchor stands for the words under its symbol only; what a stretch has
   outside it is told apart by the 64 bits of its hash alone, and the words themselves are never compared: two different
   stretches of one anchor would be taken for equal with a chance of 2**-64 a pair.
2. Grouped by anchor: an anchor seen once can't be part of a repeat, and its stretch is done. A stretch whose
   words were seen earlier under the same anchor repeats that one as a whole. What is left is the first
   occurrence of each stretch of an anchor that has several: at the borders of repeats.
3. Only for those the windows themselves are hashed (128 bits) and the earliest of equal ones found.
4. A document's repeated windows cover the words to remove.

Anchors that a sample of 1 document in HOT_SAMPLE shows to be frequent (HOT_ANCHORS of them at most, so the
list is bounded) are salted: their stretches fall into SALTS groups each. There, one that isn't the first of
its group repeats an earlier one for certain, and the first of each group is compared window by window. The
list changes speed, not results.

Cases: a null text has no words and keeps nothing; texts of under SIZE words keep all of theirs; a repeat
inside one document counts; overlapping repeats are judged on the input, not on what is left; a null id comes
before all others; of rows that repeat an id, those with equal texts are one document, and others follow each
other in the order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import discard_path, partitions, saved, scratch_root
from tidewheel.llm.recompression import anchors, prints
from tidewheel.llm.words import SECOND, Words, chunks, spans

SIZE = 20
#: Words in a window at most: a stretch has no more windows than that, and their number is kept in six bits.
MOST = 63
HOT_SAMPLE, HOT_ANCHORS, HOT_LEAST, SALTS = 64, 4096, 64, 32


def stretches(docs: DataFrame, size: int = SIZE, hot: np.ndarray | None = None) -> DataFrame:
    """anchor, stretch, doc_id, t, place (first word * 64 + windows), hot (in that sorted list) over (doc_id, t, text)."""
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(2), 1 << 20):
                words = Words(raw, at)
                h = words.hashes(1)
                anchor, start, count = anchors(h, words.first, size)
                doc = np.searchsorted(words.first, start, "right") - 1
                whole = spans(words.hashes(2), start, start + count + size - 1, SECOND)
                ids, t = (batch.column(c).slice(i, j - i).take(pa.array(doc)) for c in range(2))
                name = anchor.view(np.int64)
                listed = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name if len(hot) else np.zeros(len(name), bool)
                place = (start - words.first[doc]) * 64 + count
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(whole.view(np.int64)), ids, t, pa.array(place.astype(np.int64)), pa.array(listed)], ["anchor", "stretch", "doc_id", "t", "place", "hot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"anchor long, stretch long, doc_id {kind}, t long, place long, hot boolean")


def judged(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, t, mark: place * 2, and 1 more if its windows are to be compared; of stretches that may repeat an earlier one."""
    sample = stretches(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_SAMPLE)) == 0), size)
    often = sample.groupBy("anchor").count().where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "anchor").limit(HOT_ANCHORS)
    hot = np.sort(np.array([r.anchor for r in often.collect()], np.int64))
    salted = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0)
    rows = stretches(docs, size, hot).select("anchor", "stretch", "doc_id", "t", (F.col("place") * 64 + salted).alias("place"))
    salt = F.col("place") % 64
    by_anchor, by_stretch = Window.partitionBy("anchor", "salt"), Window.partitionBy("anchor", "salt", "stretch")
    dealt = rows.withColumn("salt", salt)
    here = F.struct("doc_id", "t", "place")
    seen = dealt.withColumns({"_first": F.min(here).over(by_stretch), "_lo": F.min("stretch").over(by_anchor), "_hi": F.max("stretch").over(by_anchor), "_n": F.count(F.lit(1)).over(by_anchor)})
    first = here.eqNullSafe(F.col("_first"))
    seen = seen.where((F.col("salt") > 0) | ((F.col("_n") > 1) & (~first | (F.col("_lo") != F.col("_hi")))))
    return seen.select("doc_id", "t", (F.shiftright("place", 6) * 2 + first.cast("long")).alias("mark"))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _covered(n: int, start: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a repeated window, given first windows and numbers of windows."""
    edge = np.zeros(n + 1, np.int64)
    ok = start < n
    np.add.at(edge, start[ok], 1)
    np.add.at(edge, np.minimum(n, start[ok] + count[ok] + size - 1), -1)
    return np.cumsum(edge)[:n] > 0


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin (and the end); null rows are empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def cover(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by a blank)."""
    if not 1 <= size <= MOST:
        raise ValueError(f"windows have 1 to {MOST} words, not {size}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    repeated = bool(docs.groupBy(id_col).count().where("count > 1").head(1))
    docs = docs.select(F.col(id_col).alias("doc_id"), (F.xxhash64(text_col) if repeated else F.lit(0).cast("long")).alias("t"), F.col(text_col).alias("text"))
    key = F.concat(F.col("t").cast("string"), F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("n"))).alias("key")  # a null id too has a key
    marks = judged(docs, size).groupBy("doc_id", "t").agg(F.collect_set("mark").alias("marks")).select(key, "marks")
    marked = docs.select(key, "doc_id", "t", "text").join(marks, "key", "left").select("key", "doc_id", "t", "text", "marks")
    names = ["key", "doc_id", "t", "n_words", "n_removed", "kept_sha256", "text", "marks", "at", "p1", "p2"]
    schema = f"key string, doc_id {kind}, t long, n_words long, n_removed long, kept_sha256 string, text string, marks array<long>, at array<int>, p1 array<long>, p2 array<long>"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(3), 1 << 20):
                mark, begin = _lists(batch.column(4).slice(i, j - i))
                doc = np.repeat(np.arange(j - i), np.diff(begin))
                wait = np.zeros(j - i, bool)
                wait[doc[mark & 1 == 1]] = True
                body = [raw[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                n_words, removed, digest = np.zeros(j - i, np.int64), [None] * (j - i), [None] * (j - i)
                for d in np.flatnonzero(~wait):
                    w = body[d].split()  # bytes.split() separates at exactly the six white-space bytes
                    n_words[d], own = len(w), mark[begin[d] : begin[d + 1]]
                    gone = _covered(len(w), own >> 7, (own >> 1) & 63, size) if len(own) else None
                    removed[d], digest[d] = (int(gone.sum()), _digest([x for x, g in zip(w, gone.tolist(), strict=True) if not g])) if gone is not None else (0, _digest(w))
                some = np.flatnonzero(wait)
                rank = np.cumsum(wait) - 1
                words = Words(np.frombuffer(b"".join(body[d] for d in some), np.uint8), np.concatenate([[0], np.cumsum([len(body[d]) for d in some])]).astype(np.int64))
                n_words[some] = np.diff(words.first)
                open_ = mark & 1 == 1
                start, count, owner = mark[open_] >> 7, (mark[open_] >> 1) & 63, rank[doc[open_]]
                window = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                flat = np.unique(window + words.first[np.repeat(owner, count)]) if len(start) else np.zeros(0, np.int64)
                flat = flat[flat + size <= words.first[np.searchsorted(words.first, flat, "right")]] if len(flat) else flat
                p1, p2 = prints(words.hashes(1), words.hashes(2), flat, flat + size)
                owner = np.searchsorted(words.first, flat, "right") - 1
                held = np.concatenate([[0], np.cumsum(np.bincount(some[owner], minlength=j - i) if len(flat) else np.zeros(j - i, np.int64))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(held), pa.array(v)) for v in ((flat - words.first[owner]).astype(np.int32), p1.view(np.int64), p2.view(np.int64))]
                own = np.concatenate([[0], np.cumsum(np.where(wait, np.diff(begin), 0))]).astype(np.int32)
                kept_marks = pa.ListArray.from_arrays(pa.array(own), pa.array(mark[wait[doc]].astype(np.int64)))
                text = pa.array([body[d].decode() if w else None for d, w in enumerate(wait)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(n_words), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), text, kept_marks, *lists], names)

    # bucketed by the key its rows are dealt by already, so that the texts that wait are not shuffled again
    table, path = f"tidewheel_repeats_{uuid.uuid4().hex}", f"{scratch_root(spark)}/tidewheel/repeats-{uuid.uuid4().hex}"
    try:
        marked.mapInArrow(settle, schema).write.bucketBy(partitions(spark), "key").option("compression", "zstd").option("path", path).saveAsTable(table)
        return saved(_closed(spark.table(table), key, kind, size), "repeat-cover")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard_path(spark, path)


def _closed(stage: DataFrame, key: Column, kind: str, size: int) -> DataFrame:
    """The settled documents, and those that wait with their windows compared."""
    waiting = stage.where("n_removed is null")
    shown = waiting.select("doc_id", "t", F.explode(F.arrays_zip("at", "p1", "p2")).alias("w")).select("doc_id", "t", F.col("w.at").alias("start"), F.col("w.p1").alias("p1"), F.col("w.p2").alias("p2"))
    here = F.struct("doc_id", "t", "start")
    firsts = shown.groupBy("p1", "p2").agg(F.min(here).alias("_first"), F.max(here).alias("_last")).where("not _first <=> _last").drop("_last")
    late = shown.join(firsts, ["p1", "p2"]).where(~here.eqNullSafe(F.col("_first")))
    late = late.groupBy("doc_id", "t").agg(F.collect_set("start").alias("late")).select(key, "late")
    waiting = waiting.select("key", "doc_id", "n_words", "text", "marks")
    closing = waiting.join(late, "key", "left").select("doc_id", "n_words", "text", "marks", "late")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest = [], []
            mark, begin = _lists(batch.column(3))
            late, after = _lists(batch.column(4))
            for d, text in enumerate(batch.column(2)):
                w = (text.as_py() or "").encode().split()
                own, more = mark[begin[d] : begin[d + 1]], late[after[d] : after[d + 1]].astype(np.int64)
                own = own[own & 1 == 0]
                gone = _covered(len(w), np.concatenate([own >> 7, more]), np.concatenate([(own >> 1) & 63, np.ones(len(more), np.int64)]), size)
                removed.append(int(gone.sum()))
                digest.append(_digest([x for x, g in zip(w, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    closed = closing.mapInArrow(close, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    return stage.where("n_removed is not null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(closed)
