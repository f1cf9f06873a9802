"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in the tasks. The trees are fitted on at most TRAIN_ROWS labelled
rows, chosen by hash of the id: per round, gradients are summed in histograms of BINS quantile bins per
feature and node, and every tree is complete to DEPTH. Trees are flattened to arrays (feature, threshold,
leaf) in heap order, which a batch of documents walks level by level in numpy.

Cases: null and empty texts have zeros for statistics and get the score these have; with no label, or one
class only, every score is that class's share (0.5 without any); null labels and ids don't train; repeated
rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import saved
from tidewheel.llm.words import Words, chunks

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, L2 = 60_000, 80, 4, 64, 0.15, 1.0
PREDICT_AT = 0.3

#: Classes of bytes that are counted: letters a-z, A-Z, of other scripts, digits, white space, then single signs.
SIGNS = ".,;:!?|%#*&$@<>{}[]()/\\=+-_'\"~^`"
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[128:], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
for _k, _c in enumerate(SIGNS):
    _CLASS[ord(_c)] = 6 + _k
N_CLASS = 6 + len(SIGNS)
NAMES = [*(f"class_{k}" for k in range(N_CLASS)), "bytes", "words", "lines", "word_len", "word_len_sd", "distinct_words", "top_word", "repeated_word", "distinct_lines", "line_len", "upper_words", "sign_ends", "distinct_triples"]


def _share(hash_: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document, the distinct values and the most frequent one's count."""
    order = np.lexsort((hash_, doc))
    h, d = hash_[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(docs)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(h))))
    return np.bincount(d[at], minlength=docs).astype(float), top


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    docs = len(at) - 1
    size = np.diff(at)
    byte_doc = np.repeat(np.arange(docs), size)
    classes = np.bincount(byte_doc * N_CLASS + _CLASS[raw], minlength=docs * N_CLASS).reshape(docs, N_CLASS).astype(float)
    words = Words(raw, at)
    n = np.diff(words.first).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(words.first))
    h, length = words.hashes(), (words.hi - words.lo).astype(float)
    one = lambda x: np.maximum(x, 1)
    mean = np.bincount(doc, length, docs) / one(n)
    sd = np.sqrt(np.maximum(0, np.bincount(doc, length**2, docs) / one(n) - mean**2))
    distinct, top = _share(h, doc, docs)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    triples = (doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, bool)
    t = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[triples] if len(h) > 2 else h[:0]
    t_distinct, _ = _share(t, doc[: max(0, len(h) - 2)][triples] if len(h) > 2 else doc[:0], docs)
    breaks = np.bincount(byte_doc[raw == 10], minlength=docs)
    lines = breaks + 1.0
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    cut[1:] |= np.append(raw == 10, False)[: len(raw)]
    start = np.flatnonzero(cut[: len(raw)])
    line_doc = byte_doc[start] if len(raw) else np.zeros(0, np.int64)
    word_line = np.searchsorted(start, words.lo, "right") - 1 if len(start) else np.zeros(0, np.int64)
    turn = np.arange(len(h)) - np.searchsorted(word_line, word_line)
    line_hash = np.zeros(len(start), np.uint64)
    np.add.at(line_hash, word_line, h * (turn.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    l_distinct, _ = _share(line_hash, line_doc, docs)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    lower = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    shout = (upper[words.hi] - upper[words.lo] > 1) & (lower[words.hi] == lower[words.lo])
    ends = _CLASS[raw[words.hi - 1]] >= 8 if len(h) else np.zeros(0, bool)  # signs other than full stop and comma
    columns = [size, n, lines, mean, sd, distinct / one(n), top / one(n), np.bincount(doc, same, docs) / one(n), l_distinct / lines, size / lines, np.bincount(doc, shout, docs) / one(n), np.bincount(doc, ends, docs) / one(n), t_distinct / one(n - 2)]
    return np.column_stack([classes / one(size)[:, None], *columns]).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(1), 1 << 20):
                x = statistics(raw, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


@dataclass
class Boosted:
    """Complete trees in heap order: node i has children 2i+1 (value <= threshold) and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
    """Boost logistic loss on quantile-binned features."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base, inner, leaves = float(np.log(share / (1 - share))), 2**DEPTH - 1, 2**DEPTH
    if len(np.unique(y)) < 2:
        none = np.zeros((0, inner))
        return Boosted(base, none.astype(np.int64), none, np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    columns = [np.ascontiguousarray(binned[:, f]) for f in range(x.shape[1])]
    total, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            gain, where = np.full(width, 1e-9), [None] * width
            for f, column in enumerate(columns):
                key = (node - first) * BINS + column
                sums = [np.cumsum(np.bincount(key, w, width * BINS).reshape(width, BINS), 1) for w in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, -1:] for s in sums)
                score = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                score[(hl < 1) | (ht - hl < 1)] = 0
                score[:, len(edges[f]) :] = 0
                best = score.argmax(1)
                for k in np.flatnonzero(score[np.arange(width), best] > gain):
                    gain[k], where[k] = score[k, best[k]], (f, int(best[k]))
            go = np.zeros(len(y), np.int64)
            for k, split in enumerate(where):
                if split:
                    f, b = split
                    feature[first + k], threshold[first + k] = f, edges[f][b]
                    here = node == first + k
                    go[here] = columns[f][here] > b
            node = 2 * node + 1 + go
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        total += leaf[at]
        for store, value in zip(out, (feature, threshold, leaf), strict=True):
            store.append(value)
    return Boosted(base, *(np.array(s) for s in out))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Boosted:
    """Fit on labelled statistics outside the held-out fold: all of them, or those of the lowest hashes if there are more than train_rows."""
    rows = labels.select("doc_id", F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    count = rows.count()
    if count > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * 0.98 * train_rows / count))
    got = stats.join(rows, "doc_id").select("doc_id", "x", "y").limit(train_rows + train_rows // 10).toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(NAMES))
    return fit(x, got["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = saved(features(docs, id_col, text_col), "quality-stats")
    model = train(stats, labels, label_col)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), np.float32).reshape(len(x), len(NAMES))))

    out = stats.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
