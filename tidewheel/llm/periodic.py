"""Periodic runs of words: maximal stretches that repeat a block of words over and over.

Each document's words are sorted as suffixes (prefix doubling, whose ranks are kept per level) with the lengths of
common prefixes between neighbours: an enhanced suffix array, whose LCP intervals stand for the inner nodes of the
suffix tree without any node being made. For an interval of value p, a suffix i of any child but the largest shows a
branching tandem repeat of period p where suffix i + p or i - p lies in the same interval but in another child, a
look-up in the inverse array. A branching tandem repeat ends where its run ends; rotating it to the left as long as the
words agree, in steps of powers of two on the kept ranks, gives the run's start. Squares of a run's own multiples of
its period end and start at the same places and merge into the one of the smallest period.

A task takes some documents at a time, WORDS words together or one document; work is n log n in the words, whatever
they repeat. A single document is held whole by its task, at about 100 bytes a word.

Cases: a null or blank text has no words and no run; a null id is carried and edited by no rewrite; rows that repeat
an id are judged each by itself; ties of the best run go to the smallest start, then period; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.words import utf8

#: Words sorted together, at least one document.
WORDS = 200_000
#: Shortest run, and how many times it holds its period at least.
LEAST, TIMES = 6, 4

Rewrite = Callable[[object, list[bytes]], list[bytes]]


class SuffixArray:
    """order, place (its inverse), lcp with the neighbour before, and levels: ranks by the first 2**k symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        here = np.arange(n)
        order = np.argsort(symbols)
        new = np.ones(n, bool)
        new[1:] = symbols[order[1:]] != symbols[order[:-1]]
        head = np.maximum.accumulate(np.where(new, here, 0))
        rank = np.empty(n, np.int64)
        rank[order] = head
        parted, levels, step = np.zeros(n, np.int8), [rank.astype(np.int32)], 1
        while True:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(tied):
                break
            who = order[tied]
            pair = head[tied] * n + rank[who + step]
            by = np.argsort(pair)
            order[tied], pair = who[by], pair[by]
            parts = np.ones(len(tied), bool)
            parts[1:] = pair[1:] != pair[:-1]
            fresh = tied[parts & ~new[tied]]
            parted[fresh], new[fresh] = len(levels), True
            head = np.maximum.accumulate(np.where(new, here, 0))
            rank[order[tied]] = head[tied]
            levels.append(rank.astype(np.int32))
            step *= 2
        self.order, self.place, self.levels = order, rank, levels
        self.lcp = np.zeros(n, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            j = np.flatnonzero(parted > k)
            same = levels[k][order[j - 1] + self.lcp[j]] == levels[k][order[j] + self.lcp[j]]
            self.lcp[j[same]] += 1 << k

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols right before the places a and b > a agree."""
        back = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            at = a - back - (1 << k)
            ok = at >= 0
            ok[ok] = self.levels[k][at[ok]] == self.levels[k][(b - back - (1 << k))[ok]]
            back[ok] += 1 << k
        return back


def _smaller(lcp: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after each j where lcp is smaller, by minima over powers of two."""
    ends = np.flatnonzero(np.append(lcp, 0) == 0)
    span = int(np.diff(ends).max(initial=1))
    sides = []
    for values, at in ((lcp, j), (np.append(lcp, 0)[::-1], len(lcp) - j)):  # the second one mirrored, with an end of its own
        low, width = [values], 1
        while width < span:
            more = low[-1].copy()
            more[width:] = np.minimum(low[-1][width:], low[-1][:-width])
            more[:width] = 0
            low.append(more)
            width *= 2
        to, own = at - 1, values[at]
        for k in range(len(low) - 1, -1, -1):
            to = np.where(low[k][to] >= own, to - (1 << k), to)
        sides.append(to)
    return sides[0], len(lcp) - sides[1]


def branching_tandems(s: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that the next symbol doesn't carry on."""
    n, j = len(s.order), np.flatnonzero(s.lcp > 0)
    if not len(j):
        return j, j
    left, right = _smaller(s.lcp, j)
    by = np.argsort(left * (s.lcp.max() + 1) + s.lcp[j], kind="stable")
    j, left, right = j[by], left[by], right[by]
    first = np.ones(len(j), bool)
    first[1:] = (left[1:] != left[:-1]) | (s.lcp[j[1:]] != s.lcp[j[:-1]])
    interval = np.cumsum(first) - 1
    lead, last = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(j)) - 1
    m = len(lead)
    # children of an interval: from its left end to its first cut, from cut to cut, and to its right end
    lo, hi, of = np.empty(len(j) + m, np.int64), np.empty(len(j) + m, np.int64), np.empty(len(j) + m, np.int64)
    at = np.arange(len(j)) + interval
    lo[at + 1], lo[at[lead]], hi[at], hi[at[last] + 1] = j, left[lead], j, right[last]
    of[at], of[at[last] + 1] = interval, np.arange(m)
    size = hi - lo
    child = at[lead]
    big = np.flatnonzero(size == np.maximum.reduceat(size, child)[of])
    big = big[np.unique(of[big], return_index=True)[1]]
    small = np.ones(len(lo), bool)
    small[big] = False
    lo, hi, of = lo[small], hi[small], of[small]
    count = hi - lo
    row = np.repeat(np.arange(len(lo)), count)
    member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    i, p = s.order[member], s.lcp[j[lead]][of[row]]
    a, b, c, d = left[lead][of[row]], right[lead][of[row]], lo[row], hi[row]
    found = []
    for other, start in ((i + p, i), (i - p, i - p)):
        ok = (other >= 0) & (other < n)
        where = s.place[np.where(ok, other, 0)]
        ok &= (where >= a) & (where < b) & ((where < c) | (where >= d))
        found.append(start[ok] * np.int64(n) + p[ok])
    both = np.unique(np.concatenate(found))
    return both // n, both % n


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of the runs, by start, then period; the last symbol occurs once."""
    s = SuffixArray(symbols)
    at, p = branching_tandems(s)
    start = at - s.shared_before(at, at + p)
    length = at + 2 * p - start
    ok = length >= np.maximum(least, times * p)
    start, length, p = start[ok], length[ok], p[ok]
    by = np.lexsort((p, length, start))
    start, length, p = start[by], length[by], p[by]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[one], length[one], p[one]
    by = np.lexsort((p, start))
    return start[by], length[by], p[by]


def best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Index of the run of the greatest exact length / period; ties to the smallest start, then period."""
    about = length / period
    near = np.flatnonzero(about >= about.max() * (1 - 1e-12)).tolist()
    return min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k]))


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and total + sizes[j] <= WORDS:
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def _judged(docs: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each document; documents are sorted together but share no symbol."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(docs)))}
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.empty(int(ends[-1]) + 1, np.int64)
    word = np.ones(len(symbols), bool)
    word[ends] = False
    symbols[word] = np.fromiter(map(numbers.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    symbols[word] += np.repeat(np.arange(len(docs)) * (len(numbers) + 1), sizes)
    symbols[ends] = np.arange(len(docs)) * (len(numbers) + 1) + len(numbers)
    start, length, period = runs_of(symbols, least, times)
    cut = np.searchsorted(start, np.append(0, ends + 1))
    for d, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        yield start[a:b] - (ends[d] - sizes[d]), length[a:b], period[a:b]


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join(w for w, n in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not n)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), best (one of them) and collapsed
    (the words that no run holds after its first period, joined by blanks).

    A run has `least` words and `times` times its period at least. `rewrite` gives, for an id and its words, the words
    to judge in their place; it isn't asked for null ids or empty texts.
    """
    if times < 2 or least < 2:
        raise ValueError("a run holds its period twice and two words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            data, ids = memoryview(raw), batch.column(0)
            sizes = np.diff(at).tolist()
            for i, j in _groups([1 + n // 4 for n in sizes]):
                words = [bytes(data[at[k] : at[k + 1]]).split() for k in range(i, j)]  # bytes.split() parts at exactly the six white-space bytes
                if rewrite is not None:
                    words = [rewrite(x, w) if w and x is not None else w for x, w in zip(ids.slice(i, j - i).to_pylist(), words, strict=True)]
                found = list(_judged(words, least, times))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in range(3)], fields=list(run)),
                )
                top = [dict(zip(("start", "length", "period"), (int(f[c][k]) for c in range(3)), strict=True)) if len(f[0]) and (k := best(*f)) >= 0 else None for f in found]
                text = pa.array([_kept(w, *f).decode() for w, f in zip(words, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(top, run), text], ["doc_id", "n_words", "runs", "best", "collapsed"])

    span = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, f"doc_id {kind}, n_words long, runs array<{span}>, best {span}, collapsed string")
