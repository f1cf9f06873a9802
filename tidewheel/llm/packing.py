"""Packing documents into sequences of a fixed token length by a swap-based local search.

Documents are tokenised whole, closed by one end token and, only if longer than a sequence, cut into full
pieces, the remainder first. Pieces are dealt by hash into groups of about GROUP_PIECES. Inside a group, first fit
makes the bins to start from. The local search then takes the least filled bin that still can and gives one or two of its
pieces to another underfull bin, against one of that bin's pieces or none, by the exchange that raises the sum of
squared fills most, until bins empty: it ends where the bins are as few as their tokens allow or no move, one-for-one
or two-for-one exchange between any two underfull bins raises the sum. Where there are several groups, each hands its
least filled bins on, a part of its pieces (the last FAN_IN groups all that aren't full), and FAN_IN groups search together over what they handed on, level by level
in a tree, so that partly filled bins of all groups meet; a level starts from the bins as they are and never has more.

The encoder is the byte-level BPE of the tokenizer file, run by tiktoken on the same vocabulary and pattern
(ids equal those of the `tokenizers` library, which tests compare, in a quarter of its time).

Cases: a null or empty text is the end token alone; rows repeating an id are packed separately; a null id is
packed like any other; pieces are taken in the order of id and piece and ties go to the first, so reruns agree; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import saved

MAX_TOKENS, END = 2048, 0
GROUP_PIECES = 8192
#: Groups that search together over the bins they hand on, and the part of a group's pieces that each hands on.
FAN_IN, HANDED = 4, 16


@lru_cache(2)
def encoder(path: str):
    """tiktoken's encoder with the vocabulary of a byte-level tokenizer file (JSON)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    how = model["pre_tokenizer"] or {}
    if model["normalizer"] or model["model"]["type"] != "BPE" or any(how.get(k) != v for k, v in plain.items()) or model["model"].get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's token ids and the end token, cut only if too long."""
    tokenizer = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                ids = encode.encode(text, allowed_special="all") if any(s in text for s in special) else encode.encode_ordinary(text)
                ids = np.append(np.array(ids, "<u4"), np.array([END], "<u4"))
                first = len(ids) % max_tokens or max_tokens
                edges = [0, *range(first, len(ids) + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, the first that takes it in the order given, and the bins' fills."""
    bin_of, room, used = np.zeros(len(lengths), np.int64), np.full(max(1, len(lengths)), capacity, np.int64), 0
    start = 0  # bins before it are full
    for i, n in enumerate(lengths.tolist()):
        b = start + int(np.argmax(room[start : used + 1] >= n))
        bin_of[i] = b
        room[b] -= n
        used = max(used, b + 1)
        while start < used and not room[start]:
            start += 1
    return bin_of, capacity - room[:used]


class _Search:
    """Bins under local search: what each piece, or no piece, of each bin could be exchanged for."""

    def __init__(self, bin_of: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.n = lengths, capacity, len(lengths)
        self.place = np.concatenate([bin_of, np.arange(len(fill))])  # a row per piece, then one per bin for no piece
        self.back = np.concatenate([lengths, np.zeros(len(fill), np.int64)])
        self.fill = fill.astype(np.int64)
        self.members: list[list[int]] = [[] for _ in range(len(fill))]
        for i, b in enumerate(bin_of.tolist()):
            self.members[b].append(i)
        self.upto, self.full = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)
        for b in range(len(fill)):
            self.enter(b)

    def enter(self, b: int) -> None:
        """Bin b takes part, as far as it has room, with its pieces as they are now."""
        rows = [*self.members[b], self.n + b]
        self.upto[rows] = self.back[rows] + (self.capacity - self.fill[b] if self.fill[b] else 0)
        self.full[rows] = self.fill[b]

    def leave(self, b: int) -> None:
        rows = [*self.members[b], self.n + b]
        self.upto[rows] = self.back[rows]

    def give(self, giver: int) -> bool:
        """The best move or exchange out of a bin that has left, made if it raises the sum of squared fills."""
        mine = np.array(self.members[giver])
        size, at, times = np.unique(self.lengths[mine], return_index=True, return_counts=True)
        one, two = np.triu_indices(len(size))
        able = (size[one] + size[two] <= self.capacity) & ((one != two) | (times[one] > 1))
        one, two = one[able], two[able]
        total = np.concatenate([size[one] + size[two], size])  # of two pieces, or of one; the latter is written last
        way, largest = np.zeros((2, self.capacity + 1), np.int64)
        way[total] = np.arange(len(total))
        largest[total] = total
        largest = np.maximum.accumulate(largest)  # total of at most x
        grow = largest[self.upto] - self.back
        gain = np.where(grow > 0, grow * (self.full - self.fill[giver] + grow), 0)
        k = int(np.argmax(gain))
        if gain[k] <= 0:
            return False
        to, w, g = int(self.place[k]), int(way[grow[k] + self.back[k]]), int(grow[k])
        if w >= len(one):
            out = [int(mine[at[w - len(one)]])]
        else:
            out = [int(mine[at[one[w]]]), int(mine[np.flatnonzero(self.lengths[mine] == size[two[w]])[int(one[w] == two[w])]])]
        self.leave(to)
        for source, target, moved in ((giver, to, out), (to, giver, [k] if k < self.n else [])):
            for i in moved:
                self.members[source].remove(i)
                self.members[target].append(i)
                self.place[i] = target
        self.fill[to] += g
        self.fill[giver] -= g
        self.leave(giver)
        self.enter(to)
        return True


def local_search(bin_of: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece after exchanges out of the least filled bins, until none helps or the bins are fewest."""
    if not len(lengths):
        return bin_of
    state, fewest = _Search(bin_of, fill, lengths, capacity), -(-int(lengths.sum()) // capacity)
    left, moved = int((fill > 0).sum()), True
    while moved and left > fewest:
        moved = False
        for giver in np.argsort(state.fill, kind="stable").tolist():
            if not 0 < state.fill[giver] < capacity:
                continue
            state.leave(giver)
            while state.fill[giver] > 0 and state.give(giver):
                moved = True
            if state.fill[giver]:
                state.enter(giver)
            elif (left := left - 1) == fewest:
                break
    return state.place[: len(lengths)]


def bins_of(lengths: np.ndarray, capacity: int, start: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece: the search from the bins at the start or else from first fit in the order given and, where
    that isn't provably best, also from longest first (and from first fit)."""
    given = np.arange(len(lengths))
    fewest = -(-int(lengths.sum()) // capacity)
    found = start
    for order in (given, np.argsort(-lengths, kind="stable")):
        if start is not None and order is given:
            again = local_search(start, np.bincount(start, lengths).astype(np.int64), lengths, capacity)
        else:
            again = np.empty(len(lengths), np.int64)
            again[order] = local_search(*first_fit(lengths[order], capacity), lengths[order], capacity)
        if found is None or len(np.unique(again)) < len(np.unique(found)):
            found = again
        if len(np.unique(found)) <= fewest:
            break
    return found


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    groups = max(1, -(-cut.count() // group_pieces))
    names = [f.name for f in cut.schema.fields]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut.schema.fields)}, sequence_id long, offset long, open boolean"

    # what a group hands on; the last FAN_IN groups hand on all bins that aren't full
    handed_on = lambda groups: group_pieces // HANDED if groups > FAN_IN else FAN_IN * group_pieces
    share = handed_on(groups)

    def placed(rows: pd.DataFrame, bins: np.ndarray, first_id: int, share: int) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        fill = np.bincount(bins, lengths)
        under = np.flatnonzero((fill > 0) & (fill < max_tokens))
        under = under[np.argsort(fill[under], kind="stable")]
        held = np.bincount(bins)[under]
        handed = np.isin(bins, under[np.cumsum(held) - held < share])
        order = np.argsort(bins, kind="stable")
        rows, lengths, bins, handed = rows.iloc[order], lengths[order], bins[order], handed[order]
        end = np.cumsum(lengths)
        new = np.r_[True, bins[1:] != bins[:-1]]
        offset = end - lengths - (end - lengths)[new][np.cumsum(new) - 1]
        return rows[names].assign(sequence_id=first_id + np.cumsum(new) - 1, offset=offset, open=handed)

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        return placed(rows, bins_of(rows["length"].to_numpy(np.int64), max_tokens), int(key[0]) << 32, share)

    def again(level: int, share: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["sequence_id", "offset"], kind="stable").reset_index(drop=True)
            start = np.unique(rows["sequence_id"], return_inverse=True)[1]
            return placed(rows, bins_of(rows["length"].to_numpy(np.int64), max_tokens, start), level << 58 | int(key[0]) << 32, share)

        return place

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    out, done, level = dealt.groupBy("_group").applyInPandas(place, schema), [], 0
    while groups > 1:
        here, groups, level = saved(out, "pack-level"), -(-groups // FAN_IN), level + 1
        done.append(here.where("not open"))
        parent = (F.shiftright(F.col("sequence_id").bitwiseAND((1 << 58) - 1), 32) / FAN_IN).cast("int")
        out = here.where("open").groupBy(parent.alias("_group")).applyInPandas(again(level, handed_on(groups)), schema)
    return reduce(DataFrame.unionByName, done, out).drop("open")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return pack(saved(pieces(docs, id_col, text_col, tokenizer, max_tokens), "pack-pieces"), max_tokens)
