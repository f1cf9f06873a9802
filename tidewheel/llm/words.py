"""Vectorised words of Arrow string columns: boundaries and 64-bit hashes, with numpy on the UTF-8 bytes.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; UTF-8 never uses those bytes inside a longer
character, so this equals the definition on code points. A word's hash takes eight of its bytes at a time through
a mixer, never a sum that rearranged bytes could keep, and each seed gives an independent hash; equal words have
equal hashes on every machine and in every run. Spans of words are hashed by a polynomial over the words' hashes,
SPAN_WORDS at most, too few terms for the collisions that long regular sequences have modulo 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Longer words are hashed by BLAKE2b.
LONG_WORD = 64
#: Words in a span whose hash is taken for its words, at most.
SPAN_WORDS = 128
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MASK = (1 << 64) - 1


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(self.base))]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(self.inverse))]))
        return self.up[:n], self.down[:n]


FIRST, SECOND = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(29)
    return h


def spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[lo:hi] for every pair, independent of where it starts."""
    up, down = powers.get(len(values) + 1)
    total = np.concatenate([[U(0)], np.cumsum(values * up[: len(values)])])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * U(0x9FB21C651E98DF25))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(texts) else (raw[:0], np.zeros(1, np.int64))


class Words:
    """The words of some texts: lo, hi (bytes), first (index of each text's first word, and the end)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        n = len(raw)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~SPACE[raw]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        self.lo = np.flatnonzero(word[1:] & (~word[:-1] | cut)[: n + 1])
        self.hi = np.flatnonzero(word[:-1] & (~word[1:] | cut)[: n + 1])
        self.first = np.searchsorted(self.lo, at)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64 bits of each word; different seeds give independent ones."""
        length = self.hi - self.lo
        odd = mix(np.array([2 * seed], np.uint64))[0] | U(1)
        h = mix(length.astype(np.uint64) * odd + U(seed))
        eight = np.ndarray(len(self.raw) + 1, "<u8", np.concatenate([self.raw, np.zeros(8, np.uint8)]), strides=(1,))
        who = None if (length <= LONG_WORD).all() else np.flatnonzero(length <= LONG_WORD)
        at, left = (self.lo, length) if who is None else (self.lo[who], length[who])
        while len(at):
            lane = eight[at] & _LOW[np.minimum(left, 8)]
            if who is None:
                h = mix(h ^ lane * odd)
            else:
                h[who] = mix(h[who] ^ lane * odd)
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            word = self.raw[self.lo[i] : self.hi[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        return h


def chunks(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts [i, j) of about `most` bytes, one text at least, with their bytes and offsets."""
    raw, at = utf8(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
