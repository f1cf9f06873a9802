"""Locally consistent names for token sequences, after recompression, with numpy on flat arrays.

A round names runs (token, length) or pairs (left name, right name) of neighbours. Pairs are formed between a
random left and right half of the alphabet, drawn anew each round from the names themselves, so equal
substrings are parsed alike but for their borders. A name is a 64-bit hash of what it stands for: the same
everywhere, which is what a global naming table would give, without exchanging one.

With every symbol goes its reach, the tokens that decided it: two texts that agree on the reach of a symbol
both have it. A window of tokens therefore has the symbols whose reach it covers wherever it occurs, and its
anchor, the longest of them (the smallest name on a tie), is the same at each occurrence.
"""

from __future__ import annotations

import numpy as np

from tidewheel.llm.words import FIRST, MASK, SECOND, U, mix, spans

ROUNDS = 3
_PAIR = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def symbols(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """name, length, reach_lo, reach_hi of the runs and of the pairs of every round, over texts h[first[i]:first[i+1]].

    A reach leaves its text where the text's border decided the symbol.
    """
    n = len(h)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    start = edge[:n].copy()
    start[1:] |= h[1:] != h[:-1]
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], n)
    name = np.where(hi - lo > 1, mix(h[lo] ^ ((hi - lo).astype(np.uint64) * _PAIR[0])), h[lo])
    rlo, rhi = lo - 1, hi + 1
    opens = edge[lo]  # the first symbol of its text
    out = [(name, hi - lo, rlo, rhi)]
    for r in range(rounds):
        right = (mix(name + U((r + 1) * 0x94D049BB133111EB & MASK)) >> U(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~opens[1:]
        at = np.flatnonzero(pair)
        if not len(at):
            break
        second = np.zeros(len(name), bool)
        second[at + 1] = True
        # what stays alone was decided by a neighbour too: a left symbol by the next, a right one by the last
        new_lo, new_hi = rlo.copy(), rhi.copy()
        alone = np.flatnonzero(~pair & ~second)
        lefts, rights = alone[~right[alone]], alone[right[alone]]
        last = np.append(opens[1:], True)
        nxt, prv = np.minimum(lefts + 1, len(name) - 1), np.maximum(rights - 1, 0)
        new_hi[lefts] = np.where(last[lefts], n + 2, np.maximum(rhi[lefts], rhi[nxt]))
        new_lo[lefts] = np.where(last[lefts], rlo[lefts], np.minimum(rlo[lefts], rlo[nxt]))
        new_lo[rights] = np.where(opens[rights], -2, np.minimum(rlo[rights], rlo[prv]))
        new_hi[rights] = np.where(opens[rights], rhi[rights], np.maximum(rhi[rights], rhi[prv]))
        new_lo[at], new_hi[at] = np.minimum(rlo[at], rlo[at + 1]), np.maximum(rhi[at], rhi[at + 1])
        name = name.copy()
        name[at] = mix(name[at] * _PAIR[0] + mix(name[at + 1] * _PAIR[1]))
        hi = hi.copy()
        hi[at] = hi[at + 1]
        out.append((name[at], hi[at] - lo[at], new_lo[at], new_hi[at]))
        keep = ~second
        name, lo, hi, rlo, rhi, opens = name[keep], lo[keep], hi[keep], new_lo[keep], new_hi[keep], opens[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of `size` tokens starts at each position without leaving its text."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], first[1:] - size + 1
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    return np.cumsum(ok)[:n] > 0


def anchors(h: np.ndarray, first: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor name, start, count: runs of consecutive windows of a text that have the same anchor occurrence.

    An anchor's name is its symbol's joined with the words of its reach, which each of its windows covers: that
    tells apart what only short symbols have in common. A window that covers no reach is its own anchor.
    """
    n = len(h)
    valid = windows(first, size)
    best = np.where(valid, -1, -2)
    name, length, rlo, rhi = symbols(h, first, rounds)
    fits = (rhi - rlo <= size) & (rlo >= 0) & (rhi <= n)
    name, length, rlo, rhi = name[fits], length[fits], rlo[fits], rhi[fits]
    order = np.lexsort((~name, -length))  # longest first; among equals the largest name first, so the smallest is written last
    bounds = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, bounds) if len(order) else []:
        open_ = np.concatenate([[0], np.cumsum(best == -1)])
        a, b = np.maximum(rhi[group] - size, 0), np.minimum(rlo[group], n - 1) + 1
        group, a, b = (x[open_[b] > open_[a]] for x in (group, a, b))
        m = b - a
        at = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
        free = best[at] == -1
        best[at[free]] = np.repeat(group, m)[free]
    at = np.flatnonzero(valid)
    own = best[at] == -1
    who = np.where(own, -3 - at, best[at])
    new = np.ones(len(at), bool)
    new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    position, who = at[start], who[start]
    anchor = np.zeros(len(position), np.uint64)
    known = who >= 0
    anchor[known] = name[who[known]] ^ spans(h, rlo[who[known]], rhi[who[known]], SECOND)
    anchor[~known] = spans(h, position[~known], position[~known] + size, SECOND)
    return anchor, position, count


def prints(h: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words lo to hi, from two independent hashes h and g of each word."""
    return spans(h, lo, hi, FIRST), spans(g, lo, hi, SECOND)
