"""The local search: against an exact solver on small inputs, and where longest-first best fit isn't best."""

from functools import lru_cache

import numpy as np
import pytest

from tidewheel.llm import packing


def fewest(lengths, capacity):
    """Fewest bins by trying all ways (rooms as a sorted tuple)."""
    lengths = sorted(lengths, reverse=True)

    @lru_cache(None)
    def rest(i, rooms):
        if i == len(lengths):
            return 0
        ways = [1 + rest(i + 1, tuple(sorted((*rooms, capacity - lengths[i]))))]
        for k, r in enumerate(rooms):
            if r >= lengths[i] and r not in rooms[:k]:
                ways.append(rest(i + 1, tuple(sorted((*rooms[:k], r - lengths[i], *rooms[k + 1 :])))))
        return min(ways)

    return rest(0, ())


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def used(lengths, capacity):
    bins = packing.bins_of(np.array(lengths, np.int64), capacity)
    assert len(bins) == len(lengths) and np.bincount(bins, weights=lengths).max(initial=0) <= capacity
    return len(np.unique(bins))


@pytest.mark.parametrize("seed", range(40))
def test_near_the_fewest_bins_on_small_inputs(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, 10).tolist()
    assert used(lengths, 20) <= fewest(lengths, 20)


@pytest.mark.parametrize("seed", range(4))
def test_fewer_bins_than_best_fit_decreasing(seed):
    rng, lengths = np.random.default_rng(seed), []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        lengths += [a, b, 1000 - a - b]
    rng.shuffle(lengths)
    assert 60 <= used(lengths, 1000) <= 62 < best_fit_decreasing(lengths, 1000)
    pairs = rng.integers(500, 1000, 1200).tolist()
    assert used(pairs, 2048) < 0.96 * best_fit_decreasing(pairs, 2048)


def test_the_search_empties_bins_that_first_fit_leaves():
    lengths = np.random.default_rng(1).integers(1, 300, 2000)
    start = packing.first_fit(lengths, 1000)
    fewest_ = -(-int(lengths.sum()) // 1000)
    assert len(start[1]) > fewest_ == used(lengths, 1000)


def test_every_exchange_raises_the_squared_fill():
    lengths = np.random.default_rng(2).integers(1, 60, 200)
    bin_of, fill = packing.first_fit(lengths, 100)
    state, last = packing._Search(bin_of, fill, lengths, 100), int((fill**2).sum())
    for giver in np.argsort(fill, kind="stable").tolist():
        if not 0 < state.fill[giver] < 100:
            continue
        state.leave(giver)
        while state.fill[giver] and state.give(giver):
            assert (state.fill**2).sum() > last and (np.bincount(state.place[:200], weights=lengths, minlength=len(fill)) == state.fill).all()
            last = int((state.fill**2).sum())
        if state.fill[giver]:
            state.enter(giver)


def test_moves_and_exchanges_by_hand():
    assert used([6, 4, 6, 3, 1], 10) == 2
    assert used([5, 3, 4, 5, 2, 1], 10) == 2
    assert used([7, 5, 2, 3, 3], 10) == 2  # two for one: 2 and 3 against 5
    assert used([], 10) == 0 and used([10], 10) == 1 and used([10, 10, 1], 10) == 3


def test_groups_never_need_more_than_one_global_best_fit(spark):
    rng = np.random.default_rng(1)
    for trial in range(4):
        lengths = np.clip(np.exp(rng.normal(5.5 + trial / 4, 1.2, 3000)), 2, 2048).astype(int).tolist()
        cut = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(cut, 2048, 1000).collect()
        fill, places = {}, {}
        for r in got:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(r.doc_id for r in got) == list(range(3000)) and max(fill.values()) <= 2048
        assert all(sum(n for _, n in sorted(p)[:k]) == o for p in places.values() for k, (o, _) in enumerate(sorted(p)))
        assert len(fill) <= best_fit_decreasing(lengths, 2048)
