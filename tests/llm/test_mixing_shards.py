"""Mixing: targets computed another way, every copy in a shard, ids that repeat, rows in their shard's order."""

from collections import Counter
from fractions import Fraction

import pytest

from tests.llm import brute
from tidewheel.llm import mixing


def filled(sizes):
    """Targets by pouring: all open sources rise together at the rate of their weights until they are full or the budget is gone."""
    weight = [Fraction((3, 1, 2)[i % 3]) for i in range(len(sizes))]
    level, budget = Fraction(0), Fraction(3, 2) * sum(sizes)
    caps = sorted((Fraction(2 * n) / w, i) for i, (n, w) in enumerate(zip(sizes, weight, strict=True)))
    for k, (cap, _) in enumerate(caps):
        rate = sum(weight[i] for _, i in caps[k:])
        if (cap - level) * rate >= budget:
            level += budget / rate
            break
        budget -= (cap - level) * rate
        level = cap
    return [float(min(level * w, 2 * n)) for n, w in zip(sizes, weight, strict=True)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0, 7], [5], [1, 10_000], [0, 0], [3, 50, 900, 20, 20, 20, 1]])
def test_targets_by_pouring(sizes):
    assert mixing.targets(sizes) == pytest.approx(filled(sizes))


def rows():
    out = [(k, "w " * (k % 23 + 1), "abc"[k * k % 3] if k % 10 else None) for k in range(1500)]
    return out + [(7, "other words here", "b"), (7, "other words here", "b"), (8, None, "a"), (None, "no id", "zz"), (None, "no id either", None)]


def test_words_taken_come_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    size = Counter()
    for _, t, s in rows():
        size[s] += len(brute.WORD.findall(t or ""))
    order = [*sorted(s for s in size if s is not None), None]
    want = dict(zip(order, filled([size[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert len(got) == len(rows()) and len({r.source_size for r in got}) == len(order)
    for s in order:
        assert abs(taken[size[s], round(want[s], 6)] - want[s]) <= 12
    used = {x for r in got for x in r.shards}
    assert len(used) > 8 and all(len(r.shards) == len(r.places) == r.copies and r.taken == r.copies * r.size <= 2 * r.size for r in got)


def test_two_blocks_go_to_two_shards(spark):
    docs = spark.createDataFrame([(k, "some words", "ab"[k % 2]) for k in range(300)], "doc_id long, text string, source string")
    assert {x for r in mixing.mix_sources(docs).collect() for x in r.shards} == {0, 1}


def test_rows_are_dealt_to_shards_as_the_plan_says(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    plan, dealt = mixing.mix_sources(docs).collect(), mixing.mixed(docs)
    assert dealt.select("row.*").columns == docs.columns
    got = dealt.collect()
    want = Counter((r.doc_id, r.size, s, p) for r in plan for s, p in zip(r.shards, r.places, strict=True))
    assert Counter((r.row.doc_id, len(brute.WORD.findall(r.row.text)), r.shard, r.place) for r in got) == want
    parts = dealt.rdd.glom().map(lambda part: [(r.shard, r.place) for r in part]).collect()
    assert all(part == sorted(part) for part in parts) and sum(len({s for s, _ in part}) for part in parts) == len({r.shard for r in got})
