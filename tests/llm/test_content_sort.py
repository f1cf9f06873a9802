"""Exact dedup: rows dropped whole, ids that repeat, texts that begin alike, salts of any number."""

from collections import Counter

import pytest

from tests.llm import brute
from tidewheel.llm import contentsort


def rows():
    head = "the same header in front of every text, " * 3
    out = [(k, head + str(k % 30)) for k in range(200)] + [(500 + k, "Copy of one text") for k in range(150)]
    return out + [(7, "COPY of one text"), (7, "another text"), (9999, "another TEXT"), (None, "copy of one text"), (None, "only without an id"), (3, None), (4, "")]


@pytest.mark.parametrize("salts", [1, 3, None])
def test_groups(spark, salts):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    groups = {}
    for i, t in rows():
        groups.setdefault((t or "").translate(brute.LOW), []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, best[t], len(g), i == best[t], brute.sha(t)) for t, g in groups.items() for i in g)
    assert Counter(map(tuple, contentsort.content_sort(docs, salts=salts).collect())) == want


def test_dropping_copies_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, _kept_id string")
    got = contentsort.drop_copies(docs)
    assert got.columns == docs.columns
    left = Counter((r.text or "").translate(brute.LOW) for r in got.collect())
    assert set(left) == {(t or "").translate(brute.LOW) for _, t in rows()} and set(left.values()) == {1}
    assert (9999, "another TEXT") in {(r.doc_id, r.text) for r in got.collect()}
