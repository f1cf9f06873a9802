"""Substring dedup over rows that repeat an id, and the sizes it takes."""

import pytest

from tests.llm import brute
from tidewheel.llm import repeats


def test_rows_that_repeat_an_id_lose_only_their_own_words(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(45))
    rows = [(5, one), (5, two), (5, one), (3, "x y z " + one), (9, two + " end"), (None, two), (None, None)]
    got = sorted((tuple(r)[1:3], r.kept_sha256) for r in repeats.cover(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [((30, 30), brute.sha(""))] * 2 + [((45, 45), brute.sha("")), ((33, 0), brute.sha("x y z " + one)), ((46, 45), brute.sha("end")), ((45, 0), brute.sha(two)), ((0, 0), brute.sha(""))]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 63])
def test_sizes(spark, size):
    rows = [(1, " ".join(f"a{k % 97}" for k in range(300))), (2, " ".join(f"a{k}" for k in range(80)) + " b c d"), (3, "b c d"), (4, "b")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.cover(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
    assert got == brute.repeats(rows, size)


def test_sizes_that_marks_cannot_hold(spark):
    with pytest.raises(ValueError):
        repeats.cover(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 64)
