"""Fingerprints over many buckets, ids of other types, null ids, and parts that sketches can't tell."""

import datetime

import pytest

from tests.llm import brute
from tidewheel.llm import iblt


def texts(n):
    return [f"document {k * 7919 % n}\n" + "\n".join(f"line {(k * k + j) % 40} of some" for j in range(k % 9)) for k in range(n)]


def compared(df, rows):
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in iblt.fingerprints(df).collect())
    assert got == sorted(brute.fingerprints(rows))


def test_many_string_ids(spark):
    rows = [(f"id{k * 31 % 5000}", t) for k, t in enumerate(texts(5000))]
    compared(spark.createDataFrame(rows, "doc_id string, text string"), rows)


@pytest.mark.parametrize("ids", [int, float, lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k), lambda k: f"{k}"])
def test_ids_of_any_order(spark, monkeypatch, ids):
    monkeypatch.setattr(iblt, "BUCKET_DOCS", 7)
    rows = [(ids(k * 37 % 200), t) for k, t in enumerate(texts(200))]
    kind = {int: "long", float: "double", datetime.date: "date", str: "string"}[type(rows[0][0])]
    compared(spark.createDataFrame(rows, f"doc_id {kind}, text string"), rows)


def test_a_null_id_is_first_and_follows_the_last(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BUCKET_DOCS", 3)
    rows = [(k, t) for k, t in enumerate(texts(20))] + [(None, "text without an id"), (None, "another text without an id")]
    named = [(-1 if i is None else i, t) for i, t in rows]
    got = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.fingerprints(named)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in got) == sorted((w[0], w[1], w[2], w[4]) for w in want)


def test_large_differences_are_counted_to_the_end(spark, monkeypatch):
    rows = [(k, "\n".join(f"{k if j % 3 else 0} line {j}" for j in range(n))) for k, n in enumerate((900, 900, 0, 40, 300, 301))]
    compared(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    monkeypatch.setattr(iblt, "PART_UNITS", 0)  # no part is sketched: all are split until no bits are left, then compared
    compared(spark.createDataFrame(rows[2:5], "doc_id long, text string"), rows[2:5])
