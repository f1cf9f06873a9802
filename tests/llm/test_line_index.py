"""The line index in later batches: what the filters decide, and deletion among colliding fingerprints."""

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import linededup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def colliding(spark, index, first):
    """A line that the filter of `first` takes for known though it isn't there."""
    lines = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("another line number "), "id").alias("text"))
    prints = linededup.line_refs(lines).select("doc_id", F.xxhash64("key").alias("print")).toPandas()
    box = linededup.CuckooFilter.load(index.filters.first().data)
    hits = prints[box.contains(prints["print"].to_numpy(np.int64))]
    assert len(hits)
    return f"another line number {hits.doc_id.iloc[0]}"


def test_deletion_leaves_colliding_keys(spark):
    first = docs(spark, [(1, "\n".join(f"a line of the first document {k}" for k in range(40)))])
    index = linededup.LineIndex(spark)
    index.insert(first)
    second = docs(spark, [(2, colliding(spark, index, first))])
    assert index.insert(second).count() == 1  # a false positive
    assert index.drops().count() == 0
    index.delete(second.select("doc_id"))
    assert index.maybe_known(first).count() == 40


def test_later_batches_recount_only_what_they_touch(spark):
    index = linededup.LineIndex(spark)
    index.insert(docs(spark, [(5, "shared by the first two\nonly in document five"), (6, "shared by the first two\nonly in document six")]))
    assert {(r.doc_id, *r.dropped) for r in index.drops().collect()} == {(6, 0)}
    index.insert(docs(spark, [(3, "only in document six\nshared by the last two"), (4, "shared by the last two\nnobody else has this")]))
    assert {(r.doc_id, *sorted(r.dropped)) for r in index.drops().collect()} == {(4, 0), (6, 0, 1)}
    whole = {bytes(r.key): r.first_doc for r in index.counts().where("n_docs > 1").collect()}
    assert {bytes(r.key): r.first_doc for r in index.several.collect()} == whole and len(whole) == 3
    index.delete(docs(spark, [(3, "")]).select("doc_id"))
    assert {(r.doc_id, *r.dropped) for r in index.drops().collect()} == {(6, 0)}


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    rows = docs(spark, [(1, "shared by the documents"), (5, "shared by the documents\nother"), (5, "wholly unique line here\nother"), (5, "shared by the documents\nother"), (7, "only in document seven\nonly in document seven")])
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.without_repeated_lines(rows).collect())
    assert got == sorted([(1, 1, 0, "shared by the documents"), (5, 2, 1, "other"), (5, 2, 0, "wholly unique line here\nother"), (5, 2, 1, "other"), (7, 2, 0, "only in document seven\nonly in document seven")])


def test_deleting_null_ids_and_from_nothing(spark):
    index = linededup.LineIndex(spark)
    gone = docs(spark, [(None, ""), (4, "")]).select("doc_id")
    index.delete(gone)
    index.insert(docs(spark, [(None, "a line of two documents"), (3, "a line of two documents"), (4, "a line of two documents")]))
    assert sorted(r.doc_id for r in index.drops().collect()) == [3, 4]
    index.delete(gone)
    assert index.drops().count() == 0 and {(r.n_docs, r.first_doc) for r in index.counts().collect()} == {(1, 3)}
