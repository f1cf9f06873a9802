"""The pipeline against a brute-force version of each stage, on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tidewheel.llm import langid, mixing


def test_stages_in_order(spark, odd, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "source_mixing", "packing"]
    docs = odd.where("doc_id != 700")
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.dtypes == docs.dtypes
        seen.append((docs, out))
        docs = out
    rows = lambda df: df.select("doc_id", "text", "source").collect()

    before, after = seen[0]
    profiles = langid.learn(before, where=~langid.held_out())
    rank = langid.Ranker(profiles)
    want = {r.doc_id for r in rows(before) if rank.predict(r.text)[0] != "und" and rank.predict(r.text)[1] >= langid.LEAST_SCORE}
    assert {r.doc_id for r in rows(after)} == want

    before, after = seen[1]
    lines = brute.line_dedup([(r.doc_id, r.text) for r in rows(before)])
    assert {r.doc_id: brute.sha(r.text) for r in rows(after)} == {i: v[2] for i, v in lines.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen[2]
    groups = brute.similar([(r.doc_id, r.text) for r in rows(before)])
    assert {r.doc_id for r in rows(after)} == {i for i, v in groups.items() if v[0] == i}

    before, after = seen[3]
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect()}
    assert Counter(r.doc_id for r in rows(after)) == Counter({k: v for k, v in plan.items() if v})

    before, after = seen[4]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(r.doc_id for r in rows(before))
    fill = Counter()
    for r in after.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_stages_on_nothing(spark, none):
    docs = none
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_run_and_queries(spark):
    from tidewheel.llm.queries import QUERIES

    first = pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(first.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and first.count() > 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    run = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op3_substring_dedup")} == brute.repeats(docs)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in run("op10_ngram_join")} == brute.similar(docs)
    assert {r.doc_id: r.base_sha256 for r in run("op4_secret_scan")} == {i: brute.sha(brute.base_spans(t)) for i, t in docs}
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in run("op7_fingerprints")) == sorted(brute.fingerprints(docs))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    from tidewheel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op1_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.97
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, label[r.doc_id], r.predicted) for r in QUERIES["op6_quality"](spark, sf).collect() if r.held_out and r.doc_id in label]
    pairs = [(a[0] > b[0]) + (a[0] == b[0]) / 2 for a in got if a[1] for b in got if not b[1]]
    assert sum(pairs) / len(pairs) > 0.95 and sum(p == y for _, y, p in got) / len(got) > 0.9
