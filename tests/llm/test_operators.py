import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewheel.llm import contentsort, iblt, langid, linededup, mixing, ngramjoin, packing, quality, repeats, secrets

unique = lambda df: df.where("doc_id != 700")


def pairs(rows, skip=()):
    return [(r[0], r[1]) for r in rows if r[0] not in skip]


def test_language(odd, odd_rows):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert len(got) == len({r[0] for r in odd_rows})
    for i, text, *_ in odd_rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    prose = [r for r in odd_rows if 100 <= r[0] < 230 and len(r[1]) > 60]
    assert np.mean([got[i].lang_pred == ("de" if "und" in t.split() or "der" in t.split() or "würde" in t.split() else "en") for i, t, *_ in prose]) > 0.9


def test_language_distance():
    p = {"a": langid.grams("abc abd"), "b": langid.grams("xyz xyw")}
    rank = langid.Ranker({k: np.unique(v) for k, v in p.items()})
    assert rank.predict("abc")[0] == "a" and rank.predict("xyz")[0] == "b"
    top = np.unique(langid.grams("abc"))
    away = [sum(abs(i - list(np.unique(p[k])).index(g)) if g in p[k] else 300 for i, g in enumerate(top)) for k in "ab"]
    assert rank.predict("abc")[1] == pytest.approx(1 - min(away) / (300 * len(top)))


def test_language_stage_keeps_columns(odd):
    out = langid.in_known_language(odd)
    assert out.columns == odd.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert not ids & {400, 401, 402, 405, 406} and 100 in ids and 504 in ids


def test_line_dedup(odd, odd_rows):
    got = linededup.without_repeated_lines(unique(odd)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute.line_dedup(pairs(odd_rows, {700}))


def test_line_index_is_reversible(spark, odd, odd_rows):
    index = linededup.LineIndex(spark, shard_keys=50)
    first, second = unique(odd).where("doc_id % 2 = 0"), unique(odd).where("doc_id % 2 = 1")
    index.insert(first)
    before = {(r.key, r.n_docs, r.first_doc) for r in index.counts().collect()}
    known = index.insert(second)
    assert index.shards > 1 and known.count() > 0
    assert index.maybe_known(first).count() == linededup.line_refs(first).select("key").distinct().count()
    both = {r.doc_id: sorted(r.dropped) for r in index.drops().collect()}
    whole = linededup.LineIndex(spark)
    whole.insert(unique(odd))
    assert both == {r.doc_id: sorted(r.dropped) for r in whole.drops().collect()}
    index.delete(second.select("doc_id"))
    assert {(r.key, r.n_docs, r.first_doc) for r in index.counts().collect()} == before
    mine = linededup.line_refs(first).select("key").distinct()
    assert index.maybe_known(first).count() == mine.count()
    theirs = linededup.line_refs(second).select("key").distinct().join(mine, "key", "left_anti").count()
    assert index.maybe_known(second).count() <= linededup.line_refs(second).select("key").distinct().count() - theirs + 2


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 5000)
    box = linededup.CuckooFilter(5000)
    assert box.insert(keys) and box.contains(keys).all()
    assert box.contains(rng.integers(-(2**62), 2**62, 20000)).mean() < 0.01
    box.remove(keys[:2500])
    assert box.contains(keys[2500:]).all() and box.contains(keys[:2500]).mean() < 0.01
    assert not linededup.CuckooFilter(16).insert(keys)


def test_repeats(odd, odd_rows):
    got = repeats.cover(unique(odd)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.repeats(pairs(odd_rows, {700}))


def test_repeats_with_hot_anchors(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    got = repeats.cover(unique(odd)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.repeats(pairs(odd_rows, {700}))


@pytest.mark.parametrize("seed", range(4))
def test_anchors_agree(seed):
    from tidewheel.llm.recompression import anchors

    rng = np.random.default_rng(seed)
    h = rng.integers(0, 3 if seed % 2 else 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h[2000:2300] = h[500:800]
    first = np.array([0, 1000, 1010, 2100, 4000])
    name, start, count = anchors(h, first, 20)
    of = {}
    for a, s, c in zip(name.tolist(), start.tolist(), count.tolist()):
        for k in range(s, s + c):
            of[k] = a
    assert len(of) == sum(max(0, b - a - 19) for a, b in zip(first, first[1:]))
    by_words = {}
    for k, a in of.items():
        assert by_words.setdefault(h[k : k + 20].tobytes(), a) == a


def test_secrets(odd, odd_rows):
    got = {r.doc_id: r for r in secrets.find_secrets(odd).collect()}
    for i, text, *_ in odd_rows:
        want, r = brute.base_spans(text), got[i]
        assert r.base_sha256 == brute.sha(want)
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in want.split(",") if x]
    text = dict(pairs(odd_rows))[600]
    found = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[600].spans.split(",") if s.startswith("random")]
    assert found == ["3nr0ESnM5cSIQYm9KVkAXCdK"]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(odd, odd_rows, keep):
    got = contentsort.content_sort(odd, keep=keep).collect()
    groups = {}
    for i, t, *_ in odd_rows:
        groups.setdefault((t or "").translate(brute.LOW), []).append(i)
    best = max if keep == "max" else min
    want = Counter((i, best(g), len(g), i == best(g), brute.sha(t)) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_quality_features_by_hand():
    import pyarrow as pa

    from tidewheel.llm.words import chunks

    (_, _, raw, at), *_ = chunks(pa.array(["Ab ab ab, CD!\nx", None, "", "é1"]))
    x = quality.statistics(raw, at)
    col = lambda n: x[:, quality.NAMES.index(n)].tolist()
    assert col("words") == [5, 0, 0, 1] and col("lines") == [2, 1, 1, 1] and col("bytes") == [15, 0, 0, 3]
    assert col("distinct_words")[0] == 1 and col("upper_words")[0] == pytest.approx(0.2) and col("class_3") == [0, 0, 0, pytest.approx(1 / 3)]


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = quality.fit(x[:10], np.ones(10))
    assert (one.score(x[:3]) > 0.99).all()
    assert (quality.fit(x[:0], y[:0]).score(x[:3]) == 0.5).all()


def test_quality(spark, odd):
    labels = spark.createDataFrame([(100 + 3 * k, k % 2, 0) for k in range(40)] + [(101, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_fingerprints(odd, odd_rows):
    got = iblt.fingerprints(odd).collect()
    want = brute.fingerprints(pairs(odd_rows))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(pairs(odd_rows))[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_fingerprints_over_buckets(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(iblt, "BUCKET_DOCS", 3)
    got = iblt.fingerprints(odd).collect()
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted((w[0], w[2]) for w in brute.fingerprints(pairs(odd_rows)))


def test_targets():
    t = mixing.targets([100, 100, 100])
    assert sum(t) == pytest.approx(450) and max(t) <= 200 + 1e-9
    t = mixing.targets([10, 1000, 0, 7])
    assert sum(t) == pytest.approx(1.5 * 1017) and t[0] == 20 and t[2] == 0 and t[3] <= 14
    assert mixing.targets([]) == []


def test_splitting_tree():
    q = mixing.split_quotas(np.array([100, 7, 0, 31]), 5)
    assert (q.sum(0) == [100, 7, 0, 31]).all() and (q >= 0).all() and set(q.sum(1)) <= {27, 28}
    assert (q == mixing.split_quotas(np.array([100, 7, 0, 31]), 5)).all()


def test_mixing(odd, odd_rows):
    rows = mixing.mix_sources(odd, shards=3).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    per = Counter()
    for _, t, _, s, *_ in odd_rows:
        per[s] += size(t)
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    want = dict(zip(order, mixing.targets([per[s] for s in order])))
    source = {r[0]: r[3] for r in odd_rows}
    taken, longest = Counter(), Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size(dict(pairs(odd_rows))[r.doc_id]) and r.source_size == per[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.shards) == r.copies and all(0 <= k < 3 for k in r.shards)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert len(rows) == len(odd_rows) and all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd.repartition(5), shards=3).collect()))


def test_mixing_cuts_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    docs = spark.createDataFrame([(k, "w " * (k % 9 + 1), "abc"[k % 3] if k % 10 else "d") for k in range(300)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix_sources(docs, shards=4).collect():
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert all(abs(v[0] - t) <= 5 for (_, t), v in by.items())


def test_packing_round_trip(odd, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(unique(odd)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in pairs(odd_rows, {700}):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:])
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_ngram_join(odd, odd_rows):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in ngramjoin.ngram_join(unique(odd)).collect()}
    assert got == brute.similar(pairs(odd_rows, {700}))


def test_ngram_join_leads_large_buckets_by_rounds(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BUCKET", 1)
    monkeypatch.setattr(ngramjoin, "TILE", 2)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in ngramjoin.ngram_join(unique(odd)).collect()}
    assert got == brute.similar(pairs(odd_rows, {700}))


def test_pruning_keeps_what_can_reach_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 60000, (400, ngramjoin.KEPT)).astype("<u2")
    share = np.repeat([0.2, 0.5, 0.8, 0.95], 100)
    b = np.where(rng.random(a.shape) < share[:, None], a, a + 1).astype("<u2")
    kept = ngramjoin.survivors(a, b)
    assert not kept[:200].any() and kept[200:].all()
    assert [n for n, _ in ngramjoin.least_matches(ngramjoin.KEPT, ngramjoin.STEP, ngramjoin.THRESHOLD, ngramjoin.TOLERANCE)] == list(range(32, 257, 32))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (langid.identify(none), linededup.without_repeated_lines(none), repeats.cover(none), secrets.find_secrets(none), contentsort.content_sort(none), quality.classify(none, labels), iblt.fingerprints(none), mixing.mix_sources(none), packing.pack_documents(none), ngramjoin.ngram_join(none)):
        assert df.count() == 0


def test_null_ids_do_not_crash(spark, with_null_id):
    labels = spark.createDataFrame([(100, 1, 0), (103, 0, 0)], "doc_id long, quality int, toxic int")
    n = with_null_id.count()
    for df in (langid.identify(with_null_id), linededup.without_repeated_lines(with_null_id), repeats.cover(with_null_id), secrets.find_secrets(with_null_id), contentsort.content_sort(with_null_id), quality.classify(with_null_id, labels), iblt.fingerprints(with_null_id), mixing.mix_sources(with_null_id), ngramjoin.ngram_join(with_null_id)):
        assert df.count() == n
    assert packing.pack_documents(with_null_id).count() >= n
