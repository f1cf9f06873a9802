"""Links that a group's leader could hide, regular words that sums can't tell apart, ids with several texts."""

import random

import pytest

from tests.llm import brute
from tidewheel.llm import ngramjoin, repeats


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def joined(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in ngramjoin.ngram_join(df).collect()}


def edited(rng, words, n):
    """words with n of them replaced at random places."""
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_no_link_is_lost_behind_a_leader(spark):
    """Groups of two linked documents, v and w, and documents of smaller ids just under the threshold to v."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        v = [f"w{rng.randrange(5000)}" for _ in range(300)]
        w = v[:-28] + [f"x{g}_{k}" for k in range(28)]
        near = [v[28:] + [f"y{g}_{n}_{k}" for k in range(30)] if n % 2 else edited(rng, v, 7) for n in range(40)]
        rows += [(1000 * g + n, " ".join(d)) for n, d in enumerate(near)] + [(1000 * g + 900, " ".join(v)), (1000 * g + 901, " ".join(w))]
    got, want = joined(frame(spark, rows)), brute.similar(rows)
    assert all(want[1000 * g + 900][1] >= 1 for g in range(4))
    assert got == want


@pytest.mark.parametrize("tile", [2, 7])
def test_parts_of_large_buckets_meet_in_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BUCKET", tile)
    monkeypatch.setattr(ngramjoin, "TILE_SHINGLES", 400)
    rng = random.Random(tile)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, 1 + k % 4))) for k in range(60)]
    assert joined(frame(spark, rows)) == brute.similar(rows)


def test_recall_near_the_threshold(spark):
    rng, rows = random.Random(8), []
    for g in range(150):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(200)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[: -rng.randint(14, 21)] + [f"z{g}_{k}" for k in range(14)]))]
    got, want = joined(frame(spark, rows)), brute.similar(rows)
    linked = [i for i, v in want.items() if v[1]]
    assert len(linked) > 100 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == v for i, v in want.items() if not v[1])


def thue_morse(k):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))


def test_regular_words_and_sequences_are_told_apart(spark):
    long = thue_morse(11)
    other = long.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(f"{long}{k}" for k in range(25))), (2, " ".join(f"{other}{k}" for k in range(25)))]
    rows += [(3, " ".join(thue_morse(6))), (4, " ".join(thue_morse(6).translate(str.maketrans("ab", "ba"))))]
    rows += [(5, "x" * 63 + "a " * 9), (6, "x" * 64 + "a " * 9), (7, "y" * 70), (8, "y" * 71)]
    assert joined(frame(spark, rows)) == brute.similar(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.cover(frame(spark, rows)).collect()}
    assert got == brute.repeats(rows) and got[2][1] == 0


def test_rows_that_repeat_an_id_have_their_own_texts(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, one), (5, two), (3, one + " more"), (5, one), (9, two), (None, two), (None, None), (None, "alone here")]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in ngramjoin.ngram_join(frame(spark, rows)).collect()), key=str)
    want = [(5, 3, 2, 36), (5, 3, 2, 36), (3, 3, 2, 37), (5, 5, 2, 36), (9, 5, 2, 36), (None, 5, 2, 36), (None, None, 0, 0), (None, None, 0, 1)]
    assert got == sorted(want, key=str)
    kept = ngramjoin.one_of_each_group(frame(spark, rows)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, one + " more"), (5, two), (None, None), (None, "alone here")], key=str)


def test_ids_may_be_strings(spark):
    rows = [(f"id{k}", f"{k % 2} the same words in every one of these {k % 2} documents") for k in range(6)]
    got = {r.doc_id: r.class_id for r in ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {f"id{k}": f"id{k % 2}" for k in range(6)}
