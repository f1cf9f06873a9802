"""Runs against a brute-force search over all starts and periods, and the query against the contract by hand."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from tidewheel.llm import periodic
from tidewheel.llm.queries import runs_digest


def brute(x, least=6, times=4):
    n, out = len(x), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j - i >= p:
                smaller = any(all(x[k] == x[k + q] for k in range(i, j + p - q)) for q in range(1, p))
                if not smaller and j + p - i >= max(least, times * p):
                    out.add((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(x, least=6, times=4):
    got = periodic.runs_of(np.append(np.array(x, np.int64), 10**6), least, times)
    return list(zip(*(a.tolist() for a in got), strict=True))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for trial in range(400):
        n, letters = rng.randint(1, 60), rng.randint(1, 4)
        x = [rng.randrange(letters) for _ in range(n)]
        if trial % 2:
            block = [rng.randrange(3) for _ in range(rng.randint(1, 7))]
            x[rng.randint(0, n) : 0] = (block * 9)[: rng.randint(1, 50)]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            assert found(x, least, times) == brute(x, least, times), (x, least, times)


def test_long_runs_and_nested_ones():
    assert found([7] * 5000) == [(0, 5000, 1)]
    assert found([1, 2] * 3000 + [5] + [1, 2] * 4) == [(0, 6000, 2), (6001, 8, 2)]
    nested = ([1] * 6 + [2]) * 5
    assert found(nested) == brute(nested)
    assert found([]) == [] and found([1]) == []


def test_best_run_is_exact():
    a = np.array
    assert periodic.best(a([9, 3, 3]), a([12, 8, 40]), a([3, 2, 10])) == 1


def edited(i, w):
    h = zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


def test_query_against_the_contract(spark, odd, odd_rows, none, with_null_id):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rng = random.Random(8)
    more = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 90)))) for k in range(1000, 1200)]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(tuple(r) for r in runs_digest(frame).collect())
    want = []
    for i, t in [(r[0], r[1]) for r in odd_rows] + more:
        w = edited(i, (t or "").encode().split())
        small = w if len(w) < 3000 else None
        runs = brute(small) if small is not None else [tuple(map(int, r)) for r in zip(*next(iter(periodic._judged([w], 6, 4))), strict=True)]
        keep = [not any(s + p <= k < s + n for s, n, p in runs) for k in range(len(w))]
        s, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        want.append((i, len(runs), s, n, p, 1000 * n // p if runs else None, sha("".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()), sha(b" ".join(x for x, y in zip(w, keep, strict=True) if y))))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(r[1]) for r in want) > 10
    assert runs_digest(none).count() == 0
    assert runs_digest(with_null_id).count() == with_null_id.count()


def test_operator_gives_texts_and_spans(spark):
    rows = [(1, "so so so so so so it goes"), (2, None), (3, "a b a b a b a b a c")]
    got = {r.doc_id: r for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].collapsed == "so it goes" and [tuple(x) for x in got[1].runs] == [(0, 6, 1)]
    assert got[2].collapsed == "" and got[2].best is None and got[2].runs == []
    assert got[3].collapsed == "a b c" and tuple(got[3].best) == (0, 9, 2)
