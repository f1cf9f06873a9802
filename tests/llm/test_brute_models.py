"""Language ID and the quality trees against plain Python versions, document by document and split by split."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewheel.llm import langid, quality


def grams(text):
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return out
    padded = " " + " ".join(words) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:most]]


def test_language_by_brute_force(odd, odd_rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    totals = defaultdict(Counter)
    for i, text, lang, *_ in odd_rows:
        if lang is not None and text is not None and not held(i):
            totals[lang].update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c, 300))} for lang, c in totals.items()}
    want = []
    for i, text, *_ in odd_rows:
        own = ranked(grams(text or ""), 300)
        if not own:
            want.append((i, held(i), "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want.append((i, held(i), best, 1 - away[best] / (300 * len(own))))
    got = [tuple(r) for r in langid.identify(odd).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-12)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).round(1).astype(np.float32)  # ties within features
    y = (x[:, 1] + x[:, 3] * x[:, 0] + rng.normal(0, 0.5, 300) > 0).astype(float)
    return x, y


def test_first_tree_by_exhaustive_search(sample):
    x, y = sample
    model = quality.fit(x, y, trees=1)
    p = y.mean()
    g, h = (p - y).tolist(), [p * (1 - p)] * len(y)
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]))) for f in range(x.shape[1])]

    def gain(rows, f, at):
        left = [r for r in rows if x[r, f] <= at]
        right = [r for r in rows if x[r, f] > at]
        if min(sum(h[r] for r in left), sum(h[r] for r in right)) < 1:
            return 0.0
        part = lambda some: sum(g[r] for r in some) ** 2 / (sum(h[r] for r in some) + quality.L2)
        return part(left) + part(right) - part(rows)

    nodes = {0: list(range(len(y)))}
    for node in range(2**quality.DEPTH - 1):
        rows, f, at = nodes[node], model.feature[0, node], model.threshold[0, node]
        best = max((gain(rows, k, e) for k in range(x.shape[1]) for e in edges[k]), default=0.0) if node < 3 else None
        if best is not None:
            assert (gain(rows, f, at) if np.isfinite(at) else 0.0) == pytest.approx(best, abs=1e-6)
        nodes[2 * node + 1], nodes[2 * node + 2] = [r for r in rows if x[r, f] <= at], [r for r in rows if x[r, f] > at]
    for k in range(2**quality.DEPTH):
        rows = nodes[2**quality.DEPTH - 1 + k]
        assert model.leaf[0, k] == pytest.approx(-quality.RATE * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + quality.L2), abs=1e-9)


def test_scores_by_walking_the_trees(sample):
    x, y = sample
    model = quality.fit(x, y, trees=12)

    def walk(t, row, node=0):
        if node >= 2**quality.DEPTH - 1:
            return model.leaf[t, node - (2**quality.DEPTH - 1)]
        return walk(t, row, 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1))

    for row, score in zip(x, model.score(x), strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(-model.base - sum(walk(t, row) for t in range(12)))), abs=1e-12)
