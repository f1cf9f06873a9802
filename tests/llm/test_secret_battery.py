"""The randomness battery: its distribution, its false reports and its recall, and Benjamini-Hochberg by hand."""

import random
import string

import numpy as np
import pytest

from tidewheel.llm import secrets

ALNUM = string.ascii_letters + string.digits
WORDS = "alpha branch counter delta engine forest garden handler invoice journal kernel ladder market network object parser query river".split()


def identifier(rng):
    words = [rng.choice(WORDS).title() for _ in range(rng.randint(2, 5))]
    words.insert(rng.randint(1, len(words)), str(rng.randrange(10 ** rng.randint(1, 4))))
    return words[0].lower() + "".join(words[1:])


def draw(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("letters", [ALNUM, string.ascii_lowercase + string.digits, "0123456789abcdef", string.ascii_uppercase + "234567"])
def test_random_strings_have_uniform_u(letters):
    rng = random.Random(1)
    u = np.array([secrets.battery(draw(rng, letters, 32)) for _ in range(3000)])
    for q in (0.05, 0.1, 0.3, 0.5):
        assert q * 0.6 < (u < q).mean() < q * 1.7


def test_regular_strings_have_small_u():
    for regular in ("abababababababababababab1212121212121212", "a1" * 20, "aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd11", "chapter12OfTheSecondBookOfKings"):
        assert secrets.battery(regular) < 1e-3
    assert secrets.battery("with space") is None and secrets.battery("abc") is None


def test_cuts_are_those_of_benjamini_and_hochberg():
    rng = np.random.default_rng(4)
    null = {5: dict(enumerate(rng.integers(0, 9, 60).tolist())), 6: dict(enumerate([0] * 20 + rng.integers(0, 9, 60).tolist()))}
    items = [(int(s), int(v)) for s, v in zip(rng.integers(5, 8, 300), np.r_[rng.integers(0, 12, 150), rng.integers(0, 80, 150)], strict=True)]
    seen = {}
    for s, v in items:
        seen.setdefault(s, {})[v] = seen.get(s, {}).get(v, 0) + 1

    def p(s, v):
        strings = [lv for lv, n in null[min(s, 6)].items() for _ in range(n)]
        return (1 + sum(lv <= v for lv in strings)) / (1 + len(strings))

    ranked = sorted(p(s, v) for s, v in items)
    limit = max([x for k, x in enumerate(ranked, 1) if x <= secrets.FALSE_RATE * k / len(ranked)], default=0)
    cut = secrets.cuts(seen, null)
    assert [v < cut[s] for s, v in items] == [p(s, v) <= limit for s, v in items] and 0 < sum(v < cut[s] for s, v in items) < 300
    assert secrets.cuts({}, null) == {}


def reported(spark, rows):
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    return {r.doc_id: [text[r.doc_id][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r.spans.split(",") if x.startswith("random")] for r in got}


def test_false_reports_and_recall_on_a_mix(spark):
    rng = random.Random(9)
    names = [identifier(rng) for _ in range(1000)]
    keys = [draw(rng, rng.choice([ALNUM, ALNUM, string.ascii_lowercase + string.digits, ALNUM + "-_"]), rng.choice((20, 24, 32, 40))) for _ in range(400)]
    rows = [(k, f"we then set {x} in the file") for k, x in enumerate(names + keys)]
    got = reported(spark, rows)
    false = sum(bool(got[k]) for k in range(1000))
    true = sum(bool(got[k]) for k in range(1000, 1400))
    assert true >= 0.9 * 400 and false <= 0.07 * (false + true)


def test_runs_are_cut_where_no_alphabet_fits(spark):
    rng = random.Random(2)
    keys = [draw(rng, ALNUM, 40) for _ in range(30)]
    rows = [(k, f"see /user_data/v1/{x} and my-own_part/{x}+rest") for k, x in enumerate(keys)]
    rows += [(100, "token=abcdefgh1234/" + keys[0]), (101, "a" * 5000), (102, None), (103, ""), (104, "4785380592391139 internationalization HELLOHELLOHELLO")]
    got = reported(spark, rows)
    assert sum(sum(x in span for span in got[k]) >= 2 for k, x in enumerate(keys)) >= 27
    assert not any(got[k] for k in range(100, 105))


def test_rare_secrets_among_many_names():
    """A table's cuts, taken from its candidates: of tables with one key of 40 characters, four in five report it."""
    rng, null, seen = random.Random(11), secrets.base_null(), {}
    for _ in range(10_000):
        if f := secrets._tested(identifier(rng)):
            seen.setdefault(f["size"], {})[f["level"]] = seen.get(f["size"], {}).get(f["level"], 0) + 1

    def reports(s):
        cut = secrets.cuts(s, null)
        return sum(n for size, levels in s.items() for lv, n in levels.items() if lv < cut[size])

    assert reports(seen) == 0
    hits = 0
    for _ in range(50):
        f = secrets._tested(draw(rng, ALNUM, 40))
        one = {size: dict(levels) for size, levels in seen.items()}
        one[f["size"]][f["level"]] = one[f["size"]].get(f["level"], 0) + 1
        n = reports(one)
        assert n <= 1
        hits += n
    assert hits >= 40


@pytest.mark.parametrize("keys", [0, 5])
def test_few_secrets_in_a_table_of_names(spark, keys):
    rng = random.Random(12)
    names = [identifier(rng) for _ in range(10_000)]
    secret = [draw(rng, ALNUM, 40) for _ in range(keys)]
    got = {k for k, v in reported(spark, [(k, f"we then set {x} in the file") for k, x in enumerate(names + secret)]).items() if v}
    assert got <= set(range(10_000, 10_000 + keys)) and len(got) >= 0.6 * keys


def test_the_tail_is_no_smaller_than_what_many_more_strings_show():
    rng = random.Random(5)
    levels = {}
    for _ in range(120_000):
        if f := secrets._tested(secrets.ordinary(rng.choices(secrets.BASE_WORDS, k=12), rng)):
            levels.setdefault(f["size"], []).append(f["level"])
    null = secrets.base_null()
    for size in (5, 6):
        p, many = secrets.p_values(null[size]), np.array(levels[size])
        assert all(a <= b for a, b in zip(p, p[1:], strict=False))
        for lv in range(0, 120, 5):
            share = (many <= lv).mean()
            assert p[lv] >= share - 3 * np.sqrt(max(share, 1 / len(many)) / len(many)), (size, lv)
    assert secrets.p_values({20: 10})[20] == 1 and secrets.p_values({20: 10})[10] == 1 / 11
