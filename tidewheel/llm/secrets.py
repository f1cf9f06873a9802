"""Secret scan: three fixed patterns, and a battery of randomness tests under false-discovery control.

Patterns (leftmost, not overlapping within a kind, too short matches dropped): assign, access, hex, below.

The battery looks at what is left of runs of CANDIDATE characters outside those spans, whole and cut at / - _ +,
that is MIN_CHARS long and neither a plain word (one capital at most, in front) nor a number. Its encoding is
inferred as the smallest alphabet that holds it (hex, base32, alphanumeric, base64). Three tests ask how far it is
from uniform over that alphabet: chi-squared on the counts of the alphabet's cells (common and rare letters of
either case, digits, signs), runs of one kind of character, and serial correlation at lag 1; Fisher's method joins
their p-values to one, u, small for regular strings and uniform on [0, 1] for random ones.

Control of false reports: the null hypothesis is ordinary text. Its distribution of u, per class of length (powers of
two), comes from strings made of the corpus's own words, joined with capitals, numbers and signs as identifiers are
(one per MADE_EVERY characters of every document), and of BASE_WORDS (BASE_MADE per class), so that small corpora have
one. A candidate's p-value is the share of such strings with a u as large as its own; where fewer than TAIL of them
have one, it goes on as a power of -log u, Hill's index of the TAIL most random ones less its standard error: else no
table could report a few secrets among many names, whose p-values have to be under rate / candidates. It is not carried
on beyond TAIL_END, where the strings' own chance is no power any more. Benjamini-Hochberg at FALSE_RATE
over all candidates, with a cut of its own in each class of length, decides which are reported as `random`. All u are
counted in LEVELS logarithmic bins per class, so the driver sees tables of fixed size.

A run reported whole isn't reported in pieces. Cases: a null text counts as empty; empty texts have no spans and the
digest of the empty string; repeated rows get equal answers; offsets are code points, end exclusive; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import saved

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
#: One of these is in any text, lower-cased, that ASSIGN matches.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]*")
#: Short prose words, from which ordinary strings are made.
WORDS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,11}(?![A-Za-z0-9+/_-])")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("lower", LOWER + DIGITS),
    ("upper", UPPER + DIGITS),
    ("alnum", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
#: Letters common in prose, and words for ordinary strings where the corpus has few.
COMMON = "etaoinsr"
BASE_WORDS = (
    "about after again all also and any are back because before book but call can case change chapter child city come company config "
    "could country data date day down each end even every eye fact file find first for from get give good government great group hand "
    "have high home house how image index into its just know large last leave life list little live long look make man many module month "
    "more most mother name need never new next night not number one only order other out over page part people place point problem "
    "program public question report right room same say school section see service should show small some state still story student "
    "study such system table take tell than that the their them then there these they thing think this time two under use user value "
    "version very want was water way week well what when where which while who will with woman word work world would write year your"
).split()
MIN_CHARS, FALSE_RATE, LEVELS, MADE_EVERY, BASE_MADE = 12, 0.05, 400, 4000, 10_000
#: Ordinary strings of a class whose tail is fitted (and the share of the class, where that is more), the fewest in the
#: class for a fit, and the level (u of about 1/3) at which it ends.
TAIL, TAIL_SHARE, TAIL_LEAST, TAIL_END = 30, 0.002, 1000, 9


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3


def _cell(c: str) -> int:
    k = _kind(c)
    return k if k > 1 else 4 + 2 * k + (c.lower() in COMMON)


class _Alphabet:
    """An encoding's letters, with what uniform draws from them give: cells, kinds and changes of kind."""

    def __init__(self, letters: str):
        self.code = {c: i for i, c in enumerate(letters)}
        self.size, n = len(letters), len(letters)
        self.cells: dict[int, float] = {}
        kinds: dict[int, int] = {}
        for c in letters:
            self.cells[_cell(c)] = self.cells.get(_cell(c), 0) + 1 / n
            kinds[_kind(c)] = kinds.get(_kind(c), 0) + 1
        same = [k / n for k in kinds.values()]
        self.change = 1 - sum(p * p for p in same)  # chance that a neighbour is of another kind
        # variance per pair, and covariance of neighbouring pairs, of the number of changes
        self.spread = self.change * (1 - self.change)
        self.shared = 1 - 2 * sum(p * p for p in same) + sum(p**3 for p in same) - self.change**2


_ALPHABETS = [_Alphabet(a) for _, a in ALPHABETS]


def _chi_tail(x: float, d: int) -> float:
    """P(chi-squared with d degrees of freedom > x), by Wilson and Hilferty's cube root."""
    return _upper_tail(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def battery(body: str) -> float | None:
    """u: Fisher's joint p-value of being uniform over the inferred alphabet; None if no alphabet fits."""
    letters = set(body)
    alphabet = next((a for a in _ALPHABETS if letters <= a.code.keys()), None)
    n = len(body)
    if alphabet is None or n < 4:
        return None
    x, held = [alphabet.code[c] for c in body], dict.fromkeys(alphabet.cells, 0)
    for c in body:
        held[_cell(c)] += 1
    chi = sum((held[k] - n * p) ** 2 / (n * p) for k, p in alphabet.cells.items())
    p_cells = _chi_tail(chi, len(alphabet.cells) - 1)
    often = sum(v * (v - 1) for v in (body.count(c) for c in letters))  # pairs of equal letters
    mean = n * (n - 1) / alphabet.size
    p_repeat = _upper_tail((often - mean) / math.sqrt(2 * mean * (1 - 1 / alphabet.size))) if often > mean else 1.0
    changes = sum(_kind(a) != _kind(b) for a, b in zip(body, body[1:], strict=False))
    sd = math.sqrt(max(1e-9, (n - 1) * alphabet.spread + 2 * (n - 2) * alphabet.shared))
    p_runs = 2 * _upper_tail(abs(changes - (n - 1) * alphabet.change) / sd)
    m = sum(x) / n
    square = sum((v - m) ** 2 for v in x)
    r = sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / square if square else 1.0
    p_serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(1e-300, min(1.0, p))) for p in (min(1.0, 2 * min(p_cells, p_repeat)), p_runs, p_serial))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def level(u: float) -> int:
    """The bin of u: 0 holds those near 1, LEVELS - 1 the smallest."""
    return min(LEVELS - 1, int(-20 * math.log10(max(u, 1e-300))))


def ordinary(words: list[str], rng: random.Random) -> str:
    """A string as identifiers have them: some words joined with capitals, numbers or signs."""
    style, n = rng.randrange(6), rng.choice((12, 14, 17, 20, 24, 28, 34, 40, 50, 64))
    out, i = "", 0
    number = rng.randrange(4)
    while len(out) < n:
        w = words[i % len(words)]
        w = w.upper() if style == 3 else w.lower() if style in (1, 4, 5) or style == 0 and not out else w[:1].upper() + w[1:].lower()
        out += ("_" if style == 4 else "-" if style == 5 else "") * bool(out) + w + (str(rng.randrange(10 ** rng.randint(1, 4))) if i == number else "")
        i += 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tested(body: str) -> dict | None:
    """Class of length and level of a string that may be a secret."""
    if len(body) < MIN_CHARS or PLAIN.fullmatch(body) or (u := battery(body)) is None:
        return None
    return {"size": len(body).bit_length(), "level": level(u)}


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Strings for the battery: start, end, class of length, level; a run before its pieces."""
    out, starts = [], [b[0] for b in base]
    for m in CANDIDATE.finditer(text):
        at, parts = m.start(), []
        for k in range(max(0, bisect_left(starts, at) - 3), len(base)):  # what base spans leave of the run; three kinds may overlap
            s, _, e = base[k]
            if s >= m.end():
                break
            if e > at:
                if s > at:
                    parts.append((at, s))
                at = e
        parts.append((at, m.end()))
        for s, e in parts:
            body = text[s:e].rstrip("=")
            if found := _tested(body):
                out.append({"start": s, "end": max(s + len(body), e), **found})
            pieces = list(re.finditer("[A-Za-z0-9]+", body))
            if len(pieces) > 1 or pieces and len(pieces[0][0]) < len(body):
                out += [{"start": s + p.start(), "end": s + p.end(), **f} for p in pieces if (f := _tested(p[0]))]
    return out


def made(text: str) -> list[dict]:
    """Ordinary strings of this text's words, one per MADE_EVERY characters, chosen by the words themselves."""
    if len(text) < 200:
        return []
    words = [m[0] for m in WORDS.finditer(text)]
    if len(words) < 8:
        return []
    rng = random.Random(hashlib.md5(text[:4096].encode(), usedforsecurity=False).digest())
    out = []
    for _ in range(-(-len(text) // MADE_EVERY)):
        i = rng.randrange(len(words))
        if found := _tested(ordinary((words[i : i + 12] + words[:12])[:12], rng)):
            out.append(found)
    return out


def base_null() -> dict[int, dict[int, int]]:
    """Counts by class of length and level of ordinary strings made of BASE_WORDS."""
    rng, out = random.Random(1), {}
    for _ in range(4 * BASE_MADE):
        if found := _tested(ordinary(rng.choices(BASE_WORDS, k=12), rng)):
            levels = out.setdefault(found["size"], {})
            levels[found["level"]] = levels.get(found["level"], 0) + 1
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("level", pa.int32())]))
    null = pa.list_(pa.struct([("size", pa.int32()), ("level", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, cands, nulls, sums = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                cands.append(candidates(text, base))
                nulls.append(made(text))
                sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(cands, cand), pa.array(nulls, null), pa.array(sums, pa.string())], ["doc_id", "base", "cands", "nulls", "base_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, cands array<struct<start:int,end:int,size:int,level:int>>, nulls array<struct<size:int,level:int>>, base_sha256 string")


def p_values(null: dict[int, int]) -> list[float]:
    """Per level, the chance of an ordinary string at that level or under: their share, one more counted for the candidate
    itself, and below the level that TAIL of them reach a power fitted to those."""
    below, total, p, tail = 1, 1 + sum(null.values()), [], max(TAIL, int(TAIL_SHARE * sum(null.values())))
    for lv in range(LEVELS):
        below += null.get(lv, 0)
        p.append(min(1.0, below / total))
    start = next((lv for lv in range(LEVELS) if p[lv] * total > tail), 0)
    if total <= TAIL_LEAST or start <= TAIL_END:
        return p
    logs = [(math.log((start + 1) / (max(lv, TAIL_END) + 0.5)), n) for lv, n in null.items() if lv <= start]
    held, spread = sum(n for _, n in logs), sum(x * n for x, n in logs)
    index = held / spread * (1 - held**-0.5)
    return [p[start] * ((max(lv, TAIL_END) + 1) / (start + 1)) ** index if lv < start else p[lv] for lv in range(LEVELS)]


def cuts(seen: dict[int, dict[int, int]], null: dict[int, dict[int, int]], rate: float = FALSE_RATE) -> dict[int, int]:
    """Per class of length, the level under which candidates are reported: Benjamini-Hochberg over all of them.

    Classes without ordinary strings take those of the next smaller one: longer strings are told apart better.
    """
    p, pooled = {}, {}
    for size in sorted(set(seen) | set(null)):
        pooled = null.get(size) or pooled
        p |= {(size, lv): x for lv, x in enumerate(p_values(pooled))}
    total, reported, limit = sum(sum(v.values()) for v in seen.values()), 0, 0.0
    for value, n in sorted((p[size, lv], n) for size, levels in seen.items() for lv, n in levels.items()):
        reported += n
        if value * total <= rate * reported:
            limit = value
    return {size: sum(p[size, lv] <= limit for lv in range(LEVELS)) for size in seen}


def _counted(found: DataFrame, column: str) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for r in found.select(F.explode(column).alias("c")).groupBy("c.size", "c.level").count().collect():
        out.setdefault(r["size"], {})[r["level"]] = r["count"]
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = saved(scan(docs, id_col, text_col), "secret-scan")
    null = base_null()
    for size, levels in _counted(found, "nulls").items():
        for lv, n in levels.items():
            null.setdefault(size, {})[lv] = null.get(size, {}).get(lv, 0) + n
    limits = cuts(_counted(found, "cands"), null)
    good = F.filter("cands", lambda c: keep_if(c, limits))
    whole = F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & ((b["end"] - b["start"]) > (a["end"] - a["start"]))
    extra = F.filter(whole, lambda a: ~F.exists(whole, lambda b: inside(a, b)))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(F.sort_array(F.concat("base", F.when(F.size("cands") > 0, extra).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", number(0), number(1), number(2), "base_sha256", text.alias("spans"))


def keep_if(c, limits: dict[int, int]):
    """Column: whether a candidate is reported in its class of length."""
    ok = F.lit(False)
    for size, cut in sorted(limits.items()):
        ok = ok | ((c["size"] == size) & (c["level"] < cut))
    return ok
