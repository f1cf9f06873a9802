"""Brute-force versions of the operators, row by row in plain Python, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs):
    where = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in docs}
    key = lambda line: line.strip(SPACE).translate(LOW)
    for i, lines in split.items():
        for line in lines:
            if len(key(line)) >= 10:
                where[key(line)].add(i)
    out = {}
    for i, lines in split.items():
        kept = [x for x in lines if not (len(where.get(key(x), ())) > 1 and i != min(where[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def repeats(docs, size=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def similar(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    links, root = Counter(), {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            common = len(s & t)
            if common and common * 5 >= 4 * (len(s) + len(t) - common):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), links[i], len(s)) for i, s in sets}


def base_spans(text):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def units(text):
    return set(re.findall(r"[^\n]{1,160}", text))


def fingerprints(docs):
    rows, out = sorted(docs, key=lambda d: (d[0], d[1] or "")), []
    for k, (i, t) in enumerate(rows):
        x, y = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(x) // 2
        e = x[: len(x) - half] + y[:half]
        like = lambda p, q: 1.0 if not p and not q else 2 * len(p & q) / (len(p) + len(q))
        out.append((i, len(x), sha(e), round(like(units(x), units(e)), 9), round(like(units(x), units(y)), 9)))
    return out
