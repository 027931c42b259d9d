"""Plain readings of the contracts, to hold the operators against."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept_words(rows, window=20):
    """[(n_words, n_removed, kept_text)] of (doc_id, text) rows in ascending order."""
    seen, out = set(), []
    for _, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def component_ids(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: top(i) for i, _ in rows}


def benchmark_hits(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    of = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            of[tuple(w[i:i + window])].add(str(item))
    out = []
    for _, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in of}:
            for i in range(len(w) - n + 1):
                if ids := of.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if fits[kind](m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def unigram_scores(rows):
    tokens = [words(lower(t)) + [None] for _, t in rows]
    c = Counter(x for (i, _), ts in zip(rows, tokens) if zlib.crc32(str(i).encode()) % 10 for x in ts)
    total, types = sum(c.values()), len(c)
    return [(len(ts), sum(c[x] > 0 for x in ts), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in ts)) for ts in tokens]
