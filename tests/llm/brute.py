"""Plain versions of the operators' contracts, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=3):
    w = words(lower_ascii(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs, k=3, percent=90):
    sets = {d: shingle_set(t, k) for d, t in docs}
    inverted = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverted[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = collections.Counter(e for g in s for e in inverted[g] if e < d)
        for e, i in common.items():
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def _covered(items, size, smaller):
    gone = [False] * len(items)
    for i in range(len(items) - size + 1):
        if smaller(items[i:i + size]):
            gone[i:i + size] = [True] * size
    return gone


def word_repeats(docs, size=50):
    first, texts = {}, {}
    for d, t in docs:
        w = texts.setdefault(d, words(t))
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i:i + size])
                first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in texts.items():
        gone = _covered(w, size, lambda x: d is not None and first[tuple(x)] < d)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def byte_repeats(docs, size=50):
    first, texts = {}, {}
    for d, t in docs:
        b = texts.setdefault(d, (t or "").encode())
        if d is not None:
            for i in range(len(b) - size + 1):
                first[b[i:i + size]] = min(first.get(b[i:i + size], d), d)
    out = {}
    for d, b in texts.items():
        gone = _covered(b, size, lambda x: d is not None and first[x] < d)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def quality_base(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def topk(rows, ask, k):
    import math
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
               if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if ask(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
