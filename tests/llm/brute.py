"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near(docs, k, num=80, den=100):
    sets = [(d, shingles(t, k)) for d, t in docs]
    index = defaultdict(list)
    for r, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(r)
    links = []
    for r, (d, s) in enumerate(sets):
        for q, n in Counter(q for x in s for q in index[x] if q < r).items():
            if den * n >= num * (len(s) + len(sets[q][1]) - n):
                links.append((sets[q][0], d))
    comp = components({d for d, _ in docs}, links)
    return sorted((d, len(s), comp[d], comp[d] == d) for d, s in sets)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[p : p + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        hit, own = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if (x := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    own |= windows[x]
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(own), digest, bool(hit)))
    return sorted(out)


def repeats(docs, length=400):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(b[i : i + length] if length < 100 else hash(b[i : i + length]) for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length] if length < 100 else hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
