"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}).encode())
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and votes[b] * 2 > len(shingles))


def components(ids, prints, most=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def line_dedup(rows):
    """{id: (kept text, lines, removed)} for distinct ids."""
    lines = [((i, n), line) for i, t in sorted(rows.items()) if t is not None for n, line in enumerate(t.split("\n"))]
    seen, gone = [], set()
    for at, line in lines:
        s = {w for w in line.split(" ") if w}
        if s:
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.add(at)
            seen.append(s)
    out = {}
    for i, t in rows.items():
        own = [] if t is None else t.split("\n")
        kept = [x for n, x in enumerate(own) if (i, n) not in gone]
        out[i] = (None if t is None else "\n".join(kept), len(own), len(own) - len(kept))
    return out


def leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs.items():
        w = words(t)
        for i, b in items.items():
            v, at, best = words(b), set(), 0
            if 5 <= len(v) < 12:
                size = len(v)
                agree = {p: sum(x == y for x, y in zip(w[p : p + size], v)) for p in range(len(w) - size + 1)}
                at = {p for p, n in agree.items() if 5 * n >= 4 * size}
                best = max(agree.values(), default=0)
            else:
                size = 12
                for p in range(len(w) - 11):
                    for q in range(len(v) - 11):
                        n = sum(x == y for x, y in zip(w[p : p + 12], v[q : q + 12]))
                        if n >= 10:
                            at.add(p)
                            best = max(best, n)
            if at:
                out[d, i] = (len(at), min(at), max(at) + size, best)
    return out


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((edges.reshape(-1, 2).tolist(), bytes(x for x, g in zip(b, gone) if not g)))
    return out
