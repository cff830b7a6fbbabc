"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id, by):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, size=50):
    """``docs``: (doc_id, text).  Rows (doc_id, n_words, n_removed, digest)."""
    least = {}
    for doc_id, text in docs:
        if doc_id is None:
            continue
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if doc_id is not None and least[tuple(w[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def lm(docs, mu, order=3):
    """``docs``: (doc_id, text).  Rows (doc_id, held_out, n_tokens, n_known, N, base, score)."""
    grams = Counter()

    def tokens(text):
        return [*(x.translate(LOWER) for x in words(text)), None]

    for doc_id, text in docs:
        if remainder(doc_id, 7) not in (2, None):
            t = [None, *tokens(text)]
            for i in range(1, len(t)):
                grams.update((tuple(t[j : i + 1]) for j in range(max(0, i - order + 1), i + 1)))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    follow = Counter()
    for g, c in grams.items():
        follow[g[:-1]] += c

    def chance(context, x):
        if not context:
            return (grams[x,] + 1) / (n + v + 1)
        return (grams[(*context, x)] + mu * chance(context[1:], x)) / (follow[context] + mu)

    out = []
    for doc_id, text in docs:
        t = [None, *tokens(text)]
        base = score = 0.0
        for i in range(1, len(t)):
            base += math.log10(chance((), t[i]))
            score += math.log10(chance(tuple(t[max(0, i - order + 1) : i]), t[i]))
        r = remainder(doc_id, 7)
        known = sum(grams[x,] > 0 for x in t[1:])
        out.append((doc_id, None if r is None else r == 2, len(t) - 1, known, n, base, score))
    return out


def bag(text, size=5):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicate_classes(docs, least=0.8):
    """``docs``: (doc_id, text) with distinct ids.  {doc_id: smallest id of its component}."""
    bags = {d: bag(t) for d, t in docs}
    where = {}
    parent = {d: d for d in bags}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sorted(bags):
        b, n = bags[d], sum(bags[d].values())
        common = Counter()
        for s, k in b.items():
            for e, j in where.setdefault(s, {}).items():
                common[e] += min(j, k)
            where[s][d] = k
        for e, c in common.items():
            if c / (n + sum(bags[e].values()) - c) >= least:
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d in bags}
