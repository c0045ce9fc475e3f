"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def near_components(docs):
    """Smallest id reachable, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def dedup_lines(docs, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if key(line):
                seen[key(line)].add(d)
    return {d: [x for x in (t or "").split("\n") if not (key(x) and len(seen[key(x)]) >= least)] for d, t in docs}
