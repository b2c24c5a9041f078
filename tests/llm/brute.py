"""Plain versions of the operators, for comparison on small tables."""

import re
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i: i + 5]) for i in range(len(words) - 4)])


def near_components(rows):
    """[(doc_id, n_shingles, component_id, kept)] of (doc_id, text) rows, by all pairs of distinct sets."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=lambda s: (len(s), hash(s)))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(distinct):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {p for ks in where.values() for p in combinations(ks, 2)}
    for a, b in pairs:
        x, y = distinct[a], distinct[b]
        if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    at = {s: k for k, s in enumerate(distinct)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            r = find(at[s])
            least[r] = min(i, least.get(r, i))
    out = []
    for i, s in sets:
        c = least.get(find(at[s])) if s else i
        out.append((i, len(s), c, i == c))
    return out
