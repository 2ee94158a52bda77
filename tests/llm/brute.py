"""Plain statements of the contracts, for small tables."""

import re
import zlib
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return {n: min(g) for g in out.values() for n in g}


def near(rows, percent=85):
    """doc_id -> (n_shingles, component) of (doc_id, text) rows with distinct ids."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {p for ds in holders.values() for p in combinations(sorted(ds), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(sets, links)
    return {d: (len(sets[d]), found[d]) for d in sets}


def crc(text):
    return zlib.crc32(text.encode())
