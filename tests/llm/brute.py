"""Slow direct versions of what the operators return, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near_components(docs, size=4):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component)}."""
    sets = [(d, shingle_set(t, size)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by_shingle: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    for k, (d, s) in enumerate(sets):
        common: dict[int, int] = {}
        for x in s:
            for j in by_shingle[x]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = root(d), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}
