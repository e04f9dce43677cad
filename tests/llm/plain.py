"""Plain versions of the operators, row by row, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = WORD.findall((text or "").encode().translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """By id: set size, smallest id reachable, links."""
    sets = {i: shingles(t) for i, t in rows}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    up, links = {i: i for i in sets}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        both = Counter(j for x in s for j in lists[x])
        for j, n in both.items():
            if i != j and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), links[i]) for i, s in sets.items()}


def repeats_cut(texts: list[str | None], length: int) -> list[tuple[int, int, bytes]]:
    """Removed bytes, runs and what is left of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out
