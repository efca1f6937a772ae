"""Plain forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(
        bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def linked(rows, size, part, over):
    """[(doc_id, n, component)] of rows (doc_id, text)."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    by_shingle = defaultdict(set)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                by_shingle[x].add(i)
    edges = set()
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        shared = Counter(j for x in s for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if over * n >= part * (len(s) + len(sets[j][1]) - n):
                edges.add((d, sets[j][0]))
    found = union_find({d for d, _ in sets if d is not None}, edges)
    return sorted(((d, len(s), found.get(d)) for d, s in sets), key=repr)


def removed(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of rows (doc_id, text)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
