"""Literal versions of what the operators compute."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    return WORD.findall(((text or "").translate(LOWER)) if lower else (text or ""))


def shingles(text, width=5):
    w = words(text, lower=True)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_components(rows, percent=85):
    """{doc_id: (size, component)} by comparing all pairs of documents that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = {p for ds in index.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def one_edit(a, b):
    """Whether two word lists are within one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def cut_lines(rows, least=8):
    """{doc_id: text} without lines that stand earlier or are within one edit of an earlier one."""
    seen, by_length, out = set(), {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = tuple(words(line, lower=True))
            gone = bool(w) and w in seen
            if w and not gone and len(w) >= least:
                near = [x for n in (len(w) - 1, len(w), len(w) + 1) if n >= least for x in by_length.get(n, ())]
                gone = any(one_edit(w, x) for x in near)
            if w and w not in seen:
                seen.add(w)
                by_length.setdefault(len(w), []).append(w)
            if not gone:
                kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out
