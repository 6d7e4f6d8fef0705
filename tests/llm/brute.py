"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def dedup(rows):
    """[(doc_id, text)] -> sorted [(doc_id, keep_id, group_size, kept, sha)]; ids are distinct."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[normalised(t)].append((-len(t or ""), d))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is None, m[1] or 0))[1]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, d in members]
    return out


def remove_repeats(rows, window=35):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, sha)]"""
    split = [(d, words(t)) for d, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    """[(doc_id, text)] -> {place: (doc_id, n_shingles, component_id)}; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    ids = [d for d, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        known = [x for x in (low.get(root(i)), ids[i]) if x is not None]
        low[root(i)] = min(known) if known else None
    return [(ids[i], len(sets[i]), low[root(i)]) for i in range(len(rows))]


def targets(sizes, weights, limit=3):
    """{source: size}, {source: weight} -> {source: target}: what is over the limit is shared again until nothing is."""
    left, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > limit * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= over
    return out
