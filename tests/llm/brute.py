"""Plain versions of the operators, for small tables."""

import re
from itertools import combinations

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows):
    """(doc_id, text) -> {(doc_id, n_shingles, component_id, kept)}"""
    sets = {i: shingle_set(t) for i, t in rows}
    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    pairs = {p for ids in at.values() for p in combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = groups(sets, links)
    return {(i, len(s), of[i], of[i] == i) for i, s in sets.items()}


def repeated_bytes(rows, match=100):
    """(doc_id, text) -> {(doc_id, n_bytes, n_removed, n_spans, sha256 of what is left)}"""
    import hashlib

    seen, out = set(), set()
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - match + 1):
            w = raw[s : s + match]
            if w in seen:
                gone[s : s + match] = b"\x01" * match
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.add((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out
