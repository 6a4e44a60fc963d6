"""The contracts, spelt out slowly in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def removed(rows, length=50):
    """doc_id -> mask of removed bytes; of rows (doc_id, text)."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                mask[i : i + length] = b"\1" * length
        out[doc] = bytes(mask)
    return out


def kept_sha(text, mask):
    return hashlib.sha256(bytes(b for b, m in zip((text or "").encode(), mask, strict=True) if not m)).hexdigest()


def leaks(rows, items, window=10):
    """doc_id -> (n_words, n_hit, sorted items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in rows:
        w = TERM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def base_scores(rows, held_out):
    from math import log10

    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    c = Counter(x for i, ts in tokens.items() if not held_out(i) for x in ts)
    total, types = sum(c.values()), len(c)
    return total, {i: (len(ts), sum(c[x] > 0 for x in ts), sum(log10((c[x] + 1) / (total + types + 1)) for x in ts)) for i, ts in tokens.items()}
