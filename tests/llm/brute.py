"""Plain computations the operators are held against."""

import re

import numpy as np
import xxhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Least id reachable; ``linked(a, b)`` tells whether two positions link."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                parent[root(a)] = root(b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return [least[root(i)] for i in range(len(ids))]


def simhash_components(docs):
    marks = [fingerprint(t) for _, t in docs]
    ids = [i for i, _ in docs]
    found = components(ids, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    return {i: (f"{m:016x}", c) for i, m, c in zip(ids, marks, found, strict=True)}


def _covered(windows, length, seen, size):
    gone = np.zeros(size, bool)
    for at, w in enumerate(windows):
        if w in seen:
            gone[at : at + length] = True
    return gone


def repeated_bytes(docs, length=50):
    """doc_id: bytes, removed, spans, kept."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        windows = [data[k : k + length] for k in range(len(data) - length + 1)]
        gone = _covered(windows, length, seen, len(data))
        seen.update(windows)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), spans, kept)
    return out


def passages_union(docs, length):
    """doc_id: words in a window of ``length`` words that a smaller document has too."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or ""))
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        windows = [tuple(words[k : k + length]) for k in range(len(words) - length + 1)]
        out[i] = int(_covered(windows, length, seen, len(words)).sum())
        seen.update(windows)
    return out
