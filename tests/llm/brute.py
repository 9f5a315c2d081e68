"""Plain, slow versions of the operators, for small inputs."""

import hashlib
from collections import Counter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(rows):
    """rows: (doc_id, text); a list of (doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i) if s else i) for i, s in sets)


def substrings(rows, window=50):
    first, texts = {}, [(i, words(t)) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def grams(text, n):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1))


def contained(rows, items):
    """An item of n < 5 words is compared by its n-word sequence, others by 5-word shingles."""
    lengths = [(i, t, min(5, len(words(t)))) for i, t in items if i is not None and words(t)]
    sets = [(i, n, grams(t, n)) for i, t, n in lengths]
    out = []
    for i, t in rows:
        mine = {n: grams(t, n) for n in {n for _, n, _ in sets}}
        found = [(-len(q & mine[n]) / len(q), k) for k, n, q in sets if 100 * len(q & mine[n]) >= 75 * len(q)]
        best = min(found, default=None)
        out.append((i, best and best[1]))
    return sorted(out, key=lambda x: x[0])


def repeated_words(w, n=8):
    c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    covered = set()
    for i in range(len(w) - n + 1):
        if c[tuple(w[i : i + n])] > 1:
            covered.update(range(i, i + n))
    return len(covered)
