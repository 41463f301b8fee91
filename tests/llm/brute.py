"""Plain re-statements of the contracts, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(fold(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_components(docs):
    """{doc_id: (n_shingles, component)} by an inverted index over all shingles."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = {}
    for d in sorted(sets):
        count = {}
        for s in sets[d]:
            for o in seen.get(s, ()):
                count[o] = count.get(o, 0) + 1
            seen.setdefault(s, []).append(d)
        for o, both in count.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[o]) - both):
                a, b = find(o), find(d)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, window=20):
    """{row number: (n_words, n_removed, kept words joined)} for rows (doc_id, text)."""
    first, split = {}, [WORD.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, split):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, _), w in zip(docs, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out
