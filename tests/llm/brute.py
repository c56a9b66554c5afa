"""Plain versions of the operators' results, over a list of texts."""

import re

import numpy as np


def shingles(text):
    lowered = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    """For each set the place of the first one that links reach."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def covered(texts, length=200):
    """For each text (bytes) a mask of the bytes that a string occurring elsewhere covers."""
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            k = t[s:s + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                mask[s:s + length] = True
        out.append(mask)
    return out
