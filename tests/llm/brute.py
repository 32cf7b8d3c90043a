"""Brute-force near duplicates, which several tests use."""

import re
from collections import defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").translate(UP).encode())
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(texts, num, width=5):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        seen = defaultdict(int)
        for s in sets[i]:
            for j in by[s]:
                seen[j] += 1
            by[s].append(i)
        for j, n in seen.items():
            if 100 * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}
