"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)

    def least(self, keys):
        out = {}
        for i, k in enumerate(keys):
            if k is not None:
                out[self.find(i)] = min(k, out.get(self.find(i), k))
        return [out.get(self.find(i)) for i in range(len(keys))]


def jaccard(rows, k, percent):
    """(key, set size, least key reachable) by row."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    holders, union = collections.defaultdict(list), Union(len(rows))
    for i, s in enumerate(sets):
        met = collections.Counter(j for g in s for j in holders[g])
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
        for g in s:
            holders[g].append(i)
    return [(key, len(s), lead if s else key) for (key, _), s, lead in zip(rows, sets, union.least([r[0] for r in rows]))]


def all_copies_removed(rows, length):
    """(key, words, words removed, hash of the rest): every window met twice goes."""
    seen, lists = collections.Counter(), [words(t) for _, t in rows]
    for w in lists:
        seen.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(rows, lists):
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out.append((key, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def later_copies_removed(rows, length):
    """(key, words, words removed): all but the first window, by key and position, go.  Equal rows count once."""
    unique = sorted({(math.inf if k is None else k, t or "") for k, t in rows})
    lists, met = {r: words(r[1]) for r in unique}, collections.defaultdict(list)
    gone = {r: [False] * len(lists[r]) for r in unique}
    for r in unique:
        for j in range(len(lists[r]) - length + 1):
            met[tuple(lists[r][j : j + length])].append((r, j))
    for places in met.values():
        for r, j in places[1:]:
            gone[r][j : j + length] = [True] * length
    return [(k, len(lists[r]), sum(gone[r])) for k, t in rows for r in [(math.inf if k is None else k, t or "")]]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w, at, covered, seen, dup = words(text), collections.defaultdict(list), set(), set(), 0
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(x for i in places for x in (i, i + 1, i + 2))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def cosine(rows, limit):
    """{key: (links, least key reachable)}."""
    good = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, union = np.zeros(len(rows), int), Union(len(rows))
    for size in {len(rows[i][1]) for i in good}:
        own = np.array([i for i in good if len(rows[i][1]) == size])
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= limit
        np.fill_diagonal(near, False)
        links[own] = near.sum(1)
        for a, b in zip(*np.nonzero(near)):
            union.join(own[a], own[b])
    return {k: (int(n), lead) for (k, _), n, lead in zip(rows, links, union.least([r[0] for r in rows]))}


def unigram(rows, modulus=7):
    """{key: (held out, tokens, known tokens, training tokens, base score)}."""
    lists = [(k, words((t or "").translate(LOWER)) + [None]) for k, t in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % modulus == 2
    c = collections.Counter(x for k, w in lists if not held(k) for x in w)
    n, v = sum(c.values()), len(c)
    return {k: (held(k), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in lists}
