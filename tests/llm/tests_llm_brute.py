"""Brute-force versions that several tests compare with."""

import collections
import re

import xxhash

from courtline.llm.suffixes import retained
from courtline.llm.words import word_hashes

LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {n: root(n) for n in nodes}


def shared_words(texts, width, spare_first=False):
    """For every text (id, text): which of its words stand in a run of ``width`` words that another id has as well."""
    words = [t.translate(LOWER).encode().split() for _, t in texts]
    where = collections.defaultdict(set)
    for (i, _), w in zip(texts, words, strict=True):
        for a in range(len(w) - width + 1):
            where[tuple(w[a : a + width])].add(i)
    out = []
    for (i, _), w in zip(texts, words, strict=True):
        covered = [False] * len(w)
        for a in range(len(w) - width + 1):
            owners = where[tuple(w[a : a + width])]
            if min(owners) < i if spare_first else len(owners) > 1:
                covered[a : a + width] = [True] * width
        out.append(covered)
    return out


def joined(covered, gap, least):
    """Spans of covered words at most ``gap`` words apart that reach ``least`` words."""
    spans = []
    for a, c in enumerate(covered):
        if c and spans and a - spans[-1][1] <= gap:
            spans[-1][1] = a + 1
        elif c:
            spans.append([a, a + 1])
    return [(a, b) for a, b in spans if b - a >= least]


def matched_words(texts, spare_first=False, run=8, span=12, least=50):
    """For every text (id, text): its words in matches, by comparing every two retained suffixes word by word."""
    words = [t.translate(LOWER).encode().split() for _, t in texts]
    kept = [retained(word_hashes(w), run, span)[0].tolist() if len(w) >= least else [] for w in words]
    at = collections.defaultdict(list)
    for k, places in enumerate(kept):
        for p in places:
            at[tuple(words[k][p : p + run])].append((k, p))
    out = []
    for (doc, _), w, places in zip(texts, words, kept, strict=True):
        covered = [False] * len(w)
        for p in places:
            for j, q in at[tuple(w[p : p + run])]:
                other, v = texts[j][0], words[j]
                if other >= doc if spare_first else other == doc:
                    continue
                left = right = 0
                while left < min(p, q, span - 1) and w[p - left - 1] == v[q - left - 1]:
                    left += 1
                while right < span - 1 and max(p + run + right - len(w), q + run + right - len(v)) < 0:
                    if w[p + run + right] != v[q + run + right]:
                        break
                    right += 1
                covered[p - left : p + run + right] = [True] * (run + left + right)
        out.append(covered)
    return out
