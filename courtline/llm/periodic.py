"""Periodic runs of words: stretches that repeat themselves, such as stuck generators and copied list items leave.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) that holds at least two periods and
``LEAST`` words and that neither neighbour extends. All runs of a text are found, over its words:

* *Longest common extensions* of two places come from a difference cover modulo ``MODULUS``: only the suffixes that start
  at covered places are sorted. For any two places there is a shift of fewer than ``MODULUS`` words that brings both to
  covered places, so few words are compared one by one and the rest is a range minimum over the common prefixes of
  neighbouring sorted suffixes, from a sparse table.
* *Harmonic grid*: a run of period ``p`` covers a multiple of ``p`` and the place ``p`` words on. For every ``p`` the
  multiples of ``p`` are extended both ways, n/1 + n/2 + n/3 + ... places in all. A stretch found for several periods
  has the smallest.

A text is one unit of work of about n log n steps; nothing crosses texts, so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courtline.llm.tables import bound_batches
from courtline.llm.words import utf8

LEAST = 12
# A perfect difference set, every residue but 0 is the difference of one pair.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
# Pairs of places looked at together; bounds the memory of very long texts.
PLACES = 1 << 20

_COVERED = np.isin(np.arange(MODULUS), COVER)
# _SHIFT[r, d]: words from places at residues r and r + d to the next ones that are both covered.
_SHIFT = np.array([
    [next(k for k in range(MODULUS) if _COVERED[(r + k) % MODULUS] and _COVERED[(r + d + k) % MODULUS])
     for d in range(MODULUS)] for r in range(MODULUS)
])


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of every row by its keys, the first key first; equal rows share a rank, ranks count from 1."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank


class Extensions:
    """Longest common extensions to the right within one sequence of word numbers (1 and up)."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.n = len(numbers)
        # 0 stands beyond the end and sorts before every word.
        self.words = np.concatenate([numbers.astype(np.int64), np.zeros(2 * MODULUS + 1, np.int64)])
        self.tables: list[np.ndarray] | None = None

    def _sort(self) -> None:
        """Sort the suffixes at covered places: by their first words, then by doubling."""
        at = np.flatnonzero(_COVERED[np.arange(self.n) % MODULUS])
        self.slot = np.full(self.n, -1, np.int64)
        self.slot[at] = np.arange(len(at))
        windows = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[at]
        pairs = [windows[:, k] << 32 | windows[:, k + 1] for k in range(0, MODULUS - 1, 2)]
        levels, width = [_ranked([*pairs, windows[:, -1]])], MODULUS
        while levels[-1].max(initial=0) < len(at):
            levels.append(_ranked([levels[-1], self._rank(levels[-1], at + width)]))
            width *= 2
        order = np.argsort(levels[-1])
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        shared = self._shared(levels, at[order[:-1]], at[order[1:]])
        self.tables = [shared]
        while len(shared) > 1 << (len(self.tables) - 1):
            half = 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def _rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        inside = at < self.n
        out[inside] = level[self.slot[at[inside]]]
        return out

    def _shared(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at covered places ``a`` and ``b``."""
        total, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
        for k in range(len(levels) - 1, -1, -1):
            one = self._rank(levels[k], a)
            step = np.where((one > 0) & (one == self._rank(levels[k], b)), MODULUS << k, 0)
            total, a, b = total + step, a + step, b + step
        going = np.ones(len(a), bool)
        for k in range(MODULUS):
            going &= self.words[np.minimum(a + k, self.n)] == self.words[np.minimum(b + k, self.n)]
            if not going.any():
                break
            total += going
        return total

    def length(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the places ``i`` and ``j`` (``i`` < ``j`` each) have in common from there on."""
        out = np.zeros(len(i), np.int64)
        going = np.arange(len(i))
        for k in range(MODULUS):
            going = going[self.words[i[going] + k] == self.words[np.minimum(j[going] + k, self.n)]]
            if not len(going):
                return out
            out[going] += 1
        # These agree for longer than any shift to covered places.
        if self.tables is None:
            self._sort()
        i, j = i[going], j[going]
        shift = _SHIFT[i % MODULUS, (j - i) % MODULUS]
        a, b = self.rank[self.slot[i + shift]], self.rank[self.slot[j + shift]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1].astype(np.int64) - 1
        least = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.tables[k]
            least[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        out[going] = shift + least
        return out


def runs(numbers: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` words, by start, then period."""
    n = len(numbers)
    right, left = Extensions(numbers), Extensions(numbers[::-1])
    found = [np.empty((0, 3), np.int64)]
    low = 1
    while low <= n // 2:
        high, places = low, 0
        while high <= n // 2 and (places == 0 or places + (n - 1) // high <= PLACES):
            places += (n - 1) // high
            high += 1 if n > 4096 else n
        high = min(high, n // 2 + 1)
        periods = np.arange(low, high)
        counts = (n - 1) // periods
        p = np.repeat(periods, counts)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
        same = np.flatnonzero(numbers[i] == numbers[i + p])
        low = high
        if not len(same):
            continue
        p, i = p[same], i[same]
        before = np.zeros(len(p), np.int64)
        inner = i > 0
        before[inner] = left.length(n - i[inner] - p[inner], n - i[inner])
        # Only the first multiple inside a run: the others find it again.
        first = before < p
        p, i, before = p[first], i[first], before[first]
        after = right.length(i, i + p)
        length = before + after + p
        ok = length >= np.maximum(least, 2 * p)
        found.append(np.stack([i - before, length, p], axis=1)[ok])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def text_runs(text: str | None, least: int = LEAST) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The runs of a text, its words, and which words stay when every run is cut to its first period."""
    words = utf8(text).split()
    if len(words) < least:
        return np.empty((0, 3), np.int64), words, np.ones(len(words), bool)
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, len(words))
    found = runs(numbers, least)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return found, words, np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): every row's runs, as (start, length, period) by start, then period, and its text with
    each run cut to its first period, the words joined by one space.

    Words are separated by ASCII white space and compared as they are; they count from 0. A word goes if any run holds
    it after that run's first period. One row per row of ``docs``, so repeated ids and texts are each returned; ties need
    no rule, as all runs are returned. Null and empty texts have no runs and collapse to an empty text; a null id stays
    null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    bound_batches(docs)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, left = [np.empty((0, 3), np.int64)], [0], []
            for text in batch.column(1).to_pylist():
                own, words, stay = text_runs(text, least)
                found.append(own)
                sizes.append(len(own))
                left.append(b" ".join(words if stay.all() else [words[k] for k in np.flatnonzero(stay)]))
            columns = np.concatenate(found)
            structs = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), structs)
            collapsed = pa.array([t.decode("utf-8", "surrogatepass") for t in left], pa.string())
            yield pa.record_batch([batch.column(0), lists, collapsed], names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(task, schema)
