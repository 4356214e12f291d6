"""Benchmark decontamination: documents that hold a benchmark item, exactly or with some edits.

A CGK random walk reads a string forward, staying at or leaving each character by a random bit that depends on the step
and the character; strings at a small edit distance give walks at a small Hamming distance. Signatures sample a few
steps of a walk, over several walks and samples, and items and documents that agree on one are compared.

Windows have the size of the item they may hold and slide over every word: a walk starts at each word of items and
documents, and each agreement says where the item would begin. Two agreements that place the item within the shift its
edits allow make a window (one is enough for the shortest items), and the exact edit distance of the item to the
best-fitting part of the window decides. Of items with up to 20 % of their characters edited over 0.9 are found (0.89
of those of eight words), without edits all are. Items of fewer than ``SPAN`` words, blanks around them included, are cut
into one piece more than edits are allowed, one of which must stand unchanged; every place of a piece is verified.

Documents are never shuffled: items come to them, in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches
from courtline.llm.words import lowered, mixed

# Edits allowed, as a share of the item's length.
MAX_EDITS = 0.2
# Items of fewer words are not left to walks, items of fewer than FEW get more and shorter walks, and one agreement is
# enough for items of fewer than ONE_VOTE.
SPAN = 8
FEW = 20
ONE_VOTE = 14
_FILTER = 1 << 22
# Item bytes scanned for at a time, and document bytes walked at a time.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20


def normal(text: str | None) -> bytes:
    """UTF-8, A-Z in lower case, words separated by one space."""
    return b" ".join(lowered(text).split())


class Walks:
    """The random bits and sampled steps, the same in every task."""

    def __init__(self, walks: int, steps: int, samples: int, sampled: int) -> None:
        rng = np.random.default_rng(20)
        self.steps = steps
        self.moves = rng.integers(0, 2, (walks, steps, 256)).astype(np.int32)
        self.samples = np.stack([
            np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(walks * samples)
        ]).reshape(walks, samples, sampled)
        self.factors = rng.integers(1, 1 << 62, (walks * samples, sampled), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(walk and sample, anchor): hashes of the characters at the sampled steps of the walks from ``at``."""
        walks, samples, _ = self.samples.shape
        out = np.empty((walks * samples, len(at)), np.uint64)
        for w in range(walks):
            place, seen = at.astype(np.int32), np.empty((self.steps, len(at)), np.uint8)
            for step in range(self.steps):
                np.take(line, place, out=seen[step])
                place += self.moves[w, step].take(seen[step])
            for s in range(samples):
                k = w * samples + s
                total = np.full(len(at), k, np.uint64)
                for step, factor in zip(self.samples[w, s], self.factors[k], strict=True):
                    total += (seen[step] + np.uint64(1)) * factor
                out[k] = mixed(total)
        return out


LONG = Walks(walks=2, steps=32, samples=2, sampled=14)
SHORT = Walks(walks=3, steps=24, samples=2, sampled=12)
_END = bytes(LONG.steps + 1)


def anchors(line: np.ndarray) -> np.ndarray:
    """First bytes of the words of a line of spaced words; words of zero bytes are none."""
    at = np.r_[0, np.flatnonzero(line == 32) + 1]
    at = at[at < len(line)]
    return at[line[at] != 0]


class Table:
    """The signatures of some items' walks, in order, with the item and the place of each."""

    def __init__(self, walks: Walks, texts: list[bytes], numbers: list[int]) -> None:
        self.walks = walks
        keys, items, offsets = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for n in numbers:
            at = whole_walks(texts[n], walks)
            found = walks.signatures(np.frombuffer(texts[n] + _END, np.uint8), at)
            keys.append(found.ravel())
            items.append(np.full(found.size, n, np.int32))
            offsets.append(np.tile(at.astype(np.int32), len(found)))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.item, self.offset = key[order], np.concatenate(items)[order], np.concatenate(offsets)[order]
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[self._slot(key)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(_FILTER - 1)).astype(np.int64)

    def hits(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agreements of the walks from ``at``: where the walk starts, the item, and where the item would begin."""
        found = self.walks.signatures(line, at)
        which, place = np.nonzero(self.maybe[self._slot(found)])
        keys = found[which, place]
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = right - left
        first = np.repeat(left - (np.cumsum(count) - count), count)
        entry, here = first + np.arange(len(first)), np.repeat(at[place], count)
        return here, self.item[entry].astype(np.int64), here - self.offset[entry]


def whole_walks(text: bytes, walks: Walks) -> np.ndarray:
    """The words of an item that walks start at: a walk of about half as many characters as steps ends within the item."""
    at = anchors(np.frombuffer(text, np.uint8))
    return at[at <= len(text) - walks.steps // 2]


@dataclass
class Index:
    """One block of items: their texts, how many agreements each needs, and how each is looked for."""

    ids: list
    texts: list[bytes]
    votes: np.ndarray
    tables: list[Table]
    pieces: list[int]

    def longest(self) -> int:
        return max(map(len, self.texts), default=0)


def build_index(rows: list[tuple]) -> Index:
    ids, texts = [r[0] for r in rows], [normal(r[1]) for r in rows]
    words = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    long, short, pieces = [], [], []
    for n, text in enumerate(texts):
        if not text:
            continue
        if words[n] >= FEW and len(whole_walks(text, LONG)) > 1:
            long.append(n)
        elif words[n] >= SPAN and len(whole_walks(text, SHORT)):
            short.append(n)
        else:
            pieces.append(n)
    tables = [Table(walks, texts, own) for walks, own in ((LONG, long), (SHORT, short)) if own]
    return Index(ids, texts, np.where(words < ONE_VOTE, 1, 2), tables, pieces)


def best_distance(item: str, window: str) -> int:
    """Least edit distance of ``item`` to any part of ``window``, by bit-parallel dynamic programming."""
    m = len(item)
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    best = score
    for c in window:
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & every
        mh = plus & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & every, mh << 1 & every
        plus, minus = mh | ~(xv | ph) & every, ph & xv
        best = min(best, score)
    return best


class Scanner:
    """Finds the items of one block in texts."""

    def __init__(self, index: Index, max_edits: float) -> None:
        self.index = index
        self.items = [t.decode("utf-8", "replace") for t in index.texts]
        self.allowed = np.array([int(max_edits * len(t)) for t in self.items], np.int64)
        self.pieces = None
        if index.pieces:
            places: dict[str, list[tuple[int, int]]] = {}
            for n in index.pieces:
                whole, k = f" {self.items[n]} ", int(self.allowed[n])
                cuts = [len(whole) * c // (k + 1) for c in range(k + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    places.setdefault(whole[a:b], []).append((n, b))
            self.pieces = ahocorasick.Automaton()
            for piece, where in places.items():
                self.pieces.add_word(piece, where)
            self.pieces.make_automaton()

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance) of everything found, the least distance of each pair."""
        best: dict[tuple[int, int], int] = {}
        pieces: list[tuple[int, bytes]] = []
        held = 0
        overlap = 2 * self.index.longest() + 4096
        for n, text in enumerate(texts):
            whole = normal(text)
            if self.pieces is not None and whole:
                self._scan_short(n, f" {whole.decode('utf-8', 'replace')} ", best)
            for at in range(0, max(1, len(whole) - overlap), PIECE):
                pieces.append((n, whole[at : at + PIECE + overlap]))
                held += len(pieces[-1][1])
            if held >= PIECE:
                self._walk(pieces, best)
                pieces, held = [], 0
        if pieces:
            self._walk(pieces, best)
        for (n, i), distance in best.items():
            yield n, i, distance

    def _scan_short(self, n: int, line: str, best: dict[tuple[int, int], int]) -> None:
        """Every place of a piece of a short item; places whose windows overlap are verified together."""
        windows: dict[int, tuple[int, int]] = {}
        for end, where in self.pieces.iter(line):
            for item, beyond in where:
                if best.get((n, item)) == 0:
                    continue
                k, start = int(self.allowed[item]), end + 1 - beyond
                low, high = max(0, start - k), start + len(self.items[item]) + 2 + k
                open_, close = windows.get(item, (low, high))
                if low > close:
                    self._settle(n, item, f" {self.items[item]} ", line[open_:close], best)
                    open_ = low
                windows[item] = min(open_, low), max(close, high)
        for item, (low, high) in windows.items():
            self._settle(n, item, f" {self.items[item]} ", line[low:high], best)

    def _settle(self, n: int, item: int, wanted: str, window: str, best: dict[tuple[int, int], int]) -> None:
        if best.get((n, item)) == 0:
            return
        distance = 0 if wanted in window else best_distance(wanted, window)
        if distance <= self.allowed[item] and distance < best.get((n, item), distance + 1):
            best[n, item] = distance

    def _walk(self, pieces: list[tuple[int, bytes]], best: dict[tuple[int, int], int]) -> None:
        if not self.index.tables:
            return
        # Between texts stands a word of zero bytes that is longer than a walk.
        joint = b" " + _END + b" "
        line = np.frombuffer(joint.join(p for _, p in pieces) + b" " + _END, np.uint8)
        lengths = np.array([len(p) + len(joint) for _, p in pieces])
        starts = np.cumsum(lengths) - lengths
        at = anchors(line)
        parts = [
            table.hits(line, at[low : low + (1 << 15)]) for table in self.index.tables for low in range(0, len(at), 1 << 15)
        ]
        if not sum(len(part[0]) for part in parts):
            return
        here, item, start = (np.concatenate(column) for column in zip(*parts, strict=True))
        group = (np.searchsorted(starts, here, "right") - 1) * len(self.items) + item
        order = np.lexsort((here, start, group))
        here, item, start, group = here[order], item[order], start[order], group[order]
        new = np.r_[True, (np.diff(group) != 0) | (np.diff(start) != 0) | (np.diff(here) != 0)]
        here, item, start, group = here[new], item[new], start[new], group[new]
        # Whether an agreement and the next one place the same item within the shift its edits allow.
        near = np.r_[(np.diff(group) == 0) & (np.diff(start) <= 2 * self.allowed[item[1:]]), False]
        voted = near | np.r_[False, near[:-1]] | (self.index.votes[item] == 1)
        runs = np.flatnonzero(voted & ~np.r_[False, near[:-1]])
        ends = np.flatnonzero(voted & ~near)
        for a, b in zip(runs.tolist(), ends.tolist(), strict=True):
            piece = int(group[a]) // len(self.items)
            n, text = pieces[piece]
            self._verify(n, int(item[a]), text, int(start[a] - starts[piece]), int(start[b] - starts[piece]), best)

    def _verify(self, n: int, item: int, text: bytes, first: int, last: int, best: dict[tuple[int, int], int]) -> None:
        """The part of ``text`` where the item would begin from byte ``first`` to byte ``last``, with room for edits."""
        own, wanted = self.index.texts[item], self.items[item]
        room = len(own) - len(wanted) + 4 * int(self.allowed[item])
        window = text[max(0, first - room) : max(0, last + len(own) + room)]
        self._settle(n, item, wanted, window.decode("utf-8", "ignore"), best)


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, in blocks of about ``BLOCK_BYTES``, so that what is sent to tasks is bounded."""
    items = benchmark.select("item_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield build_index(sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, distance, similarity): items found in documents, at an edit distance of at most ``max_edits``
    of the item's characters, after lower-casing A-Z and spacing words by one blank.

    One row per row of ``docs`` and item; null and empty texts and items match nothing, equal items are found each,
    a null id is returned as null. Without items or documents there are no rows. Other columns are ignored.
    """
    bound_batches(docs)
    schema = "doc_id long, item_id long, distance long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in _blocks(benchmark.withColumn("item_id", F.col("item_id").cast("long"))):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(sent.value, max_edits)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [
                    (ids[n], scanner.index.ids[i], d, 1 - d / len(scanner.items[i]))
                    for n, i, d in scanner.scan(batch.column(1).to_pylist())
                ]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.record_batch(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "distance", "similarity"],
                )

        out = out.unionByName(texts.mapInArrow(task, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; null and empty texts are clean."""
    bound_batches(docs)
    for index in _blocks(benchmark):
        docs = docs.where(~_holds(docs.sparkSession.sparkContext.broadcast(index), max_edits)("text"))
    return docs


def _holds(sent: Broadcast, max_edits: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(sent.value, max_edits)
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            for n, _, _ in scanner.scan(texts.tolist()):
                hit[n] = True
            yield pd.Series(hit)

    return holds
