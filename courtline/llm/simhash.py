"""SimHash near-duplicates: fingerprints of word shingles, linked by a Gray-ordered hierarchical index.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints, one row each however
many documents share it, are linked at a bounded number of differing bits:

* the bits are cut in ``distance + 2`` blocks; two fingerprints in reach agree on two of them at least, so each
  fingerprint goes to one bucket per pair of blocks, keyed by the bits it shares with everything there. That key is
  the root of the bucket's index. Buckets over a bound are dealt again by pairs of blocks of their other bits.
* inside a bucket fingerprints stand in Gray-code order. Runs of them form leaves, runs of leaves form upper nodes, and
  a node holds the bits all below it share. Two nodes are compared on the bits both share: what differs there differs
  for every pair below, so the pair of nodes is dropped once these differences exceed the distance.
* leaf pairs that are one component already are skipped, and a bucket gives one link per fingerprint it joins to
  another, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.components import components
from courtline.llm.tables import bound_batches, own_columns, unused, written
from courtline.llm.words import lowered

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
# A bucket of more fingerprints than this is dealt again by its other bits.
BUCKET_LIMIT = 1 << 20
_LEAF = 64
_SMALL = 32


def text_fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 where it has no words."""
    words = lowered(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((text_fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def gray_rank(code: Column) -> Column:
    """Place of a bit pattern in the Gray-code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _blocks(bits: list[int], parts: int) -> list[int]:
    """``bits`` cut in ``parts`` runs of nearly equal length, each as a mask."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(bits, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(distance: int, bits: list[int]) -> list[int]:
    return [a | b for a, b in combinations(_blocks(bits, distance + 2), 2)]


class _Sets:
    """Disjoint sets over positions, kept flat by numpy label rewriting of the smaller side."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: dict[int, list[np.ndarray]] = {}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        ours, theirs = self._of(a), self._of(b)
        if len(ours) < len(theirs):
            a, b, ours, theirs = b, a, theirs, ours
        self.label[theirs] = a
        self.members[a] = [np.concatenate([ours, theirs])]
        self.members.pop(b, None)

    def _of(self, a: int) -> np.ndarray:
        return self.members[a][0] if a in self.members else np.array([a])


def _summaries(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of ``size`` codes: the mask of bits all share, and their values there."""
    cuts = np.arange(0, len(codes), size)
    every, some = np.bitwise_and.reduceat(codes, cuts), np.bitwise_or.reduceat(codes, cuts)
    mask = ~(every ^ some)
    return mask, every & mask


def bucket_links(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is in reach among ``codes`` (Gray order): one per code that joins another, at most."""
    n = len(codes)
    sets = _Sets(n)
    mask, value = _summaries(codes, _LEAF)
    top_mask, top_value = _summaries(codes, _LEAF * _LEAF)
    for a in range(len(top_mask)):
        apart = np.bitwise_count((top_value[a:] ^ top_value[a]) & top_mask[a:] & top_mask[a])
        for b in (a + np.flatnonzero(apart <= distance)).tolist():
            _leaf_pairs(codes, sets, mask, value, range(a * _LEAF, min((a + 1) * _LEAF, len(mask))), b, distance)
    roots = sets.label
    moved = np.flatnonzero(roots != np.arange(n))
    return codes[moved], codes[roots[moved]]


def _leaf_pairs(
    codes: np.ndarray, sets: _Sets, mask: np.ndarray, value: np.ndarray, leaves: range, other: int, distance: int
) -> None:
    first, last = other * _LEAF, min((other + 1) * _LEAF, len(mask))
    for x in leaves:
        low = max(first, x)
        apart = np.bitwise_count((value[low:last] ^ value[x]) & mask[low:last] & mask[x])
        own = slice(x * _LEAF, (x + 1) * _LEAF)
        for y in (low + np.flatnonzero(apart <= distance)).tolist():
            theirs = slice(y * _LEAF, (y + 1) * _LEAF)
            mine, its = sets.label[own], sets.label[theirs]
            if (mine == mine[0]).all() and (its == mine[0]).all():
                continue
            near = np.bitwise_count(codes[own][:, None] ^ codes[theirs][None, :]) <= distance
            near &= mine[:, None] != its[None, :]
            for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                sets.join(x * _LEAF + i, y * _LEAF + j)


def _small_links(codes: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, distance: int) -> list[tuple]:
    """Links of many small buckets at once: codes ``lag`` places apart in one bucket, for every lag."""
    out = []
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    at = np.concatenate([np.arange(a, a + s) for a, s in zip(bounds, sizes, strict=True)]) if len(sizes) else bounds
    own = codes[at]
    for lag in range(1, int(sizes.max(initial=0))):
        same = bucket[lag:] == bucket[:-lag]
        near = same & (np.bitwise_count(own[lag:] ^ own[:-lag]) <= distance)
        out.append((own[:-lag][near], own[lag:][near]))
    return out


def _linker(distance: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and Gray rank; the last bucket of a batch waits for the next batch."""
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def links(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(keys)])
            small = (sizes > 1) & (sizes <= _SMALL)
            found = _small_links(codes, starts[small], sizes[small], distance)
            for a, s in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
                found.append(bucket_links(codes[a : a + s], distance))
            a = np.concatenate([x for x, _ in found]) if found else codes[:0]
            b = np.concatenate([y for _, y in found]) if found else codes[:0]
            return pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("mask", "shared", "again")], 1)
            codes = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            cut = changes[-1] + 1 if len(changes) else 0
            if waiting and (cut or (keys[0] != waiting[0][0][0]).any()):
                head = cut if (keys[0] == waiting[0][0][0]).all() else 0
                waiting.append((keys[:head], codes[:head]))
                yield links(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting, keys, codes, cut = [], keys[head:], codes[head:], cut - head
            if cut > 0:
                yield links(keys[:cut], codes[:cut])
                keys, codes = keys[cut:], codes[cut:]
            waiting.append((keys, codes))
        if waiting:
            yield links(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))

    return task


def fingerprint_links(codes: DataFrame, distance: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links that connect all of ``codes.code`` (distinct longs) at up to ``distance`` differing bits."""
    masks = _masks(distance, list(range(64)))
    dealt = codes.select("code", F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("mask"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("shared"))
        for i, m in enumerate(masks)
    ])))
    hot = dealt.groupBy("mask", "shared").count().where(F.col("count") > bucket_limit).select("mask", "shared")
    plain = dealt.join(hot, ["mask", "shared"], "left_anti").withColumn("again", F.lit(0).cast("long"))
    # The other bits of a crowded bucket, in blocks of their own: what is in reach agrees on two of these as well.
    others = [_masks(distance, [b for b in range(64) if not m >> b & 1]) for m in masks]
    again = F.element_at(
        F.array(*[F.array(*[F.col("code").bitwiseAND(F.lit(_signed(m))) for m in inner]) for inner in others]),
        (F.col("mask") + 1).cast("int"),
    )
    crowded = (
        dealt.join(hot, ["mask", "shared"], "left_semi")
        .select("mask", "shared", "code", F.posexplode(again).alias("pos", "again"))
        .withColumn("mask", F.col("mask") + len(masks) * (F.col("pos") + 1))
        .drop("pos")
    )
    rows = plain.unionByName(crowded).select("mask", "shared", "again", "code")
    ordered = rows.repartition("mask", "shared", "again").sortWithinPartitions(
        "mask", "shared", "again", gray_rank(F.col("code"))
    )
    return ordered.mapInArrow(_linker(distance), "a long, b long")


def fingerprint_groups(prints: DataFrame, distance: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(code, component_id, root) from rows of (doc_id, code): the smallest doc_id over all codes reachable by links, and
    the smallest of these codes."""
    codes = written(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    links = fingerprint_links(codes, distance, bucket_limit)
    linked = written(components(links, "a", "b").withColumnRenamed("node", "code"), "linked")
    least = linked.join(codes, "code").groupBy("component").agg(F.min("first").alias("least"))
    groups = linked.join(least, "component").select("code", "least", "component")
    return codes.join(groups, "code", "left").select(
        "code", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "code").alias("root")
    )


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have fingerprint zero and link like any other. A repeated doc_id gives a row each; a null
    doc_id keeps its row and is never a component's id, unless a component has no other. An empty table gives no rows.
    """
    bound_batches(docs)
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("code")), "prints")
    groups = fingerprint_groups(prints, distance, bucket_limit)
    return prints.join(groups, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """The documents whose id is their component's smallest, with their own columns.

    Rows are judged by their id and text: of rows that repeat an id those stay whose own text begins a component, and of
    several in one component the one with the smallest text. Rows without an id cannot be named by a decision and stay,
    one for each text. Null and empty texts are judged like any other. An empty table gives no rows.
    """
    bound_batches(docs)
    text_hash = F.xxhash64(F.col("text").cast("string"))
    prints = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), fingerprint(F.col("text"), shingle).alias("code"),
    ).distinct(), "prints")
    groups = fingerprint_groups(prints.select("doc_id", "code"), distance, bucket_limit)
    first = prints.join(groups, "code").where("doc_id = component_id")
    id_, hash_, root, place = (unused(docs, c) for c in ("_doc", "_hash", "_root", "_place"))
    first = written(first.select("doc_id", "text_hash", "root"), "firsts").toDF(id_, hash_, root)
    named = docs.join(first, (F.col("doc_id").cast("long") == F.col(id_)) & (text_hash == F.col(hash_)))
    nameless = docs.where(F.col("doc_id").isNull()).withColumn(root, text_hash)
    kept = named.drop(id_, hash_).unionByName(nameless)
    order = Window.partitionBy("doc_id", root).orderBy("text")
    return kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*own_columns(docs))
