"""Repeated passages, by a sparse suffix array.

A text's words are hashed; of every ``SPAN`` consecutive runs of ``RUN`` words the one with the smallest hash is a
minimiser, and the suffix that starts there is retained. Which suffixes a stretch of words retains depends on those words
only, so two texts that share ``SPAN + RUN - 1`` words retain a suffix at the same words, and neighbouring retained
suffixes are at most ``SPAN`` words apart.

* Retained suffixes whose first ``RUN`` words stand in one document only are dropped, by a combining count.
* The others are brought together by these words, with the ``SPAN - 1`` words before and after them: what lies further
  out is reached from the next retained suffix. They are sorted once by the words that follow and once, read backwards,
  by the words before. Neighbours in each order are compared word by word, and a match is extended to both sides as far
  as some other document goes along.
* Suffixes whose beginning very many share are not brought together: equal surroundings are first merged, and how far
  they extend is counted by combining aggregates, which gives the same matches.
* Matches of a document that follow each other within ``GAP`` words are joined, so changed, added or missing words inside
  a passage do not break it; what reaches ``MIN_WORDS`` is a repeated passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches, own_columns, unused, written
from courtline.llm.words import lowered, prefix_sums, utf8, window_hashes, word_hashes

MIN_WORDS = 50
RUN, SPAN, GAP = 8, 12, 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Suffixes that share a beginning and are brought together in one task, at most.
GROUP_LIMIT = 20_000


def retained(hashes: np.ndarray, run: int = RUN, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(place, beginning) of the suffixes that a text with these word hashes retains, in order."""
    if len(hashes) < run + span - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    runs = window_hashes(prefix_sums(hashes), run)
    place = np.unique(_least(runs, span))
    return place, _signed(runs[place])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of every ``span`` consecutive values (the first of equals)."""
    out = []
    step = 1 << 14
    for at in range(0, len(values) - span + 1, step):
        part = np.lib.stride_tricks.sliding_window_view(values[at : at + step + span - 1], span)
        out.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    return np.concatenate(out)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _hashes(text: str | None, min_words: int) -> np.ndarray:
    words = lowered(text).split()
    return word_hashes(words) if len(words) >= min_words else np.empty(0, np.uint64)


def _beginnings(min_words: int, run: int, span: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, found = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    begin = np.unique(retained(_hashes(text, min_words), run, span)[1])
                    if len(begin):
                        found.append(begin)
                        ids.append(np.full(len(begin), doc, np.int64))
                if found:
                    yield pa.record_batch({"doc_id": np.concatenate(ids), "begin": np.concatenate(found)})

    return task


_WORDS = pa.list_(pa.int32())
_SUFFIX = "doc_id long, text_hash long, begin long, start int, before array<int>, after array<int>"
_MATCH = "doc_id long, text_hash long, first int, beyond int"


def _around(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of the words at the given places; 0 where there is no word."""
    inside = (at >= 0) & (at < len(hashes))
    found = np.maximum((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1).view(np.int32)
    return np.where(inside, found[np.clip(at, 0, len(hashes) - 1)], 0)


def _suffixes(min_words: int, run: int, span: int):
    side = np.arange(span - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per retained suffix with a shared beginning: the words before it, nearest first, and those after."""
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                doc, code, text, shared = (batch.column(c)[k].as_py() for c in range(4))
                hashes = _hashes(text, min_words)
                place, begin = retained(hashes, run, span)
                own = np.isin(begin, np.array(shared, np.int64))
                place, begin = place[own], begin[own]
                if len(place):
                    before = _around(hashes, place[:, None] - 1 - side)
                    after = _around(hashes, place[:, None] + run + side)
                    ids = np.full((2, len(place)), [[doc], [code]], np.int64)
                    out.append((*ids, begin, place.astype(np.int32), before, after))
                    size += len(place)
                if size > 20_000:
                    yield _suffix_rows(out, span)
                    out, size = [], 0
            if out:
                yield _suffix_rows(out, span)

    return task


def _suffix_rows(parts: list[tuple], span: int) -> pa.RecordBatch:
    doc, code, begin, start, before, after = (np.concatenate(c) for c in zip(*parts, strict=True))
    ends = pa.array(np.arange(len(doc) + 1, dtype=np.int32) * (span - 1))
    lists = [pa.ListArray.from_arrays(ends, pa.array(words.ravel())) for words in (before, after)]
    names = ["doc_id", "text_hash", "begin", "start", "before", "after"]
    return pa.record_batch([pa.array(doc), pa.array(code), pa.array(begin), pa.array(start), *lists], names=names)


def _neighbours(run: int, spare_first: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by beginning; the last beginning of a batch waits for the next batch."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = batch.column("begin").to_numpy()
            cut = int(np.searchsorted(begin, begin[-1], side="left"))
            if cut or (waiting and waiting[-1].column("begin")[0].as_py() != begin[0]):
                yield _matches([*waiting, batch.slice(0, cut)], run, spare_first)
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield _matches(waiting, run, spare_first)

    return task


def _extent(begin: np.ndarray, doc: np.ndarray, words: np.ndarray, spare_first: bool) -> np.ndarray:
    """How many of its ``words`` each suffix shares with a suffix of another document, -1 if not even its beginning.

    The suffixes are sorted by beginning and words; neighbours that share at least ``d`` words form the groups of depth
    ``d``. With ``spare_first`` the other document must have a smaller id.
    """
    order = np.lexsort((*words.T[::-1], begin))
    b, d, w = begin[order], doc[order], words[order]
    alike = np.logical_and.accumulate(np.concatenate([(b[1:] == b[:-1])[:, None], w[1:] == w[:-1]], axis=1), axis=1)
    deep = np.full(len(b), -1)
    for depth in range(alike.shape[1]):
        heads = np.flatnonzero(np.r_[True, ~alike[:, depth]])
        sizes = np.diff(np.r_[heads, len(b)])
        least = np.repeat(np.minimum.reduceat(d, heads), sizes)
        shared = least < (d if spare_first else np.repeat(np.maximum.reduceat(d, heads), sizes))
        if not shared.any():
            break
        deep[shared] = depth
    out = np.empty(len(b), np.int64)
    out[order] = deep
    return out


def _matches(parts: list[pa.RecordBatch], run: int, spare_first: bool) -> pa.RecordBatch:
    """The matches of suffixes that come with all their neighbours."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    doc, code, begin, start = (whole.column(k).to_numpy() for k in ("doc_id", "text_hash", "begin", "start"))
    kept = np.empty(0, bool)
    left = right = np.empty(0, np.int64)
    if len(doc):
        before, after = (
            whole.column(k).combine_chunks().flatten().to_numpy().reshape(len(doc), -1) for k in ("before", "after")
        )
        left, right = _extent(begin, doc, before, spare_first), _extent(begin, doc, after, spare_first)
        kept = left >= 0
    # Beyond the ends of a text there are no words to extend to.
    missing = (lambda w: (w != 0).sum(axis=1)[kept]) if len(doc) else (lambda w: left)
    first = start[kept] - (np.minimum(left[kept], missing(before)) if len(doc) else 0)
    beyond = start[kept] + run + (np.minimum(right[kept], missing(after)) if len(doc) else 0)
    return pa.record_batch({
        "doc_id": doc[kept], "text_hash": code[kept], "first": first.astype(np.int32), "beyond": beyond.astype(np.int32),
    })


def _counted(suffixes: DataFrame, run: int, spare_first: bool) -> DataFrame:
    """The same matches for beginnings that very many suffixes share, by combining aggregates."""
    rows = suffixes.withColumn("around", F.xxhash64("begin", "before", "after"))
    merged = written(rows.groupBy("around").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.first("begin").alias("begin"),
        F.first("before").alias("before"), F.first("after").alias("after"),
    ), "surroundings")

    def depths(side: str) -> DataFrame:
        deeper = F.transform(
            F.sequence(F.lit(0), F.size(side)), lambda d: F.xxhash64("begin", F.lit(side), F.slice(side, F.lit(1), d))
        )
        return merged.select("around", "a", "z", F.lit(side).alias("side"), F.posexplode(deeper).alias("depth", "key"))

    every = depths("before").unionByName(depths("after"))
    shared = every.groupBy("key").agg(F.min("a").alias("least"), F.max("z").alias("most")).where("least < most")
    reach = every.select("around", "side", "depth", "key").join(shared, "key").groupBy("around").agg(
        F.collect_list(F.struct("side", "depth", "least")).alias("reach")
    )

    def extent(side: str) -> Column:
        own = F.filter("reach", lambda r: (r.side == side) & (
            (r.least < F.col("doc_id")) if spare_first else F.lit(True)
        ))
        words = F.size(F.filter(side, lambda w: w != 0))
        return F.when(F.size(own) > 0, F.least(F.array_max(F.transform(own, lambda r: r.depth)), words))

    found = rows.join(reach, "around").select(
        "doc_id", "text_hash", "start", extent("before").alias("left"), extent("after").alias("right")
    ).where("left is not null")
    return found.select(
        "doc_id", "text_hash", (F.col("start") - F.col("left")).cast("int").alias("first"),
        (F.col("start") + run + F.col("right")).cast("int").alias("beyond"),
    )


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN, span: int = SPAN, gap: int = GAP,
    group_limit: int = GROUP_LIMIT, spare_first: bool = False,
) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word): every passage that repeats, as a span of words of one text.

    Words (A-Z in lower case, separated by white space) count from 0, ``end_word`` is beyond the last. A passage is at
    least ``min_words`` words, from the first to the last of matches at most ``gap`` words apart; a match is ``run`` words
    or more, among them a retained suffix, that stand in another document as well. Whatever shares ``run + span - 1``
    words is a match. With ``spare_first`` a match does not count in the document with the smallest id that has it.

    ``text_hash`` is xxhash64 of the text and tells apart the texts of rows that repeat an id; such rows are texts of one
    document, and equal ones have their spans once. Null, empty and shorter texts have no spans, nor do rows without an
    id. An empty table gives no rows. Other columns are ignored.
    """
    bound_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("doc_id is not null and text is not null")
    begins = written(texts.mapInArrow(_beginnings(min_words, run, span), "doc_id long, begin long"), "begins")
    counts = written(
        begins.groupBy("begin").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
        .where("a < z").select("begin", "n"), "shared"
    )
    wanted = begins.join(counts.select("begin"), "begin").groupBy("doc_id").agg(F.collect_set("begin").alias("shared"))
    given = texts.join(wanted, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "shared")
    suffixes = written(given.mapInArrow(_suffixes(min_words, run, span), _SUFFIX), "suffixes")
    crowded = counts.where(F.col("n") > group_limit).select("begin")
    few = suffixes.join(crowded, "begin", "left_anti").select("doc_id", "text_hash", "begin", "start", "before", "after")
    near = few.repartition("begin").sortWithinPartitions("begin").mapInArrow(_neighbours(run, spare_first), _MATCH)
    found = near.unionByName(_counted(suffixes.join(crowded, "begin", "left_semi"), run, spare_first))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "beyond")
    edge = F.max("beyond").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("opens", (F.coalesce(edge + gap, F.lit(-1)) < F.col("first")).cast("int"))
    parts = parts.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("doc_id", "text_hash", "part").agg(F.min("first").alias("start_word"), F.max("beyond").alias("end_word"))
    return spans.where(F.col("end_word") - F.col("start_word") >= min_words).drop("part")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words and the white space after them."""
    raw = utf8(text)
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    last = len(starts) - 1
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : max(at, starts[min(a, last)])])
        at = max(at, starts[min(b, last)])
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """The documents without the passages that a document with a smaller id has, and ``n_chars`` to match.

    Each row is cut by the spans of its own text, also where rows share an id. A text of which no word is left goes.
    Texts without repeats stay as they are, null and empty texts and rows without an id too. Repeated rows are cut alike,
    and stay repeated. An empty table gives no rows.
    """
    spans = repeated_passages(docs, min_words, run, span, gap, spare_first=True).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")
    )
    name, own, code = unused(docs, "_spans"), unused(docs, "_doc"), unused(docs, "_hash")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None or own is None else without_words(t, [(s["start_word"], s["end_word"]) for s in own])
            for t, own in zip(texts, lists, strict=True)
        ])

    spans = written(spans, "spans").toDF(own, code, name)
    same = (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(code))
    joined = docs.join(spans, same, "left")
    hit = F.col(name).isNotNull() & F.col("text").isNotNull()
    left = joined.withColumn("text", F.when(hit, cut("text", name)).otherwise(F.col("text")))
    left = left.where(~hit | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*own_columns(docs))
