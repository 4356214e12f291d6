"""Spelling variants: words one inserted, deleted or replaced code point apart, and the frequent form each belongs to.

Two words are a single edit apart if what they share at the beginning and what they share at the end reaches the longer
one's length less one. *Dense tiles* find such pairs: words stand as rows of padded code-point matrices, flush left and
flush right, and all rows of a tile are compared at once, column by column.

Which words meet in a tile is decided without loss. With ``m`` the longer length, two near words share their first or
their last ``ceil((m - 1) / 2)`` code points, so every word goes to a group by its first and one by its last half, as a
word of length ``m`` and as the shorter one of length ``m + 1``. A group with more than ``TILE`` words is divided the
same way again: near words in it share half of what is still open, after the part known to be equal or before the other.
When one code point is left open a group holds one word per letter, so division ends, whatever words are frequent. A
pair counts in one group only: the one that takes the beginning wherever the pair shares it.

A tile adds up its pairs: each word leaves it with the number of its near words there and the best of them, so pairs are
never written out. Roots are found by pointer jumping; a form is at least twice as frequent as its word, so chains are
no longer than the logarithm of the largest count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
# A form is this many times as frequent as its word, at least.
DOMINANCE = 2
# Words that are compared with each other at once; at least one word for every letter.
TILE = 256
# Compared cells held at a time.
CELLS = 1 << 21
_GROUP = ["m", "head", "tail", "limit"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, damage: Column | None = None) -> DataFrame:
    """(word, n): how often each run of letters stands in the texts, A-Z in lower case.

    ``damage`` may replace the word of an occurrence; it is an expression over ``doc_id`` and ``word``. Null texts have
    no words. Runs that are shorter than the least length never count, so they are left out at once.
    """
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(LETTERS.replace("+", f"{{{MIN_LENGTH},}}")), F.lit(0))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("word"))
    if damage is not None:
        words = words.select(damage.alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dropped_letter(modulus: int = 97) -> Column:
    """The word without one code point wherever crc32 of ``doc_id:word`` is a multiple of ``modulus``, else as it is.

    Rows without an id keep their words.
    """
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return F.when(h % modulus == 0, shorter).otherwise(F.col("word"))


def _divided(members: DataFrame, m: Column, head: Column, tail: Column, limit: Column) -> DataFrame:
    """Members of the two halves of every group: those that share more at the beginning, or more at the end."""
    known, w = F.length(head) + F.length(tail), F.col("word")
    half = F.ceil((m - known - 1) / 2).cast("int")
    more = F.substring(w, F.length(head) + 1, half)
    back = F.substring(w, F.length(w) - F.length(tail) - half + 1, half)
    ways = F.array(
        F.struct(m.alias("m"), F.concat(head, more).alias("head"), tail.alias("tail"), limit.alias("limit")),
        F.struct(m.alias("m"), head.alias("head"), F.concat(back, tail).alias("tail"),
                 (F.length(head) + half).alias("limit")),
    )
    return members.select("word", "n", F.explode(ways).alias("way")).select("word", "n", "way.*")


def _grouped(words: DataFrame, tile: int) -> DataFrame:
    """One row per group of 2 to ``tile`` words, or one word a letter: its key and its members, most frequent first."""
    empty, open_ = F.lit(""), F.lit(1 << 30)
    by_length = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    members = _divided(by_length, F.col("m"), empty, empty, open_)
    out = None
    while True:
        members = written(members, "members")
        sizes = members.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = written(sizes, "sizes")
        ends = (F.col("size") <= tile) | (F.col("m") - F.length("head") - F.length("tail") <= 1)
        fit = members.join(sizes.where(ends).select(*_GROUP), _GROUP)
        member = F.struct((-F.col("n")).alias("order"), F.col("word"))
        part = fit.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(member)).alias("members"))
        out = part if out is None else out.unionByName(part)
        large = sizes.where(~ends).select(*_GROUP)
        if large.isEmpty():
            return out
        members = _divided(members.join(large, _GROUP), *(F.col(c) for c in _GROUP))


def _codes(words: list[str], width: int, flush_left: bool) -> np.ndarray:
    pad = str.ljust if flush_left else str.rjust
    raw = "".join(pad(w, width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(words), width)


def compared(groups: list[list[str]], m: int, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(near, best) of equally many words a group: the number of near words that the group holds for each word, and the
    place of the first of them, -1 without any.

    Words have ``m`` or ``m - 1`` code points; a pair needs one of ``m``, and to share less at its beginning than its
    group's limit. An empty string stands for no word.
    """
    g, s = len(groups), len(groups[0])
    flat = [w for group in groups for w in group]
    left, right = _codes(flat, m, True), _codes(flat, m, False)
    if left.max(initial=0) < 256:
        left, right = left.astype(np.uint8), right.astype(np.uint8)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat)).reshape(g, s)
    left, right = left.reshape(g, s, m), right.reshape(g, s, m)
    count = np.uint8 if m < 120 else np.int64

    def shared(codes: np.ndarray, columns: range) -> np.ndarray:
        equal, total = np.ones((g, s, s), bool), np.zeros((g, s, s), count)
        for k in columns:
            column = codes[:, :, k]
            equal &= column[:, :, None] == column[:, None, :]
            total += equal
            if not equal.any():
                break
        return total

    first, last = shared(left, range(m)), shared(right, range(m - 1, -1, -1))
    near = first + last >= m - 1
    near &= first < np.minimum(limits, m + 1)[:, None, None]
    near &= ~np.eye(s, dtype=bool)
    near &= (lengths[:, :, None] == m) | (lengths[:, None, :] == m)
    near &= (lengths[:, :, None] > 0) & (lengths[:, None, :] > 0)
    found = near.sum(axis=2)
    return found, np.where(found > 0, near.argmax(axis=2), -1)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, limit = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lists = batch.column(2)
        flat, ends = lists.flatten(), np.cumsum([0] + [len(x) for x in lists])
        words, counts = flat.field("word").to_pylist(), (-flat.field("order").to_numpy()).tolist()
        # Groups of one length and about one size are compared together.
        alike: dict[tuple[int, int], list[int]] = {}
        for k in range(len(m)):
            size = int(ends[k + 1] - ends[k])
            alike.setdefault((m[k], 1 << (size - 1).bit_length()), []).append(k)
        out: list[tuple[str, int, int, str]] = []
        for (length, size), rows in alike.items():
            step = max(1, CELLS // (size * size))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                groups = [words[ends[k] : ends[k + 1]] for k in part]
                near, best = compared([g + [""] * (size - len(g)) for g in groups], length, [limit[k] for k in part])
                for x, y in zip(*np.nonzero(near), strict=True):
                    from_ = ends[part[x]]
                    other = from_ + best[x, y]
                    out.append((groups[x][y], int(near[x, y]), counts[other], words[other]))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["word", "near", "n", "other"]
        )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of forms, by pointer jumping."""
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hop = links.join(onward, "root", "left")
        links = written(hop.select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variant_groups(words: DataFrame, dominance: int = DOMINANCE, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words with their counts (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. ``form`` is the
    near word of largest n (ties: smallest in code-point order) if that is at least ``dominance`` times the word's own,
    else null; ``root`` follows forms to the last. Rows that repeat a word are added up; null and empty words and null
    counts are left out. An empty table gives no rows. Other columns are ignored.
    """
    bound_batches(words)
    given = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    given = written(given.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tiles = _grouped(given, tile).select("m", "limit", "members").mapInArrow(
        _tiles, "word string, near long, n long, other string"
    )
    best = tiles.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("order"), F.col("other"))).alias("best")
    )
    form_n = -F.col("best.order")
    dominant = form_n >= dominance * F.col("n")
    found = written(given.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(dominant, F.col("best.other")).alias("form"), F.when(dominant, form_n).alias("form_n"),
    ), "forms")
    rooted = found.join(_roots(found.where("form is not null")), "word", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, damage: Column | None = None) -> DataFrame:
    """:func:`variant_groups` of the words of documents with ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.

    Every row's text counts, repeated rows and ids too; null and empty texts have no words; a null id is an id like any
    other. Languages and sources are not told apart. An empty table gives no rows. Other columns are ignored.
    """
    counts = word_counts(docs, damage)
    return variant_groups(counts.where(F.length("word") >= MIN_LENGTH).where(F.col("n") >= MIN_COUNT))
