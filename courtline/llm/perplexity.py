"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Grams of ``ORDER`` characters are counted over all trusted documents outside a held-out fold; a gram is one long, twelve
bits a character, so its history and its shorter grams are bit operations. Continuation counts, discounts, history
weights and interpolated probabilities are aggregates and equi-joins over the gram tables. The model is then dealt in
shards by the character before the predicted one: everything a position needs is in one shard, and each shard, bounded
in rows, is joined to all documents in turn. A document's perplexity is shrunk towards its language's trusted mean while
it is short, and it is kept up to a quantile of the held-out trusted documents of its language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches, crc_residue, written
from courtline.llm.words import utf8

ORDER = 5
BITS = 12
# Quantile of the trusted perplexities of a language up to which documents are kept.
QUANTILE = 0.995
# Characters of the language's mean that a document's own are weighed against.
PRIOR_CHARS = 100
# Rows of the model that are sent to tasks at a time.
SHARD_ROWS = 4_000_000
_PIECE = 1 << 19
_START, _OTHER = 1, 2


def _alphabet() -> np.ndarray:
    """Code point to symbol: digits are one symbol, white space is one, rare scripts share symbols."""
    table = np.arange(0x110000, dtype=np.int64)
    high = table >= 1 << (BITS - 1)
    table[high] = (1 << (BITS - 1)) + table[high] % (1 << (BITS - 1))
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 10, 11, 12, 13]] = 32
    table[[0, _START]] = _OTHER
    return table


_SYMBOLS = _alphabet()


def symbols(text: str | None) -> np.ndarray:
    """The characters of a text as symbols, runs of white space as one."""
    points = np.frombuffer(utf8(text).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    found = _SYMBOLS[points]
    return found[np.r_[True, (found[1:] != 32) | (found[:-1] != 32)][: len(found)]]


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grams that predict every character of the texts, and the number of them per text."""
    start = np.full(ORDER - 1, _START, np.int64)
    line = np.concatenate([x for t in texts for x in (start, t)] or [start])
    total = line.copy()
    for k in range(1, ORDER):
        total[k:] |= line[:-k] << (BITS * k)
    counts = np.array([len(t) for t in texts])
    real = np.ones(len(line), bool)
    firsts = np.cumsum(counts + ORDER - 1) - (counts + ORDER - 1)
    for k in range(ORDER - 1):
        real[firsts + k] = False
    return (total & ((1 << (BITS * ORDER)) - 1))[real], counts


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of texts of about ``_PIECE`` characters, each with the number of its first text."""
    held: list[np.ndarray] = []
    size = first = 0
    for n, text in enumerate(texts):
        held.append(symbols(text))
        size += len(held[-1])
        if size >= _PIECE:
            yield first, held
            held, size, first = [], 0, n + 1
    if held:
        yield first, held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _pieces(batch.column(0).to_pylist()):
            found, n = np.unique(grams(texts)[0], return_counts=True)
            yield pa.record_batch({"gram": found, "c": n.astype(np.int64)})


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    row = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def train(texts: DataFrame) -> DataFrame:
    """(kind, gram, value): logarithms of probabilities (kind = order) and of history weights (kind = -order)."""
    counts = written(texts.select("text").mapInArrow(_counted, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "grams")
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        tables.append(written(tables[-1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    model, lower = None, None
    for order, table in enumerate(reversed(tables), 1):
        d1, d2, d3 = _discounts(table)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        history = F.shiftright("gram", BITS).alias("history")
        sums = table.groupBy(history).agg(F.sum("c").alias("total"), F.sum(discount).alias("spare"))
        sums = sums.select("history", "total", (F.col("spare") / F.col("total")).alias("weight"))
        share = table.select("*", history).join(sums, "history").select(
            "gram", "weight", ((F.col("c") - discount) / F.col("total")).alias("share"),
            F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1)).alias("shorter"),
        )
        if lower is None:
            found = share.select("gram", (F.col("share") + F.col("weight") / (1 << BITS)).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            found = share.join(below, "shorter").select("gram", (F.col("share") + F.col("weight") * F.col("q")).alias("p"))
        lower = written(found, "probabilities")
        part = lower.select(F.lit(order).alias("kind"), "gram", F.log("p").alias("value")).unionByName(
            sums.select(F.lit(-order).alias("kind"), F.col("history").alias("gram"), F.log("weight").alias("value"))
        )
        model = part if model is None else model.unionByName(part)
    return written(model, "model")


@dataclass
class Shard:
    """Sorted grams and their values, per kind."""

    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    number: int
    shards: int

    def look(self, kind: int, grams_: np.ndarray) -> np.ndarray:
        """Values of grams; NaN where there is none."""
        keys = self.keys.get(kind)
        if keys is None or not len(keys):
            return np.full(len(grams_), np.nan)
        at = np.minimum(np.searchsorted(keys, grams_), len(keys) - 1)
        return np.where(keys[at] == grams_, self.values[kind][at], np.nan)

    def log_probability(self, grams_: np.ndarray) -> np.ndarray:
        """Of each gram's last character after the others; 0 for grams of other shards."""
        own = _shard_of(grams_ >> BITS, self.shards) == self.number
        rest, spent, out = grams_[own], np.zeros(int(own.sum())), np.zeros(len(grams_))
        result = np.full(len(rest), np.nan)
        for order in range(ORDER, 0, -1):
            part = rest & ((1 << (BITS * order)) - 1)
            open_ = np.isnan(result)
            found = self.look(order, part[open_]) + spent[open_]
            result[np.flatnonzero(open_)] = found
            weight = self.look(-order, part >> BITS)
            spent += np.where(np.isnan(weight), 0.0, weight)
        out[own] = np.where(np.isnan(result), spent - BITS * math.log(2), result)
        return out


def _shard_of(history, shards: int):
    """By the last character of a history; works on columns and arrays."""
    if isinstance(history, Column):
        return F.pmod(history.bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(shards))
    return (history & ((1 << BITS) - 1)) % shards


def _shards(model: DataFrame, shard_rows: int) -> Iterator[Shard]:
    shards = max(1, math.ceil(model.count() / shard_rows))
    history = F.when(F.col("kind") > 0, F.shiftright("gram", BITS)).otherwise(F.col("gram"))
    for number in range(shards):
        own = model.where((F.abs("kind") == 1) | (_shard_of(history, shards) == number))
        table = own.toArrow()
        kind, gram = table.column("kind").to_numpy(), table.column("gram").to_numpy()
        value = table.column("value").to_numpy().astype(np.float32)
        keys, values = {}, {}
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(gram[at])]
            keys[k], values[k] = gram[at], value[at]
        yield Shard(keys, values, number, shards)


def _scorer(sent: Broadcast):
    @F.pandas_udf("total double, n long")
    def of(texts: pd.Series) -> pd.DataFrame:
        totals, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first, part in _pieces(texts.tolist()):
            found, counts = grams(part)
            kinds, at = np.unique(found, return_inverse=True)
            each = np.r_[0.0, np.cumsum(sent.value.log_probability(kinds)[at])]
            ends = np.cumsum(counts)
            totals[first : first + len(part)] = each[ends] - each[ends - counts]
            sizes[first : first + len(part)] = counts
        return pd.DataFrame({"total": totals, "n": sizes})

    return of


def log_likelihood(docs: DataFrame, text: str, model: DataFrame, out: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with a column (total, n): the logarithm of its text's probability, and the characters predicted."""
    session = docs.sparkSession.sparkContext
    sums = [_scorer(session.broadcast(shard))(F.col(text)) for shard in _shards(model, shard_rows)]
    names = [f"{out}_{k}" for k in range(len(sums))]
    scored = docs.withColumns(dict(zip(names, sums, strict=True)))
    total = sum((F.col(f"{n}.total") for n in names[1:]), F.col(f"{names[0]}.total"))
    return scored.withColumn(out, F.struct(total.alias("total"), F.col(f"{names[0]}.n").alias("n"))).drop(*names)


def judge(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept), one row per row of ``docs`` (doc_id, text, lang).

    Trusted are documents labelled of quality 1 whose id is not in the held-out fold (crc32 of the id modulo 5 is 0);
    those of the fold set the thresholds. Null and empty texts have a null perplexity and are not kept. A null or rare
    language without trusted documents of the fold takes the threshold of all languages; without any trusted text
    everything with a text is kept. Null ids are judged like others; rows repeating an id give a row each.
    """
    bound_batches(docs)
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    fold = crc_residue("doc_id", 5) == 0
    # The list of trusted ids grows with the corpus, so it is merged at every size and never broadcast.
    texts = docs.select("doc_id", "text").join(good.where(~fold).select("doc_id").hint("merge"), "doc_id", "left_semi")
    told = log_likelihood(docs.select("doc_id", "lang", "text"), "text", train(texts), "told", shard_rows)
    told = written(told.select("doc_id", "lang", "told.total", "told.n"), "likelihoods")
    trusted = told.join(good.select("doc_id"), "doc_id", "left_semi")
    sums = (F.sum("total").alias("t"), F.sum("n").alias("m"))
    row = trusted.agg(*sums).first()
    overall = row["t"] / row["m"] if row["m"] else 0.0
    means = trusted.groupBy("lang").agg(*sums).select(F.col("lang").alias("own"), F.try_divide("t", "m").alias("mean"))
    mean = F.coalesce("mean", F.lit(overall))
    shrunk = (F.col("total") + PRIOR_CHARS * mean) / (F.col("n") + PRIOR_CHARS)
    scored = told.join(means, F.col("lang").eqNullSafe(F.col("own")), "left").select(
        "doc_id", "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.exp(-shrunk)).alias("perplexity")
    )
    held = scored.where(F.col("perplexity").isNotNull() & fold).join(good.select("doc_id"), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    every = held.agg(cut.alias("cut")).first()["cut"]
    cuts = held.groupBy("lang").agg(cut.alias("cut")).select(F.col("lang").alias("own"), "cut")
    threshold = F.coalesce("cut", F.lit(every).cast("double"), F.lit(math.inf))
    return scored.join(cuts, F.col("lang").eqNullSafe(F.col("own")), "left").select(
        "doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"),
    )
