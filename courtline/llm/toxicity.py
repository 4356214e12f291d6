"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and full-width forms to Latin, and reads
digits and signs inside a word as the letters they stand for. The lexicon is learned from labelled texts: words, and
beginnings of words (which catch families of inflected or compounded terms), weighted by their smoothed log odds. An
exception phrase (a neutral phrase that holds a term) is a pattern of its own; terms inside its occurrence do not count.
The strongest weight at each place is summed, set against the number of words (logarithm of weight per thousand words),
and put on a scale from 0 to 1 by a logistic curve whose centre is the best cut on the same labels.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches, crc_residue, written

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ӏ": "l", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p",
    "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Neutral phrases that hold a word often used as an insult.
EXCEPTIONS = (
    "clown fish", "clownfish", "class clown", "circus clown", "rodeo clown", "pond scum", "soap scum", "sore loser",
    "trash can", "trash bin", "trash bag", "dumb bell", "dumbbell", "idiot proof", "idiot light", "cock pit",
)
# Words known beforehand, with the weight they have where the labels are silent about them.
SEED_WORDS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile",
    "retard", "bastard", "bitch", "asshole", "shit", "fuck", "cunt", "whore", "slut", "dumbass", "vermin", "subhuman",
)
SEED_WEIGHT = 2.0
# Bound of the fit: labelled rows per label value (lowest id hashes).
FIT_ROWS = 6000
# A term must be in this many toxic fit rows or this share of them, and this many times as likely as in the others.
LEAST_ROWS = 4
LEAST_SHARE = 0.005
LEAST_ODDS = 20.0
# Of the places where a term stands, at least this share must differ in the neighbouring words: copies of one text
# do not make its words toxic.
LEAST_CONTEXTS = 0.5
# Lengths of beginnings of words, and terms kept at most (the most widespread).
STEMS = range(4, 9)
MAX_TERMS = 5000
_EDGE = " "


def _character_map() -> dict[int, str]:
    table = {}
    for code in range(0x80, 0x3000):
        flat = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        table[code] = LOOK_ALIKES.get(chr(code).lower(), flat)
    for code in range(0xFF01, 0xFF5F):
        table[code] = chr(code - 0xFEE0).lower()
    return table | {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


_FOLD = str.maketrans(_character_map())
_UNSIGN = str.maketrans(SIGNS)
_LETTERS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})
_ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])


def folded_words(text: str | None) -> list[str]:
    """Words of a folded text. Digits and signs are read as letters only in words that also have a letter."""
    if not text:
        return []
    flat = text.translate(_FOLD) if text.isascii() else text.translate(_ZERO_WIDTH).translate(_FOLD)
    words = []
    for token in flat.split():
        if token.isalpha():
            words.append(token)
            continue
        core = token.strip(".,;:!?()[]{}\"'*%&#-_/<>|")
        if core.isalpha():
            words.append(core)
        else:
            if any(c.isalpha() for c in core):
                core = core.translate(_UNSIGN)
            words += core.translate(_LETTERS).split()
    return words


@dataclass
class Lexicon:
    """Terms with weights (a term that ends in the edge mark is a whole word, else a beginning), and the curve."""

    weights: dict[str, float]
    centre: float = 0.1
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(_EDGE + term, (len(term) + 1, weight))
            for phrase in EXCEPTIONS:
                found.add_word(_EDGE + phrase + _EDGE, (len(phrase) + 2, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def strength(self, text: str | None) -> float:
        """Sum of the weights found, against the length."""
        words = folded_words(text)
        if not words or not self.weights:
            return 0.0
        line = _EDGE + _EDGE.join(words) + _EDGE
        spared: list[tuple[int, int]] = []
        best: dict[int, float] = {}
        for end, (size, weight) in self.automaton().iter(line):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), weight)
        total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in spared))
        return math.log1p(1000 * total / len(words))

    def score(self, text: str | None) -> float:
        """0.01 for a text without any term, 0.5 at the centre."""
        x = math.log(99) * (self.strength(text) / self.centre - 1)
        return 1 / (1 + math.exp(-min(x, 500.0)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the rows to fit on: at most ``FIT_ROWS`` of each label value, none from the held-out fold."""
    marks = (
        labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (crc_residue("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    # Only about twice the rows a label needs, those with the lowest hashes, are left to be ranked.
    part = [min(1.0, 2 * FIT_ROWS / max(n.get(k, 0), 1)) for k in (0, 1)]
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]) * (1 << 30)
    order = Window.partitionBy("toxic").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    chosen = marks.where(low).withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIT_ROWS)
    # Bounded by 2 * FIT_ROWS ids.
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select(
        "text", "toxic"
    )


def _terms_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words and beginnings of words of each text, with the number of texts of either label."""
    for frame in frames:
        for at in range(0, len(frame), 256):
            counts: dict[str, list[int]] = {}
            part = frame.iloc[at : at + 256]
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                words = set(folded_words(text))
                for term in {w + _EDGE for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}:
                    counts.setdefault(term, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame({
                "term": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()],
            })


def _contexts_of(terms: list[str]):
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = set()
            for text in frame["text"]:
                line = _EDGE + _EDGE.join(folded_words(text)) + _EDGE
                for end, (size, weight) in lexicon.automaton().iter(line):
                    start = end - size + 1
                    if weight is not None:
                        term = line[start + 1 : end + 1]
                        after = line.find(_EDGE, start + 1)
                        found.add((term, line[max(0, start - 12) : start] + line[after : after + 12]))
            yield pd.DataFrame(list(found), columns=["term", "context"])

    return task


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn the lexicon and its curve; without toxic labels the seed words and the default curve."""
    seeds = {w + _EDGE: SEED_WEIGHT for w in SEED_WORDS}
    rows = written(labelled(docs, labels), "toxic_fit")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon(seeds)
    counts = rows.mapInPandas(_terms_of, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * toxic))
    wide = (
        counts.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.col("toxic").desc(), "term").limit(MAX_TERMS).collect()
    )
    candidates = {r["term"]: (r["toxic"], math.log(r["odds"])) for r in wide}
    weights = dict(seeds)
    if candidates:
        places = rows.where("toxic = 1").select("text").mapInPandas(_contexts_of(list(candidates)), "term string, context string")
        for r in places.groupBy("term").agg(F.count_distinct("context").alias("n")).collect():
            texts, weight = candidates[r["term"]]
            if r["n"] >= max(least, LEAST_CONTEXTS * texts):
                weights[r["term"]] = weight
    lexicon = Lexicon(weights)

    @F.pandas_udf("double")
    def strength(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.strength(t) for t in texts], dtype="float64")

    # Bounded by 2 * FIT_ROWS numbers.
    found = rows.select(strength("text").alias("x"), "toxic").collect()
    return Lexicon(weights, _best_cut(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found])))


def _best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """Cut between two strengths with the best F1 on the labels; the lower of equals, never zero."""
    values = np.unique(x[x > 0])
    if not len(values):
        return Lexicon.centre
    cuts = np.r_[values[0] / 2, (values[1:] + values[:-1]) / 2]
    order = np.sort(x[y == 1]), np.sort(x[y == 0])
    hit, wrong = (len(s) - np.searchsorted(s, cuts, side="left") for s in order)
    f1 = 2 * hit / (hit + wrong + len(order[0]))
    return float(cuts[int(f1.argmax())])


def score(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts score 0.01, as texts without any term do. A null doc_id counts as not held out and is never
    learned from; a doc_id with several labels is toxic if one of them is. Equal texts get equal scores.
    """
    bound_batches(docs)
    lexicon = fit(docs, labels)
    held_out = F.coalesce(crc_residue("doc_id", 5) == 0, F.lit(False))
    told = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), lexicon).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
