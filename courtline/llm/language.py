"""Language identification by a convolutional network over bytes.

Convolutions of several widths slide over a text's UTF-8 bytes; each filter keeps its strongest response in a window of
fixed length, and a softmax layer turns the responses into language probabilities. A text's probabilities are the mean
over all its windows, so whole texts count. The network is trained in numpy on a bounded sample of labelled rows, and
applied in batches of windows inside Spark tasks; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.tables import bound_batches, crc_residue, own_columns, unused
from courtline.llm.words import lowered

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
# Bound of the fit: labelled rows per language (those whose id hashes lowest), and windows taken from each.
FIT_ROWS = 400
FIT_WINDOWS = 4
EPOCHS = 6
# Documents below this score are rejected by ``keep_identified``.
MIN_SCORE = 0.3
# Windows convolved at a time.
BATCH = 32


@dataclass
class Network:
    """One table of byte responses per offset in the widest filter, and the softmax layer above the pooled responses."""

    languages: list[str]
    tables: np.ndarray  # offset, byte, filter
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Strongest response of every filter; byte 0 pads a window and no filter reads beyond the text."""
        reach = len(self.tables)
        padded = np.concatenate([windows, np.zeros((len(windows), reach - 1), np.uint8)], axis=1)
        total = self.tables[0].take(windows, axis=0)
        for k in range(1, reach):
            total += self.tables[k].take(padded[:, k : k + windows.shape[1]], axis=0)
        return np.maximum(total.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        raw = self.pooled(windows) @ self.weights + self.shift
        raw -= raw.max(axis=1, keepdims=True)
        e = np.exp(raw)
        return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """A whole text as rows of ``WINDOW`` bytes, the last one padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def train(texts: list[bytes], languages: list[str], seed: int = 11) -> Network:
    """Fit by Adam on cross-entropy, mini-batches in an order fixed by ``seed``."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    rows, marks = [], []
    for text, language in zip(texts, languages, strict=True):
        own = windows_of(text)
        pick = np.linspace(0, len(own) - 1, min(FIT_WINDOWS, len(own))).astype(int)
        rows.append(own[pick])
        marks += [names.index(language)] * len(pick)
    x, y = np.concatenate(rows), np.array(marks)
    reach, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    # Filters of a smaller width do not read the later offsets.
    reads = np.repeat([[k < w for w in WIDTHS] for k in range(reach)], FILTERS, axis=1).astype(np.float32)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)), "conv": rng.normal(0, 0.3, (reach, EMBEDDING, filters)),
        "bias": np.zeros(filters), "weights": rng.normal(0, 0.3, (filters, len(names))), "shift": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["conv"] *= reads[:, None, :]
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            step += 1
            for k, g in _gradients(p, x[part], y[part], reads).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return Network(names, np.einsum("be,kef->kbf", p["embed"], p["conv"]), p["bias"], p["weights"], p["shift"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, reads: np.ndarray) -> dict[str, np.ndarray]:
    reach, n = len(reads), len(x)
    padded = np.concatenate([x, np.zeros((n, reach - 1), np.uint8)], axis=1)
    table = np.einsum("be,kef->kbf", p["embed"], p["conv"])
    total = sum(table[k][padded[:, k : k + WINDOW]] for k in range(reach))
    best = total.argmax(axis=1)
    top = np.take_along_axis(total, best[:, None, :], 1)[:, 0] + p["bias"]
    pooled = np.maximum(top, 0)
    raw = pooled @ p["weights"] + p["shift"]
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    off = e / e.sum(axis=1, keepdims=True)
    off[np.arange(n), y] -= 1
    off /= n
    back = (off @ p["weights"].T) * (top > 0)
    embed, conv = np.zeros_like(p["embed"]), np.zeros_like(p["conv"])
    filters = np.arange(back.shape[1])
    for k in range(reach):
        seen = padded[np.arange(n)[:, None], best + k]
        conv[k] = np.einsum("nfe,nf->ef", p["embed"][seen], back) * reads[k]
        np.add.at(embed, seen, back[:, :, None] * p["conv"][k].T[filters][None])
    return {"embed": embed, "conv": conv, "bias": back.sum(0), "weights": pooled.T @ off, "shift": off.sum(0)}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """Rows the fit may see: a language, a letter in the text, and an id outside the held-out fold."""
    return docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & has_letter(F.col("text")) & (crc_residue("doc_id", 4) != 2)
    )


def _sampled_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own = [windows_of(lowered(t)) for t in frame["text"]]
        picks = [np.linspace(0, len(w) - 1, min(FIT_WINDOWS, len(w))).astype(int) for w in own]
        yield pd.DataFrame({"lang": frame["lang"], "bytes": [w[k].tobytes() for w, k in zip(own, picks, strict=True)]})


def fit(docs: DataFrame) -> Network | None:
    """Train on at most ``FIT_ROWS`` labelled rows of each language (lowest id hashes); None where there are none."""
    bound_batches(docs)
    rows = labelled(docs)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang", F.row_number().over(order).alias("place")).where(F.col("place") <= FIT_ROWS)
    # Bounded by FIT_ROWS ids per language.
    texts = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = texts.select("lang", "text").mapInPandas(_sampled_windows, "lang string, bytes binary").collect()
    found = sorted((r["lang"], bytes(r["bytes"])) for r in found)
    return train([b for _, b in found], [name for name, _ in found]) if found else None


def identify(text: Column, network: Network | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if network is None:
        return nothing

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for at in range(0, len(texts), 256):
            encoded = [lowered(t) for t in texts.iloc[at : at + 256]]
            own = [windows_of(b) for b in encoded]
            windows = np.concatenate(own)
            used = np.maximum((windows != 0).sum(axis=1), 1)
            found = np.concatenate([network.probabilities(windows[k : k + BATCH]) for k in range(0, len(windows), BATCH)])
            starts = np.cumsum([0] + [len(w) for w in own[:-1]])
            mean = np.add.reduceat(found * used[:, None], starts) / np.add.reduceat(used, starts)[:, None]
            best = mean.argmax(axis=1)
            names += [network.languages[k] for k in best]
            scores += np.clip(mean[np.arange(len(best)), best], 0, 1).tolist()
        return pd.DataFrame({"lang_pred": names, "score": np.array(scores, np.float64)})

    return F.when(has_letter(text), of(text)).otherwise(nothing)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Null texts and texts without a letter are ``und`` with score 0, as is everything where nothing was learned. A null
    doc_id counts as not held out and is never learned from. Equal texts get equal results.
    """
    bound_batches(docs)
    told = docs.select("doc_id", identify(F.col("text"), network).alias("told"))
    held_out = F.coalesce(crc_residue("doc_id", 4) == 2, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "told.lang_pred", "told.score")


def keep_identified(docs: DataFrame, network: Network | None, least: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, with their own columns."""
    bound_batches(docs)
    told = unused(docs, "_told")
    judged = docs.withColumn(told, identify(F.col("text"), network))
    return judged.where((F.col(told)["lang_pred"] != UNKNOWN) & (F.col(told)["score"] >= least)).select(*own_columns(docs))
