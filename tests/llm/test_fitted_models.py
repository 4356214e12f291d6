"""Language, toxicity and quality models: held-out accuracy, exact probabilities, awkward rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import language, perplexity, toxicity


def residue(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    network = language.fit(docs)
    assert network.languages == sorted(r.lang for r in docs.select("lang").distinct().collect())
    got = language.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (residue(r.doc_id, 4) == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_never_reads_held_out_rows(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").limit(200)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn(
        "text", F.when(held, "zzz zzz").otherwise(F.col("text")))
    a, b = language.fit(docs), language.fit(other)
    assert a.languages == b.languages and np.array_equal(a.tables, b.tables)


def test_language_awkward_rows(awkward, make):
    network = language.fit(make([(i, "der die das und ist nicht " * 9, "de") for i in range(12)] + [(i + 50, "the of and to in is " * 9, "en") for i in range(12)]))
    got = language.predict(awkward, network).collect()
    assert len(got) == awkward.count()
    told = {r.doc_id: r for r in got}
    assert told[2].lang_pred == told[3].lang_pred == told[6].lang_pred == "und" and told[2].score == 0
    assert told[4].lang_pred in ("de", "en") and told[4].score == told[5].score
    kept = language.keep_identified(awkward, network, least=0.0)
    assert kept.columns == awkward.columns and kept.count() == 7
    nothing = language.fit(make([]))
    assert nothing is None and {r.lang_pred for r in language.predict(awkward, nothing).collect()} == {"und"}
    assert language.predict(make([]), network).collect() == []


def test_convolution_by_hand():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"], rng.normal(size=(4, 256, 3)).astype("f4"), rng.normal(size=3).astype("f4"),
                           rng.normal(size=(3, 2)).astype("f4"), np.zeros(2, "f4"))
    text = b"some text of no length"
    window = language.windows_of(text)
    line = list(window[0]) + [0, 0, 0]
    best = [max(sum(net.tables[k][line[t + k]][f] for k in range(4)) for t in range(language.WINDOW)) for f in range(3)]
    assert np.allclose(net.pooled(window)[0], np.maximum(np.array(best) + net.bias, 0), atol=1e-4)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_documents(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    held = [r for r in got if residue(r.doc_id, 5) == 0]
    assert all(r.held_out for r in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    hit = sum(r.predicted for r in held if r.toxic)
    assert hit >= 0.8 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.02 * len(held)


def test_folding():
    assert toxicity.folded_words("You 1d10t!") == ["you", "idiot"]
    assert toxicity.folded_words("ｓｔｕｐｉｄ m0r0n, іdіоt") == ["stupid", "moron", "idiot"]
    assert toxicity.folded_words("l\u200bo\u200bser Éé 1984 @ $cum") == ["loser", "ee", "scum"]
    assert toxicity.folded_words(None) == toxicity.folded_words("") == toxicity.folded_words("12 ...") == []


def test_exception_phrases_and_length():
    lexicon = toxicity.Lexicon({"clown ": 2.0, "idio": 3.0}, centre=1.0)
    assert lexicon.strength("a clown fish swam") == 0
    assert lexicon.strength("a clown fish and a clown swam") > 0
    assert lexicon.strength("clowning about") == 0 and lexicon.strength("idiotic") > 0
    assert lexicon.strength("an idiot") > lexicon.strength("an idiot " + "word " * 50)
    assert lexicon.score("") == pytest.approx(0.01) and lexicon.score(None) == lexicon.score("fine words")


def test_copies_do_not_make_words_toxic(make, spark):
    rows = [(i, f"rare{i} words stand here") for i in range(100)] + [(100 + i, "copied text with zyx in it") for i in range(30)]
    rows += [(200 + i, f"word{i} grobian other{i} end") for i in range(30)]
    marks = [(i, 1, 0) for i in range(100)] + [(100 + i, 1, 1) for i in range(30)] + [(200 + i, 1, 1) for i in range(30)]
    lexicon = toxicity.fit(make(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert "grobian " in lexicon.weights and "zyx " not in lexicon.weights


def test_toxicity_awkward_rows(awkward, make, labels):
    got = toxicity.score_documents(awkward, labels.limit(0)).collect()
    assert len(got) == awkward.count() and all(r.predicted == 0 for r in got)
    assert toxicity.score_documents(make([]), labels).collect() == []
    odd = labels.sparkSession.createDataFrame([(1, None, None), (1, 1, 1), (None, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score_documents(awkward, odd).collect()) == awkward.count()


def kneser_ney(texts):
    """Plain dictionaries of the same model: probability of a gram's last character after the others."""
    order, bits = perplexity.ORDER, perplexity.BITS
    seen = collections.Counter()
    for text in texts:
        line = [perplexity._START] * (order - 1) + perplexity.symbols(text).tolist()
        for i in range(order - 1, len(line)):
            seen[tuple(line[i - order + 1 : i + 1])] += 1
    tables = {order: seen}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    discounts = {}
    for n, table in tables.items():
        k = collections.Counter(table.values())
        y = k[1] / (k[1] + 2 * k[2])
        raw = 1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3] if k[3] else 1.5
        discounts[n] = [min(max(d, 0.05), m - 0.05) for m, d in enumerate(raw, 1)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (1 << bits)
        table, rest = tables[n], p(gram[1:])
        peers = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not peers:
            return rest
        d = lambda c: discounts[n][min(c, 3) - 1]
        own = table.get(gram, 0)
        return ((own - d(own)) if own else 0) / sum(peers) + sum(map(d, peers)) / sum(peers) * rest

    return p


@pytest.mark.parametrize("shard_rows", [1_000_000, 40])
def test_kneser_ney_matches_dictionaries(spark, make, shard_rows):
    texts = ["abracadabra abra", "a banana bandana", "cabbage and bananas", "x", "dad had a bad cab  12"]
    p = kneser_ney(texts)
    model = perplexity.train(make([(i, t) for i, t in enumerate(texts)], extra=False).select("text"))
    asked = [*texts, "zebra ban", "", None, "Ünïcode \U0001f600"]
    docs = make(list(enumerate(asked)), extra=False)
    for r in perplexity.log_likelihood(docs, "text", model, "told", shard_rows).collect():
        line = [perplexity._START] * 4 + perplexity.symbols(r.text).tolist()
        expected = sum(math.log(p(tuple(line[i - 4 : i + 1]))) for i in range(4, len(line)))
        assert r.told.n == len(line) - 4 and r.told.total == pytest.approx(expected, rel=1e-4, abs=1e-6)


def test_quality_separates_junk(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{n}.parquet") for n in ("documents", "labels"))
    got = perplexity.judge(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_quality_awkward_rows(awkward, make, labels):
    got = perplexity.judge(awkward, labels.limit(0)).collect()
    assert len(got) == awkward.count()
    told = {r.doc_id: r for r in got}
    assert told[2].perplexity is None and not told[2].kept and not told[3].kept and told[4].kept
    assert perplexity.judge(make([]), labels).collect() == []
