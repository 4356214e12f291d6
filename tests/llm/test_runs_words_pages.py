"""Periodic runs, spelling variants and main texts against brute force and pages written by hand."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import extraction, periodic, queries, spelling
from tests_llm_brute import LOWER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def ordered(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("places", [1 << 20, 50])
def test_runs_match_brute_force(monkeypatch, places):
    monkeypatch.setattr(periodic, "PLACES", places)
    rng = random.Random(places)
    for _ in range(400):
        n, letters = rng.randint(0, 200), rng.choice([1, 2, 2, 3, 6, 60])
        words = [rng.randint(1, letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        got = [tuple(r) for r in periodic.runs(np.array(words, np.int64)).tolist()]
        assert got == ordered(brute_runs(words))


def test_extensions_match_plain_comparison():
    rng = random.Random(3)
    for letters in (1, 2, 4):
        words = np.array([rng.randint(1, letters) for _ in range(300)] * 3, np.int64)
        own = periodic.Extensions(words)
        i = np.array([rng.randrange(0, 800) for _ in range(500)])
        j = np.array([rng.randrange(a + 1, 901) for a in i])
        want = [next((k for k in range(901) if b + k >= 900 or words[a + k] != words[b + k])) for a, b in zip(i, j, strict=True)]
        assert own.length(i, j).tolist() == want


def expected_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = ordered(brute_runs(words))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_run_query_matches_brute_force(spark, documents, tmp_path):
    docs = documents.where(F.length("text") < 4000)
    extra = spark.createDataFrame(
        [(30, "x " * 40, None, None, 1), (30, None, None, None, None), (None, "a b " * 9, None, None, 3), (77, "", "", "", 0),
         (78, " \t ", "en", "s", 3), (79, "p q r \U0001f600 " * 50, "en", "s", 3)], docs.schema)
    rows = docs.unionByName(extra).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(1))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected_op11(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 10


def test_runs_awkward_rows(awkward, make):
    got = periodic.periodic_runs(awkward).collect()
    assert len(got) == awkward.count() and all(r.collapsed is not None for r in got)
    long = [r for r in got if r.doc_id in (4, 5)]
    assert [[tuple(x) for x in r.runs] for r in long] == [[(0, 60_000, 997)]] * 2
    assert all(len(r.collapsed.split()) == 997 for r in long)
    assert periodic.periodic_runs(make([])).collect() == []


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near), form, words.get(form))
    roots = {}
    for w in out:
        roots[w] = w
        while out[roots[w]][2] is not None:
            roots[w] = out[roots[w]][2]
    return {w: (*v, roots[w]) for w, v in out.items()}


@pytest.mark.parametrize("tile", [256, 3])
def test_variants_match_brute_force(spark, tile):
    rng = random.Random(tile)
    words = {}
    for _ in range(350):
        letters = rng.choice(["ab", "abc", "abcdefé", "xyzÿ\U0001f600"])
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] = rng.choice([1, 2, 3, 4, 8, 16, 50])
    for w in list(words)[:100]:
        i = rng.randrange(len(w))
        words.setdefault(w[:i] + w[i + 1 :] or "q", rng.randint(1, 100))
    rows = [(w, n, "x") for w, n in words.items() if w != "b"] + [("b", words.get("b", 9) - 1, "x"), ("b", 1, "y")]
    words.setdefault("b", 9)
    rows += [(None, 4, "x"), ("", 7, "x"), ("null count", None, "x")]
    given = spark.createDataFrame(rows, "word string, n long, form string")
    got = {r.word: tuple(r)[1:] for r in spelling.variant_groups(given, tile=tile).collect()}
    assert got == brute_variants(words)


def test_hot_beginning_is_divided(spark):
    """All words share their first six code points; no group may stay larger than a tile."""
    rng = random.Random(8)
    words = {"common" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))): rng.randint(1, 60) for _ in range(700)}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = [len(r.members) for r in spelling._grouped(given, 32).select("members").collect()]
    assert max(sizes) <= 32
    got = {r.word: tuple(r)[1:] for r in spelling.variant_groups(given, tile=32).collect()}
    assert got == brute_variants(words)


def test_word_query_matches_brute_force(spark, documents, tmp_path):
    extra = spark.createDataFrame(
        [(7, "ABCDEFÀÉ abcdefÀÉ abcdefàé straße STRASSE " * 3, None, None, 1), (7, None, None, None, None),
         (None, "nameless namelesz nameless " * 4, None, None, 3), (8, "", "", "", 0)], documents.schema)
    rows = documents.limit(60).unionByName(extra).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for r in rows.select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(LOWER)):
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            if r.doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    want = brute_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {r.word: tuple(r)[1:] for r in got.collect()} == want and len(want) > 300


def test_words_awkward_rows(awkward, make, spark):
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(awkward).collect()}
    assert got == {}  # digits part the words, and "word" has four letters
    assert spelling.spelling_variants(make([])).collect() == []
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).collect() == []


FILLER = "Plain words of some length, with a comma or two, that a reader came for. "
PAGES = {
    "semantic": (
        "<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu"
        "<li>More</ul></nav><main><article class='post'><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;para&#x67;raph,"
        " with\n  spaces.<p>Second, one <a href=x>link</a>.<ul><li>one<li>two</ul><script>var p='</p>';</script>"
        "<div class='ad-box'>Buy!</div><table><tr><td>a<td>b</table></article><aside>Side</aside></main>"
        "<section class=comments><article class=comment><p>Nice, really, very, nice, long comment</p></article></section>"
        "<form><p>Sign up</p></form><footer>&copy; us</footer></body></html>",
        "Title & more\nFirst bold paragraph, with spaces.\nSecond, one link.\none\ntwo\na\nb",
    ),
    "scored": (
        f"<body><div id=x1><a href=a>One</a> <a href=b>Two, three, four</a></div><div id=x2><h2>Head</h2><p>{FILLER * 3}</p>"
        f"<p>{FILLER * 2}</p><p>Short.</p></div><div id=sidebar><p>{FILLER * 9}</p></div><div class='cookie-notice'>{FILLER}</div></body>",
        f"Head\n{(FILLER * 3).strip()}\n{(FILLER * 2).strip()}\nShort.",
    ),
    "siblings": (
        f"<body><div><div><p>{FILLER * 4}</p><p>{FILLER * 4}</p></div><div><p>{FILLER * 3}</p></div>"
        f"<div><a href=q>{FILLER * 4}</a></div></div></body>",
        "\n".join([(FILLER * 4).strip()] * 2 + [(FILLER * 3).strip()]),
    ),
    "layout named after what it has": (
        f"<body class='has-sidebar'><div class='page with-comments'><p>{FILLER}</p></div></body>", FILLER.strip(),
    ),
    "left open": ("<article><h1>T</h1><p><b>One<br>more<p>Two<p>Th&lt;ree &am &amp", "T\nOne more\nTwo\nTh<ree &am &"),
    "no markup": ("just words &eacute;", "just words é"),
    "nothing": ("<html><body><nav><p>Menu, only, here</p></nav></body></html>", ""),
    "broken": ("<div></p></span><p>a</div></b><!-- x <p>b", "a"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of(name):
    html, text = PAGES[name]
    assert extraction.main_text(html) == text


def test_main_texts_of_the_given_pages(spark, small):
    """The given articles hold only headings, paragraphs and unclosed bold: one pattern reads them."""
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id] == (text, len(text))


def test_pages_awkward_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<p>a</p>"), (3, "u", "<div>" * 50_000 + "deep" + "</p>" * 50_000),
            (4, "u", "<p>" + "word, " * 60_000), (5, "u", "<" * 1000), (6, "u", "<a href='x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(9)).withColumn("a.b", F.lit(1))
    got = extraction.extract(pages).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.url, r.text) for r in got if r.page_id not in (4, 5, 6)} == {
        (1, None, ""), (2, "u", ""), (None, "u", "a"), (3, "u", "deep"),
    }
    assert {r.page_id: r.n_chars for r in got}[4] == 6 * 60_000 - 1 and all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(pages.limit(0)).collect() == []
