"""The element reader against pages written by hand, and over the whole given pages."""

import random
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from courtline.operators import ingest
from courtline.operators.pages import _elements, _Reader, first, read_page, select, text_of, with_elements

PAGE = """<html><!-- <a href="/no">no</a> --><body class=x><script>var a = "<td class='fg'>0</td>";</script>
<div class="team away"><a HREF='/id/7?x=1&amp;y' class="team-name">St. <b>John&#39;s</b></a><table><tr><td class=fg>27<i>-55</i><td class=pts>7
&nbsp;0</table></div><div class='team home'><p>open <a href=/b>two<p>next <br>line</div><a href="/c"><img src=x></a><a>none</a>"""


def elements(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return with_elements(pages)


def test_nested_markup(spark):
    df = elements(spark, PAGE)
    away = first(select(tag="div", classes=("team", "away")))
    home = first(select(classes=("home",)))
    got = df.select(
        text_of(first(select(tag="a", inside=away))).alias("name"), first(select(tag="a", inside=away))["attributes"]["href"].alias("href"),
        text_of(first(select(tag="td", classes=("fg",), inside=away))).alias("fg"),
        text_of(first(select(tag="td", classes=("pts",), inside=away))).alias("pts"),
        text_of(first(select(tag="td", inside=home))).alias("none"), text_of(first(select(tag="p"), 1)).alias("second"),
        F.size(select(tag="a")).alias("anchors"),
    ).first()
    assert (got.name, got.href, got.fg, got.none, got.second, got.anchors) == ("St. John's", "/id/7?x=1&y", "27-55", None, "next line", 4)
    assert got.pts.split() == ["7", "0"]


def test_links_of_nested_anchors(spark):
    pages = spark.createDataFrame([(PAGE,), (PAGE,), (None,), ("",)], "html string")
    got = {tuple(r) for r in ingest.links(pages, "").collect()}
    assert got == {("St. John's", "/id/7?x=1&y"), ("two", "/b"), ("", "/c")}
    assert ingest.links(pages.limit(0), "").collect() == []


def test_every_element_ends_in_its_parent():
    page = read_page(PAGE + "<div>" * 3000 + "x" + "</p>" * 50)
    stack = []
    for e in page["elements"]:
        while stack and stack[-1]["last"] < e["place"]:
            stack.pop()
        assert not stack or e["last"] <= stack[-1]["last"]
        assert not stack or stack[-1]["begin"] <= e["begin"] and e["begin"] + e["size"] <= stack[-1]["begin"] + stack[-1]["size"]
        stack.append(e)


class Anchors(HTMLParser):
    """The standard parser, reading anchors only."""

    def __init__(self):
        super().__init__()
        self.found, self.href, self.text = set(), None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.add((" ".join("".join(self.text).split()), self.href))


def test_links_equal_the_standard_parser_over_nested_pages(spark, small):
    """Every page of the table, its anchors given other quotes, inner markup and references."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("html")
    nested = pages.select(F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "<A class=k\n href='$1?a=1&amp;b=2'><b>x&lt;<!-- c --></b> $2</A>").alias("html"))
    want = set()
    for r in nested.collect():
        parser = Anchors()
        parser.feed(r.html)
        want |= parser.found
    assert {tuple(r) for r in ingest.links(nested, "").collect()} == want and len(want) > 20


def test_labelled_text_decodes(spark):
    pages = spark.createDataFrame([(1, "<title>a &amp;  b</title><div class='x ad'>c<b>d</b></div>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in ingest.labelled_text(pages).orderBy("page_id").collect()] == [(1, "a & b", None, "cd"), (2, None, None, None)]


def test_plain_markup_reads_as_the_parser_does():
    """The reader without the parser says what the parser says, or leaves the page to it."""
    rng = random.Random(1)
    bits = [
        "<a href='x'>", '<A HREF="y z" href=q>', "</a>", "<td class=fg>", "<td>", "</td>", "<tr>", "<table>", "</table>", "<br/>", "<b>", "</b>",
        "</ b>", "x &amp; y", "&copy", "& ", "&#45;", "<!-- a - b -->", "<!-->", "<!DOCTYPE html>", "<title>", "t</title>", "<title>a</title>",
        "<script>", "<script>a &amp; b</script>", "<style>p</style>", "</style>", "<3", '"', "'", '<a href="a&amp;b">', "<a b c=d/>", "<li>", "<x-y>",
        '<div class="team home">', "</div>", "<", "</", "&lt", "<textarea>", "<b/>",
    ]
    plain = 0
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        whole, quick = _Reader(), _Reader()
        whole.feed(html)
        whole.close()
        if quick.read(html):
            plain += 1
            assert quick.result() == whole.result(), html
        assert read_page(html) == whole.result()
    assert plain > 300


def test_box_score_page_needs_no_parser():
    assert _Reader().read("<html><title>a</title><td class=fg><span title='a > b'>7<i>&#45;</i>9</span></html>")


def test_wanted_elements_only():
    """Elements come in groups of few pages; those not asked for stay behind, and places are those of the whole page."""
    pages = pa.array([PAGE, None, "<b>x</b>" * 40_000, PAGE])
    every, some = _elements(pages).to_pylist(), _elements(pages, (("a", ()), (None, ("team",)))).to_pylist()
    assert every == [read_page(h) or {"text": None, "elements": None} for h in pages.to_pylist()]
    for a, b in zip(every, some):
        assert a["text"] == b["text"]
        fit = a["elements"] and [e for e in a["elements"] if e["tag"] == "a" or "team" in e["classes"]]
        assert b["elements"] == fit
