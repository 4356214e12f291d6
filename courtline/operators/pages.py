"""Elements of stored pages, from a tag-level reader with a stack."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, and start tags that end an open element up to the nearest limit.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "a": (("a",), ("td", "table")), "li": (("li",), ("ul", "ol")), "option": (("option",), ("select",)),
    "p": (("p",), ("td", "table")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_HIDDEN = ("script", "style")
ELEMENTS = """struct<text: string, elements: array<struct<
    place: int, last: int, tag: string, classes: array<string>, attributes: map<string, string>, begin: int, size: int>>>"""
_ELEMENT = pa.struct([
    ("place", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
    ("attributes", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("size", pa.int32()),
])
_PAGE = pa.struct([("text", pa.string()), ("elements", pa.list_(_ELEMENT))])

# Plain markup: what this does not match, or has the tags below, goes to Python's parser.
_TOKEN = re.compile(r"""(([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*(?:="[^"&]*"|='[^'&]*'|=[a-zA-Z0-9_.:\#%-]+(?=[ \t\n>]))?)*)[ \t\n]*/?>
    |</([a-zA-Z][a-zA-Z0-9]*)>|(<!--(?!-?>)[^-]*(?:-[^-]+)*-->|<!(?i:doctype)[^>\[]*>)
    |([\s\S]+))""", re.X)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)"|='([^']*)'|=([^ \t\n]+))?""")
_RAW = frozenset("textarea iframe noembed noframes noscript xmp plaintext svg math".split())
# Tags whose content is text only; plain if it ends at once.
_TEXT_ONLY = {tag: re.compile(rf"[^<]*</{tag}>", re.I) for tag in ("title", "script", "style")}
# Pages are turned into Arrow once they come to this many characters, so a worker holds the objects of few at a time.
_CHUNK = 1 << 18


@lru_cache(maxsize=4096)
def _attributes(plain: str) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Classes, and names with values, of a tag's attributes; the first of equal names counts. Few texts are met often."""
    first: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(plain):
        first.setdefault(name.lower(), a or b or c)
    return tuple(first["class"].split()) if "class" in first else (), tuple(first.items())


class _Reader(HTMLParser):
    """All elements in page order, each with its last descendant and its stretch of the page's text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.counts: dict[str, int] = {}
        self.text: list[str] = []
        self.length = 0

    def _close(self, name: str, limits: tuple[str, ...] = ()) -> None:
        """End the innermost open element of this name and all inside it; nothing if a limit comes first."""
        if not self.counts.get(name):
            return
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at]["tag"]
            if tag == name:
                return self._cut(at)
            if tag in limits:
                return

    def _cut(self, at: int) -> None:
        last, length, counts = len(self.found) - 1, self.length, self.counts
        for element in self.open[at:]:
            counts[element["tag"]] -= 1
            element["last"], element["size"] = last, length - element["begin"]
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            for name in ENDS[tag][0]:
                self._close(name, ENDS[tag][1])
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        place = len(self.found)
        element = {"place": place, "last": place, "tag": tag, "classes": first["class"].split() if "class" in first else [],
                   "attributes": list(first.items()), "begin": self.length, "size": 0}
        self.found.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.counts[tag] = self.counts.get(tag, 0) + 1
        else:
            self.handle_data(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, () if tag in ("table", "tr", "td", "th") else ("td", "th"))

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1]["tag"] not in _HIDDEN:
            self.text.append(data)
            self.length += len(data)

    def result(self) -> dict:
        self._cut(0)
        return {"text": "".join(self.text), "elements": self.found}


    def read(self, html: str) -> bool:
        """Read a page of plain markup without the parser; false, with what was read so far, for any other."""
        at, text, opened, found, counts, length = 0, self.text, self.open, self.found, self.counts, 0
        for token, data, start, attributes, stop, _, other in _TOKEN.findall(html):
            at += len(token)
            if data:
                if not opened or opened[-1]["tag"] not in _HIDDEN:
                    data = unescape(data) if "&" in data else data
                    text.append(data)
                    length += len(data)
            elif start:
                tag = start.lower()
                if tag in _RAW or (tag in _TEXT_ONLY and not _TEXT_ONLY[tag].match(html, at)):
                    return False
                if tag in ENDS:
                    self.length = length
                    for name in ENDS[tag][0]:
                        if counts.get(name):
                            self._close(name, ENDS[tag][1])
                classes, items = _attributes(attributes) if attributes else ((), ())
                place = len(found)
                element = {"place": place, "last": place, "tag": tag, "classes": list(classes), "attributes": list(items),
                           "begin": length, "size": 0}
                found.append(element)
                if tag not in VOID:
                    opened.append(element)
                    counts[tag] = counts.get(tag, 0) + 1
                elif not opened or opened[-1]["tag"] not in _HIDDEN:
                    text.append(" ")
                    length += 1
            elif stop:
                tag = stop.lower()
                if opened and opened[-1]["tag"] == tag:
                    element = opened.pop()
                    counts[tag] -= 1
                    element["last"], element["size"] = len(found) - 1, length - element["begin"]
                else:
                    self.length = length
                    self.handle_endtag(tag)
            elif other:
                return False
        self.length = length
        return True


def read_page(html: str | None) -> dict | None:
    if html is None:
        return None
    reader = _Reader()
    if not reader.read(html):
        reader = _Reader()
        reader.feed(html)
        reader.close()
    return reader.result()


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def words_of(page: dict, element: dict | None) -> str | None:
    """What :func:`text_of` gives of an element of :func:`read_page`."""
    if element is None:
        return None
    begin = element["begin"]
    text = page["text"][begin : begin + element["size"]]
    return text if text.isalnum() else _SPACE.sub(" ", text).strip(" ")


def first_of(elements: list[dict], tag: str | None = None, classes: tuple[str, ...] = (), at: int = 0) -> dict | None:
    """What :func:`first` gives of the elements that :func:`select` finds."""
    for e in elements:
        if tag is None or e["tag"] == tag:
            for c in classes:
                if c not in e["classes"]:
                    break
            else:
                if not at:
                    return e
                at -= 1
    return None


def inside(page: dict, element: dict | None) -> list[dict]:
    """The descendants of an element in page order."""
    return page["elements"][element["place"] + 1 : element["last"] + 1] if element is not None else []


def with_picked(pages: DataFrame, pick: Callable[[dict], dict], columns: list[str], html: str = "html") -> DataFrame:
    """``pages`` with text ``columns`` in place of the page: what ``pick`` finds in what :func:`read_page` gives, and null for
    null pages. No element leaves the worker."""
    kind = pa.struct([(c, pa.string()) for c in columns])

    def read(values: pa.Array) -> pa.Array:
        done, some, size = [], [], 0
        for value in values:
            text = value.as_py()
            some.append(pick(read_page(text)) if text is not None else {})
            size += len(text or "")
            if size >= _CHUNK:
                done.append(pa.array(some, kind))
                some, size = [], 0
        return pa.concat_arrays([*done, pa.array(some, kind)])

    found = pages.withColumn(html, F.arrow_udf(read, "struct<" + ", ".join(f"{c}: string" for c in columns) + ">")(html))
    return found.select(*[c for c in pages.columns if c != html], *[F.col(html)[c].alias(c) for c in columns])


def _elements(pages: pa.Array, wanted: tuple[tuple[str | None, tuple[str, ...]], ...] = ()) -> pa.Array:
    """The pages read, as Arrow, with the elements that fit one of ``wanted`` (all without it)."""
    nothing = {"text": None, "elements": None}

    def read(html: str | None) -> dict:
        page = read_page(html) or nothing
        if wanted and page["elements"]:
            page["elements"] = [
                e for e in page["elements"] if any((t is None or e["tag"] == t) and all(c in e["classes"] for c in cs) for t, cs in wanted)
            ]
        return page

    done, some, size = [], [], 0
    for value in pages:
        html = value.as_py()
        some.append(read(html))
        size += len(html or "")
        if size >= _CHUNK:
            done.append(pa.array(some, _PAGE))
            some, size = [], 0
    return pa.concat_arrays([*done, pa.array(some, _PAGE)])


def with_elements(
    pages: DataFrame, out: str = "page", html: str = "html", wanted: tuple[tuple[str | None, tuple[str, ...]], ...] = ()
) -> DataFrame:
    """``pages`` with the struct ``out``: the page's text, and its elements in page order.

    ``wanted`` names elements as (tag or None, classes): with it only those that fit one of them are given, placed as in the
    whole page.

    An element's descendants are those after it up to ``last``; its text, theirs included, is ``size`` characters of the
    page's text from ``begin`` on (:func:`text_of`). Attribute values come with either quote or none, and decoded; the first
    of equal attributes counts. Scripts, styles and comments have no text. What is left open ends with what it is in.
    Null pages have neither text nor elements.
    """
    def read(values: pa.Array) -> pa.Array:
        return _elements(values, wanted)

    return pages.withColumn(out, F.arrow_udf(read, ELEMENTS)(html))


def text_of(element: Column, page: str = "page") -> Column:
    """An element's text, white space as one space, trimmed; null for a null element."""
    whole = F.substring(F.col(f"{page}.text"), element["begin"] + 1, element["size"])
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def select(page: str = "page", tag: str | None = None, classes: tuple[str, ...] = (), inside: Column | None = None) -> Column:
    """The elements with this tag and all these classes, in page order; with ``inside`` only descendants of it."""

    def fits(e: Column) -> Column:
        test = F.lit(True) if tag is None else e["tag"] == tag
        for c in classes:
            test = test & F.array_contains(e["classes"], F.lit(c))
        if inside is not None:
            test = test & (e["place"] > inside["place"]) & (e["place"] <= inside["last"])
        return test

    return F.filter(F.col(f"{page}.elements"), fits)


def first(elements: Column, at: int = 0) -> Column:
    """The element at a position; null where there is none."""
    return F.get(elements, F.lit(at))
