"""Main text of web pages, by tree scoring.

A page's tags become a tree; whatever its tags, roles or class names mark as menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment leaves it. Every block of text then passes points, for its length and its
commas, to the containers above it, the nearer the more, discounted by the share of its text that is links. The best
container is kept, with those of its siblings that score well too, or that are plain paragraphs beside it. The text of a
page is all blocks of what is kept, in page order.

A page is one unit of work, linear in its length; pages are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from courtline.llm.tables import bound_batches

# Fixed values of the markup language: elements without an end tag, elements that begin a block of their own, and those
# of them that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption html tbody td tfoot th thead tr".split())
# Start tags that end an open element of the listed names, up to the nearest of the elements after them.
ENDS_SIBLING = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
    "option": (("option",), ("select",)),
}
# Never text of an article.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input math menu nav noscript object "
    "script search select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
# Parts of class names and ids that mark what surrounds an article.
HINTS = frozenset(
    "ad adbox ads adsense advert advertisement advertising adverts advertorial alert banner banners breadcrumb "
    "breadcrumbs byline comment comments consent cookie cookies copyright discussion disqus feedback footer gdpr header "
    "hidden login masthead menu menus message modal nav navbar navigation newsletter notice notices notification outbrain "
    "overlay pager pagination paywall popup popups promo promos promotion promoted recommendations recommended register "
    "related replies reply respond responses rss search share sharing shoutbox sidebar sidebars signup skip skyscraper "
    "social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar tooltip widget widgets".split()
)
# Class names with one of these say what a part has or lacks, not what it is.
_ABOUT = frozenset("has is no not with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("article main".split())
_TEXT_PARENTS = frozenset("address blockquote caption dd dt figcaption li p pre summary td th".split()) | _HEADINGS
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_OPEN_END = re.compile(r"<(?:!--|/?[A-Za-z])")
_COMMAS = re.compile("[,،、，﹐﹑]")
# Containers above a block that get points, and lengths that count, as multiples of 100 characters.
LEVELS, LENGTHS = 5, 3
# Points of a sibling that is kept, besides a fifth of the best container's.
LEAST_SIBLING = 3.0


class _Node:
    __slots__ = ("tag", "parent", "children", "hinted", "about_main", "link", "dropped", "score", "chars", "linked", "place", "end")

    def __init__(self, tag: str, parent: _Node | None, hinted: bool = False) -> None:
        self.tag, self.parent, self.hinted = tag, parent, hinted
        self.children: list[_Node | str] = []
        self.link = tag == "a" or (parent is not None and parent.link)
        self.about_main = self.dropped = False
        self.score, self.chars, self.linked, self.place, self.end = 0.0, 0, 0, 0, 0


def _hinted(attributes: list[tuple[str, str | None]]) -> bool:
    for name, value in attributes:
        value = value or ""
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id"):
            for own in value.split():
                parts = {p.lower() for p in _PART.findall(own)}
                if parts & HINTS and not parts & _ABOUT:
                    return True
    return False


class _Tree(HTMLParser):
    """Builds the tree; closes what the language lets be left open, and ignores end tags of nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None)
        self.open = [self.root]
        self.count = {"html": 1}

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _end(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if any(self.count.get(n) for n in names):
            for at in range(len(self.open) - 1, 0, -1):
                tag = self.open[at].tag
                if tag in limits:
                    return
                if tag in names:
                    return self._cut(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end(("p",), ("td", "th", "table", "caption", "button", "object"))
        if tag in ENDS_SIBLING:
            self._end(*ENDS_SIBLING[tag])
        node = _Node(tag, self.open[-1], _hinted(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag) or tag == "html":
            return
        cell = tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th")
        for at in range(len(self.open) - 1, 0, -1):
            node = self.open[at]
            if node.tag == tag:
                return self._cut(at)
            if (cell and node.tag in ("td", "th")) or (tag not in BLOCKS and node.tag in BLOCKS):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class _Block:
    __slots__ = ("owner", "text", "chars", "linked")

    def __init__(self, owner: _Node, text: str, linked: int) -> None:
        self.owner, self.text, self.chars, self.linked = owner, text, len(text), min(linked, len(text))


def _prune(root: _Node) -> None:
    """Mark what is no article text. A name hint does not drop what holds an article of its own."""
    stack: list[tuple[_Node, bool]] = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, _Node)]
            continue
        node.about_main = (node.tag in _MAIN and not node.hinted) or any(
            c.about_main for c in node.children if isinstance(c, _Node)
        )
        hinted = node.hinted and not node.about_main and node.tag not in ("html", "body")
        node.dropped = node.tag in DROPPED or hinted


def _blocks(root: _Node) -> list[_Block]:
    """The blocks of text in page order, white space made one space; numbers the nodes and sums their text."""
    out: list[_Block] = []
    nodes = [root]
    parts: list[str] = []
    linked = 0
    owner, place = root, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(_Block(owner, text, linked))
        parts, linked = [], 0

    stack: list[tuple[_Node, Iterator, _Node]] = [(root, iter(root.children), root)]
    while stack:
        node, rest, outer = stack[-1]
        for child in rest:
            if isinstance(child, str):
                parts.append(child)
                if node.link:
                    linked += len(child.strip())
                continue
            place += 1
            child.place = child.end = place
            if child.dropped:
                # What goes still parts the words around it, and ends the block if it is one.
                if child.tag in BLOCKS:
                    flush()
                continue
            nodes.append(child)
            stack.append((child, iter(child.children), owner))
            if child.tag in BLOCKS:
                flush()
                owner = child
            elif child.tag == "br":
                parts.append(" ")
            break
        else:
            stack.pop()
            node.end = place
            if node.tag in BLOCKS:
                flush()
                owner = outer
    for block in out:
        block.owner.chars += block.chars
        block.owner.linked += block.linked
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    return out


def _container(block: _Block) -> _Node:
    """What a block gives its points to first: the element around a paragraph, or the one its bare text stands in."""
    node = block.owner
    return node.parent if node.tag in _TEXT_PARENTS and node.parent is not None else node


def _scored(blocks: list[_Block]) -> list[_Node]:
    """The containers with points, in page order."""
    found: dict[int, _Node] = {}
    for block in blocks:
        if block.owner.tag in _HEADINGS:
            continue
        points = 1 + len(_COMMAS.findall(block.text)) + min(block.chars / 100, LENGTHS)
        points *= 1 - block.linked / block.chars
        node: _Node | None = _container(block)
        for level in range(LEVELS):
            if node is None:
                break
            node.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            found[node.place] = node
            node = node.parent
    return [found[k] for k in sorted(found)]


def _value(node: _Node) -> float:
    return node.score * (1 - node.linked / node.chars) if node.chars else 0.0


def _kept(blocks: list[_Block]) -> list[_Node]:
    """The best container, or the article it is in, and the siblings that belong to it."""
    containers = _scored(blocks)
    best = max(containers, key=_value, default=None)
    if best is None:
        return [b.owner for b in blocks]
    top, node = best, best
    while node is not None:
        if node.tag == "article" or (node.tag == "main" and top.tag != "article"):
            top = node
        node = node.parent
    if top.parent is None:
        return [top]
    least = max(LEAST_SIBLING, 0.2 * _value(best))
    kept = [top]
    for child in top.parent.children:
        if isinstance(child, str) or child is top or child.dropped or not child.chars:
            continue
        density = child.linked / child.chars
        beside = child.tag == "p" and density < 0.25 and child.chars > 80 and top.tag not in _MAIN
        alike = top.tag not in _MAIN or child.tag == top.tag
        if beside or (alike and child.tag in BLOCKS and density < 0.5 and _value(child) >= least):
            kept.append(child)
        elif child.tag in _HEADINGS and density == 0 and top.tag not in _MAIN:
            kept.append(child)
    return kept


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks joined by line feeds; empty if there is none."""
    tree = _Tree()
    tree.feed(html or "")
    # A comment or tag that is still open where the page ends is no text.
    if _OPEN_END.match(tree.rawdata):
        tree.rawdata = ""
    tree.close()
    _prune(tree.root)
    blocks = _blocks(tree.root)
    spans = [(n.place, n.end) for n in _kept(blocks)]
    return "\n".join(b.text for b in blocks if any(a <= b.owner.place <= z for a, z in spans))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, and its code points.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed in
    page order. Null and empty pages, and pages without text outside menus and the like, have an empty text of 0 code
    points. Of equally good containers the first one counts. One row per row of ``pages``, so repeated ids and pages are
    each returned; null ids and urls stay null. An empty table gives no rows. Other columns are ignored, whatever their
    names.
    """
    bound_batches(pages)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    given = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return given.mapInArrow(task, "page_id long, url string, text string, n_chars long")
