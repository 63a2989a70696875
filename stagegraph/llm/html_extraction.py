"""HTML extraction by tree scoring.

A page becomes a tree. Each paragraph earns points for itself, its length and its commas, and passes them to its ancestors, less with
each step; a container's points are discounted by its link density. The best container and those of its siblings that look like text
are kept; their blocks are the page's main text. Inside an article the article is the container, and all of its text is kept.

Left out before scoring:

* always: scripts, styles, navigation, footers, asides, controls, dialogs and hidden elements;
* as furniture: forms, headers of the page, and elements whose role, class or id names furniture (menus, banners, sidebars, notices,
  adverts, comments of readers). A class counts if it is such a word or has one as a part (``site-header``), but not after ``has-``,
  ``no-`` and the like. An element that holds most of the page's text is no furniture but a wrapper and stays; what it holds is judged
  again. For a class that is the word itself nearly nothing may be left beside it, and the element must have headings or paragraphs;
* lists of bare links at the start or the end of what is kept.

Defined cases: a null or empty page has an empty text, and so has a page of furniture only; markup that is cut off or badly nested is
read as far as it goes, a quote that is never closed ends with its tag; elements nested deeper than ``DEEPEST`` are siblings of each other;
a page without any paragraph is scored by its other blocks; repeated rows each have their row; an empty table gives an empty result;
further columns are ignored; pages are whole at any length.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, pieces, record, table

# Element names of HTML by their part in a page, and words that name furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
NEVER = frozenset("nav footer aside button select input textarea label script style noscript template iframe object embed canvas svg math dialog menu head title audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body form #root".split())
DEEPEST = 256
CLOSES_P = BLOCK - frozenset("html body tbody td tfoot th thead tr caption".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar side nav navs navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar share sharing social related recommended recommendations widget widgets pagination pager toolbar search skip hidden".split()
)
READERS = frozenset("comment comments commentlist respond disqus replies reply".split())
MODIFIERS = ("has-", "no-", "with-", "without-", "is-", "not-", "hide-", "show-", "has_", "no_", "with_", "without_")
PLAIN, PART, WHOLE, COMMENTS, HIDDEN = range(5)  # how sure it is that an element is furniture
NEARLY_NOTHING = 200  # characters

_QUOTED = r"\"[^\"]*\"|'[^']*'"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:{_QUOTED}|(?![\"'])[^\s>]+))?|=)*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("name", "children", "parent", "depth", "points", "size", "linked", "blocky", "mark", "rich")

    def __init__(self, name: str, parent: Node | None, mark: int = PLAIN):
        self.name, self.parent, self.mark = name, parent, mark
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.rich = 0
        self.blocky = False

    def prose(self) -> int:
        return self.size - self.linked


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _word_mark(names: str) -> int:
    mark = PLAIN
    for token in names.lower().split():
        if token.startswith(MODIFIERS):
            continue
        if token in READERS:
            return COMMENTS
        parts = {token} if token in WORDS else set(re.split(r"[-_\d]+", token))
        if token in WORDS or parts & WORDS or parts & READERS:
            mark = max(mark, WHOLE if token in WORDS else PART)
    return mark


def _mark(name: str, attrs: dict[str, str], inside_article: bool) -> int:
    if name in NEVER or "hidden" in attrs or _HIDES.search(attrs.get("style", "")):
        return HIDDEN
    if name in ("html", "body", "main"):
        return PLAIN
    mark = max(_word_mark(attrs.get("class", "")), _word_mark(attrs.get("id", "")))
    if name == "article":
        return mark if mark == COMMENTS else PLAIN
    if name == "header" and not inside_article or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        mark = max(mark, WHOLE)
    return max(mark, PART) if name in ("form", "fieldset") else mark


def parse(page: str) -> Node:
    """The tree of a page, furniture marked; hidden elements hang nowhere."""
    root = Node("#root", None)
    at, place, articles = root, 0, 0
    while m := _TAG.search(page, place):
        if place < m.start():
            at.children.append(html.unescape(page[place : m.start()]))
        place = m.end()
        if m["cdata"]:
            at.children.append(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if _is_open(at, name, stop=frozenset() if name in BLOCK else BLOCK):
                while at.name != name:
                    articles -= at.name in ("article", "main")
                    at = at.parent
                articles -= at.name in ("article", "main")
                at = at.parent
            continue
        closed = m["attrs"].endswith("/")
        if name in RAW and not closed:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, place)
            place = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                at.children.append(Node("hr", at))
            elif name in ("br", "wbr"):
                at.children.append(" " if name == "br" else "")
            continue
        if name in CLOSES_P and _is_open(at, "p", stop=frozenset(("article", "section", "div", "td", "li", "blockquote", "body", "main", "button"))):
            while at.name != "p":
                at = at.parent
            at = at.parent
        for group, stop in ((("li",), ("ul", "ol")), (("dt", "dd"), ("dl",)), (("tr",), ("table",)), (("td", "th"), ("tr", "table")), (("option",), ("select",))):
            if name in group:
                for one in group:
                    if _is_open(at, one, stop=frozenset(stop)):
                        while at.name != one:
                            at = at.parent
                        at = at.parent
        mark = _mark(name, _attributes(m["attrs"]) if m["attrs"] else {}, articles > 0)
        if at.depth >= DEEPEST:  # deeper elements are its children, one after another
            at = at.parent
        node = Node(name, at, mark)
        if mark != HIDDEN:
            at.children.append(node)
        if not closed or name in BLOCK:
            articles += name in ("article", "main")
            at = node
    if place < len(page):
        at.children.append(html.unescape(page[place:]))
    return root


def _is_open(at: Node, name: str, stop: frozenset[str] = frozenset()) -> bool:
    while at is not None and at.name not in stop:
        if at.name == name:
            return True
        at = at.parent
    return False


def _measure(root: Node) -> list[Node]:
    """Text lengths, overall and in links, of each node, and its headings and paragraphs; the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        node.size = sum(c.size for c in inner) + sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.blocky = any(c.name in BLOCK or c.blocky for c in inner)
        node.linked = node.size if node.name == "a" else sum(c.linked for c in inner)
        own = 2 if node.name in ("article", "main", "h1", "h2") else 1 if node.name in ("p", "pre", "blockquote") and node.prose() > 20 else 0
        node.rich = own + sum(c.rich for c in inner)
    return order


def _without_furniture(root: Node) -> None:
    """Take marked elements off the tree, but for those that wrap most of the page's text."""
    _measure(root)
    while True:
        tops, stack = [], [root]
        while stack:
            for c in stack.pop().children:
                if isinstance(c, Node):
                    (tops if c.mark else stack).append(c)
        if not tops:
            return
        big = max(tops, key=Node.prose)
        beside = root.prose() - sum(c.prose() for c in tops)
        least = big.prose() / 4 if big.mark == PART else min(NEARLY_NOTHING, big.prose() / 4) if big.mark == WHOLE else 0.5
        if big.rich < 2 or beside >= least:
            break
        big.mark = PLAIN
    for c in tops:
        c.parent.children.remove(c)


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _text(c) for c in node.children)


def score(order: list[Node]) -> list[Node]:
    """Pass the paragraphs' points up; the candidates, best first."""
    found: dict[int, Node] = {}
    for p in order:
        if p.name in CONTAINERS or (p.blocky and p.name in ("blockquote", "td", "dd", "li")):
            text = "".join(c if isinstance(c, str) else "" if c.blocky or c.name in BLOCK else _text(c) for c in p.children)  # of its own
            size = len(" ".join(text.split()))
        elif p.name in ("p", "pre", "blockquote", "td", "dd", "li", *HEADINGS):
            text, size = _text(p), p.size
        else:
            continue
        if not size:
            continue
        points = (0.25 if p.name in HEADINGS or p.name == "li" else 1.0) + text.count(",") * 0.5 + min(size / 100, 5.0)
        at, share = (p if p.parent is None or p.name in CONTAINERS else p.parent), 1.0
        while at is not None and share > 0.05:
            at.points += points * share
            found[id(at)] = at
            at, share = at.parent, share * (0.5 if share == 1.0 else 0.33)
    place = {id(n): i for i, n in enumerate(order)}
    return sorted(found.values(), key=lambda n: (-n.points * (1 - _density(n)), place[id(n)]))


def _within(node: Node, names: tuple[str, ...]) -> Node | None:
    while node is not None and node.name not in names:
        node = node.parent
    return node


def _reads_like_text(node: Node) -> bool:
    return node.prose() > 0 and _density(node) < 0.25 and (node.size > 80 or _text(node).rstrip().endswith((".", "!", "?", "\u2026", ":", '"', "\u201d")))


def _container(best: Node) -> Node:
    """The article that the best container lies in, or it itself, or an ancestor that joins it with other large pieces of text."""
    found = _within(best, ("article",)) or _within(best, ("main",))
    if found is not None:
        return found
    while best.parent is not None and best.parent.name not in ("body", "html", "#root"):
        others = [c for c in best.parent.parent.children if isinstance(c, Node) and c is not best.parent] if best.parent.parent is not None else []
        if not any(_density(c) < 0.25 and 4 * c.prose() > best.prose() for c in others):
            break
        best = best.parent
    return best


def _siblings(best: Node) -> list[Node]:
    """The best container and its siblings that read like text, in page order."""
    if best.parent is None:
        return [best]
    least = 0.25 * best.points * (1 - _density(best))
    kept, elements = [], [c for c in best.parent.children if isinstance(c, Node)]
    at = elements.index(best)
    while at and elements[at - 1].name in HEADINGS:  # headings right before it are its own
        at -= 1
    titles = elements[at : elements.index(best)]
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node):
            prose = c.name in ("p", "pre", "blockquote", "div", "section") and _reads_like_text(c)
            if c.points * (1 - _density(c)) >= least > 0 or prose or (c.name == "h1" and c.size) or c in titles:
                kept.append(c)
    return kept


def _is_menu(node: Node, inside_article: bool) -> bool:
    """A list of bare links; outside of an article any block of links."""
    if inside_article:
        return node.name in ("ul", "ol") and _density(node) > 0.9 and node.size <= 20 * max(1, sum(isinstance(c, Node) for c in node.children))
    return node.name in ("ul", "ol", "dl", "table", "section", "div") and _density(node) > 0.6


def _blocks(node: Node, out: list[tuple[list[str], bool]], inside_article: bool, menu: bool = False) -> None:
    """(pieces of text, whether of a menu) of each block."""
    if node.name == "header":  # of an article: its headings only
        for c in node.children:
            if isinstance(c, Node) and (c.name in HEADINGS or c.name in ("hgroup", "div")):
                _blocks(c, out, inside_article, menu)
        return
    menu = menu or (node.size > 0 and _is_menu(node, inside_article))
    block = node.name in BLOCK
    if block:
        out.append(([], menu))
    for c in node.children:
        if isinstance(c, Node):
            _blocks(c, out, inside_article, menu)
        else:
            out[-1][0].append(c)
    if block:
        out.append(([], menu))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _without_furniture(root)
    ranked = score(_measure(root))
    if not ranked:
        return ""
    best = _container(ranked[0])
    out: list[tuple[list[str], bool]] = [([], False)]
    for node in _siblings(best):
        _blocks(node, out, _within(node, ("article", "main")) is not None)
    lines = [(text, menu) for x, menu in out if (text := " ".join("".join(x).split()))]
    while lines and lines[0][1]:
        lines.pop(0)
    while lines and lines[-1][1]:
        lines.pop()
    return "\n".join(text for text, _ in lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages."""
    shape = "page_id long, url string, text string, n_chars long"
    target = arrow_schema(pages.sparkSession, shape)

    def run(batches):
        for batch in pieces(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield record({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}, target)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, shape)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
