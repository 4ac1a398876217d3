"""Main text of web pages by composite text density.

A page becomes a tree of nodes.  Each node gets the characters and tags below it, and those of links;
its composite density is characters per tag, lowered by the share of links.  The density sum of a node
adds up its children's densities.  The least density on the path from the body to the node of the
greatest density is the threshold, and the subtree with the greatest density sum among the nodes above
the threshold is the main content.  In it, what the markup itself calls navigation, advertising,
comments or a form is left out, and so are blocks below the threshold that consist of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
#: A tag with a quote that is never closed ends at the first ">".
_OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that separate blocks of text; all others run on within a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
OUTSIDE = frozenset("head script style noscript template iframe object embed applet svg canvas audio video map nav footer aside form button select textarea input option dialog menu noembed noframes xmp title".split())
#: Words of class, id and role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe signup login popup modal overlay nav navigation navbar menu breadcrumb breadcrumbs sidebar sidenav widget related recommended share sharing social comment comments respond replies disqus footer masthead copyright pagination pager toolbar complementary contentinfo search".split()
)
#: A start tag closes an open element of these kinds, up to a boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
P_BOUNDARY = frozenset("table td th button object caption html body".split())


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "name", "outside", "parent", "total", "tags")

    def __init__(self, name: str, parent: Node | None, outside: bool):
        self.name, self.parent, self.outside = name, parent, outside
        self.children: list[Node | str] = []


def _outside(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    found = {a.lower(): (v or "").strip("\"'").lower() for a, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    words = re.split(r"[^a-z]+", " ".join(found.get(k, "") for k in ("class", "id", "role")))
    return not MARKED.isdisjoint(words)


def _in_article(node: Node | None) -> bool:
    while node is not None and node.name not in ("article", "main"):
        node = node.parent
    return node is not None


def parse(html: str) -> Node:
    """The tree of a page; what is left open ends where an outer element ends."""
    root = now = Node("#root", None, False)
    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less < 0:
            now.children.append(unescape(html[at:]))
            break
        if less > at:
            now.children.append(unescape(html[at:less]))
        m = _TAG.match(html, less) or _OPEN_QUOTE.match(html, less)
        if not m:  # a lone "<" is text
            now.children.append("<")
            at = less + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            node = now
            while node.parent is not None and node.name != name:
                node = node.parent
            if node.parent is not None:
                now = node.parent
            continue
        if name in BLOCK and name != "br":
            # A block ends an open paragraph, and the inline elements left open in it.
            node = now
            while node.parent is not None and node.name != "p" and node.name not in P_BOUNDARY and (node.name not in BLOCK or node.name == "p"):
                node = node.parent
            if node.name == "p":
                now = node.parent
        if name in CLOSES:
            node = now
            while node.parent is not None and node.name not in BOUNDARY[name]:
                if node.name in CLOSES[name]:
                    now = node.parent
                node = node.parent
        child = Node(name, now, _outside(name, m[3]) or name == "header" and not _in_article(now))
        now.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            now = child
    return root


def _measure(root: Node) -> None:
    """Characters, tags and links below each node, then its density; children come before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    body_chars = body_links = 0
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACES.sub(" ", c).strip())
            elif not c.outside:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.name == "body" or node is root:
            body_chars, body_links = node.chars, node.link_chars
    ratio = body_links / body_chars if body_chars else 0.0
    for node in reversed(order):
        chars, tags, links, link_tags = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not chars:
            node.density = 0.0
        else:
            plain = max(chars - node.link_chars, 1)
            base = math.log(chars / plain * node.link_chars + ratio * chars + math.e)
            node.density = chars / tags * math.log(chars * tags / (links * link_tags) + 1.0, max(base, 1.0 + 1e-9))
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.outside) or node.density


def _main(root: Node) -> tuple[Node, float]:
    """The subtree of the greatest density sum, and the threshold from the path to the body."""
    top, stack, best = root, [root], root
    while stack:
        node = stack.pop()
        if node.name == "body":
            top = node
        if node.density > best.density and node.name not in ("#root", "html", "body"):
            best = node
        stack += [c for c in node.children if not isinstance(c, str) and not c.outside]
    threshold, node = best.density, best
    while node is not None and node.name not in ("#root", "html"):
        threshold = min(threshold, node.density)
        node = node.parent
    chosen, stack = None, [top]
    while stack:
        node = stack.pop()
        # Of equal sums the outer node is met first and stays.
        if node.density >= threshold and (chosen is None or node.total > chosen.total):
            chosen = node
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.outside]
    return _widened(chosen or top), threshold


def _widened(node: Node) -> Node:
    """The article or main element around the chosen node, so that its heading and short blocks stay."""
    at = node
    while at is not None:
        if at.name in ("article", "main"):
            return at
        at = at.parent
    return node


def _links_only(node: Node, threshold: float) -> bool:
    return node.name in ("ul", "ol", "div", "section", "p", "table") and node.chars > 0 and node.link_chars > 0.8 * node.chars and node.density < threshold


def text_of(html: str) -> str:
    """The main text of a page; empty if there is none."""
    root = parse(html)
    _measure(root)
    chosen, threshold = _main(root)
    blocks: list[str] = []
    parts: list[str] = []

    def end_block() -> None:
        block = _SPACES.sub(" ", "".join(parts)).strip()
        parts.clear()
        if block:
            blocks.append(block)

    stack: list[Node | str | None] = [chosen]
    while stack:  # None ends a block
        item = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.outside and not _links_only(item, threshold) or item is chosen:
            if item.name in BLOCK:
                end_block()
                stack.append(None)
            stack += reversed(item.children)
    end_block()
    return " ".join(blocks)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each row, from the whole page.

    Null or empty html and pages without an article give an empty text.  Repeated rows and null ids are
    kept as they are.  An empty table gives no rows.  Other columns of ``pages`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(h) if h else "" for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    id_type = pages.schema[id_col].dataType.simpleString()
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
