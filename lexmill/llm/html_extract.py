"""Main text of web pages by composite text density.

A small tolerant reader builds the tree of a page. Elements that never hold the article (scripts,
menus, asides, footers, hidden ones ...) are dropped by tag. Forms and elements whose class, id or role has a word of
noise (adverts, notices, reader comments ...) are under suspicion only: they go unless the page has next to no text without
them, since a wrapper of all of it may carry such a word too (see ``settle``). Each remaining node gets its characters and tags, link characters and link tags, and from
them the composite text density; the sum over a node's children scores the node. The node of the
largest sum is the article's core, and the least density on its path to the body is the threshold.
Outside the core only what reaches the threshold is taken: of each such node below nodes that reach
it too, the part of the largest sum. The ``article`` and ``main`` tags break ties only.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slabs, filled, only

# The elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
DROP = frozenset(
    "script style noscript template head title nav footer aside button input select option textarea label fieldset iframe object"
    " embed svg canvas audio video map dialog menu noembed noframes xmp applet".split()
)
#: An open element of the key closes when one of the values begins.
P_ENDS = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"} | {"table"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: Elements that an end tag of something outside them does not close.
SCOPE = frozenset("table td th article section main div body html ul ol blockquote aside nav footer header form".split())
#: Words of class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer header masthead sidebar aside widget toolbar"
    " comment comments commentlist disqus replies respond reply discussion"
    " cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay alert"
    " share sharing social related recommended recommendations trending search searchbox skip toc tags hidden"
    " complementary contentinfo dialog".split()
)
#: Words that mark the article itself, and the words of noise that they outweigh: those also said of an article's own parts.
KEEP = frozenset("article content main story post entry body text".split())
WEAK = frozenset("header masthead tags toc".split())

#: Words that turn a word of noise in the same name around: a page with a sidebar is none.
AROUND = frozenset("has with without no non free enabled disabled".split())
#: An element under suspicion stays if it holds so many times the text outside of all such elements, or more than it and a main heading.
OUTWEIGHS = 5

#: The elements that a beginning element of the key closes.
CLOSES = {tag: [t for t, ends in CLOSED_BY.items() if tag in ends] for tag in frozenset().union(*CLOSED_BY.values())}
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


@lru_cache(maxsize=4096)
def kinds_of(tag: str) -> tuple[str, ...]:
    """The tag itself, and what kinds of elements it is one of."""
    kinds = {"*scope": SCOPE, "*block": BLOCK | {"td", "th"}, "*holder": {"ul", "ol", "dl", "table", "select", "article", "div", "section"}, "*article": {"article", "main"}}
    return (tag, *(kind for kind, tags in kinds.items() if tag in tags))


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("block", "chars", "children", "density", "dropped", "kept", "link_chars", "link_tags", "own", "parent", "sum", "suspect", "tag", "tags", "titled", "top")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.own = self.sum = 0.0
        self.block = parent is None or tag in BLOCK or tag in ("td", "th")
        self.top = self


def judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element never holds the article, and whether it is under suspicion: 1, or 2 if its names also have a word of the article."""
    if tag in DROP or (tag == "header" and not inside_article):
        return True, 0
    noise: set[str] = set()
    keep = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if tag not in ("body", "html", "article", "main"):
            if name in ("class", "id", "role"):
                for each in value.split():
                    words = {w.lower() for w in _WORDS.findall(each)}
                    keep |= bool(words & KEEP)
                    if not words & AROUND:
                        noise |= words & NOISE
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return True, 0
    if tag == "form" or (noise and not (keep and noise <= WEAK)):
        return False, 2 if keep else 1
    return False, 0


def length(text: str) -> int:
    return len(_WHITE.sub(" ", html.unescape(text) if "&" in text else text).strip())


def settle(root: Node) -> Node:
    """Drops the elements under suspicion that the article can do without.

    Each is weighed by its own text, that of suspected elements in it left out, against the text outside of all of them. Those
    with a main heading come first, then those that also have a word of the article in their names, then the others in page order; what stays counts as outside for
    the next, and what it holds is weighed in turn.
    """
    nodes = in_order(root)
    for node in reversed(nodes):
        node.kept, node.titled = 0, node.tag in ("h1", "main")
        for c in node.children:
            if isinstance(c, str):
                node.kept += length(c)
            elif not c.dropped and not c.suspect:
                node.kept += c.kept
                node.titled |= c.titled
    outside, waiting, number = root.kept, [], count()

    def below(node: Node) -> None:
        todo = [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
        while todo:
            c = todo.pop()
            if c.suspect:
                heapq.heappush(waiting, (not c.titled, -c.suspect, next(number), c))
            else:
                todo.extend(x for x in reversed(c.children) if isinstance(x, Node) and not x.dropped)

    below(root)
    while waiting:
        node = heapq.heappop(waiting)[-1]
        if node.kept > outside * OUTWEIGHS or (node.titled and node.kept > outside):
            outside += node.kept
            below(node)
        else:
            node.dropped = True
    return root


class Stack:
    """The open elements, and of each tag and of some kinds of tags the places where they stand, so that no step walks through the stack."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at = [root], {}

    def last(self, kind: str) -> int:
        """The place of the innermost open element of a tag or kind; 0 (the root's) if there is none."""
        places = self.at.get(kind)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        for kind in kinds_of(node.tag):
            self.at.setdefault(kind, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            for kind in kinds_of(self.nodes.pop().tag):
                self.at[kind].pop()


def parse(page: str) -> Node:
    """The tree of a page in linear time; broken nesting is mended much as browsers do."""
    root = Node("html", None, False)
    at, stack, end = 0, Stack(root), len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        top = stack.nodes[-1]
        if not m:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        closing, opening, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if closing:
            tag = closing.lower()
            if tag in ("html", "body"):
                continue
            if tag == "br":
                top.children.append(" ")
                continue
            depth = stack.last(tag)
            if depth and (tag in SCOPE or tag in BLOCK or stack.last("*scope") < depth):  # else a stray inline end tag
                stack.pop_to(depth)
        elif opening:
            tag = opening.lower()
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                top.children.append("\n" if tag == "hr" else " ")
                continue
            if tag in P_ENDS and stack.last("p") and stack.last("p") == stack.last("*block"):
                stack.pop_to(stack.last("p"))
            while closed := max((stack.last(t) for t in CLOSES.get(tag, ())), default=0):
                if closed < stack.last("*holder"):
                    break
                stack.pop_to(closed)
            top = stack.nodes[-1]
            dropped, suspect = judged(tag, attributes, stack.last("*article") > 0)
            node = Node(tag, top, top.dropped or dropped)
            node.suspect = suspect
            top.children.append(node)
            if tag in RAW:
                close = RAW_ENDS[tag].search(page, at)
                node.children.append(page[at : close.start() if close else end])
                at = close.end() if close else end
            elif not attributes.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "em", "strong", "span"):  # else an empty element of a foreign vocabulary
                stack.push(node)
    return settle(root)


def in_order(root: Node) -> list[Node]:
    """All kept nodes, parents before their children."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    return found


def measure(root: Node) -> list[Node]:
    """Counts, densities, sums and best parts of all kept nodes that are blocks or hold some; bottom up without recursion."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += length(c)
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                node.block |= c.block
        if node.tag == "a":
            node.link_chars = node.chars
    whole, linked = max(1, root.chars), root.link_chars

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if chars <= 0:
            return 0.0
        t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
        base = math.log(chars / max(1, chars - link_chars) * lc + max(1, linked) / whole * chars + math.e)  # over 1
        return chars / t * max(0.0, math.log(chars / lc * t / lt)) / math.log(base)

    nodes = [n for n in nodes if n.block]
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
        below = [c for c in node.children if isinstance(c, Node) and c.block and not c.dropped]
        # text directly in a node, with its inline elements, counts like a child that holds it
        node.own = density(
            node.chars - sum(c.chars for c in below),
            node.tags - sum(c.tags + 1 for c in below),
            node.link_chars - sum(c.link_chars for c in below),
            node.link_tags - sum(c.link_tags + (c.tag == "a") for c in below),
        )
        node.sum = node.own + sum(c.density for c in below)
        node.top = max([node, *(c.top for c in below)], key=lambda n: (n.sum, n.chars, n.tag in ("article", "main")))
    return nodes


def main_nodes(root: Node) -> tuple[set[Node], set[Node], float]:
    """The nodes whose text is the article's, their ancestors, and the threshold."""
    measure(root)
    path, node = [], root.top
    while node is not None:
        path.append(node)
        node = node.parent
    least = min(n.density for n in path)
    taken, above, todo = {root.top}, set(path[1:]), [root]
    while todo:
        node = todo.pop()
        if node in taken or not node.chars or node.density < least:
            continue
        top = node.top
        taken.add(top)
        up = top.parent
        while up is not None and up not in above:
            above.add(up)
            up = up.parent
        todo.extend(c for c in node.children if isinstance(c, Node) and c.block and not c.dropped)
    return taken, above, least


def blocks_of(root: Node) -> list[str]:
    """The article's blocks in page order: references decoded, white space made one space, trimmed."""
    taken, above, least = main_nodes(root)
    blocks: list[str] = []
    open_text: list[str] = []

    def cut() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(open_text))).strip()
        open_text.clear()
        if text:
            blocks.append(text)

    todo: list[Node | str | None] = [root]
    while todo:
        item = todo.pop()
        if item is None:
            cut()
        elif isinstance(item, str):
            open_text.append(item)
        elif not item.dropped:
            block = item.tag in BLOCK
            if block:
                cut()
                todo.append(None)
            elif item.tag in ("td", "th"):
                open_text.append(" ")
            inside = item.children
            if item in above and item not in taken:  # of an ancestor only what is taken or leads there, and its own text if dense enough
                inside = [c for c in inside if (c in taken or c in above if isinstance(c, Node) and c.block else item.own >= least)]
            todo.extend(reversed(inside))
    cut()
    return blocks


def main_text(page: str) -> str:
    """The blocks of the article, two line ends between them."""
    return "\n\n".join(blocks_of(parse(page)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars``.

    A null or empty page and one without main text give an empty text. Repeated rows and null ids
    are kept; of parts of equal density sum an ``article`` or ``main`` wins, else the outer one. An empty table gives
    no rows. Every page is read whole, whatever its length or depth, in time linear in it. Needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in by_slabs(batches, "html"):
            texts = [main_text(page) for page in slab.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [slab.column("id"), slab.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"]
            )

    rows = only(pages, id=id_col, url=url_col, html=html_col).withColumn("html", filled(F.col("html")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
