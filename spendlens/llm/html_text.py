"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^\"'>])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe object textarea title xmp noframes".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the second set, up to an element of the third.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BODIES = {"article", "main"}
#: What is never main text, by element, by role, and by the words of class and id.
_ASIDE_TAGS = set("nav footer aside form head header button select input label svg canvas audio video map dialog menu".split())
_ASIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices "
    "banner popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments "
    "disqus reply replies respond toolbar pagination pager skip copyright disclaimer".split()
)
_COMMENT_NAMES = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Inside an article or main, names of layout; with a heading they are parts of the text, or boxes of links.
_TITLE_NAMES, _BOX_NAMES = {"header", "masthead", "banner", "overlay"}, {"widget", "widgets"}
#: Aside tags and roles that may also frame a whole page.
_FRAME_TAGS, _FRAME_ROLES = {"form", "header"}, {"form", "banner"}
#: First and last words of names that tell what a frame holds, not what it is: has-sidebar, comments-open.
_STATE_FIRST, _STATE_LAST = {"no", "not", "has", "have", "with", "without"}, {"open", "closed", "enabled", "disabled", "on", "off"}
#: Characters of its own outside links from which a block without p counts as a paragraph.
_PARAGRAPH = 80


class Node:
    """An element: its children in page order, and the figures of its subtree."""

    __slots__ = (
        "tag", "attrs", "parent", "items", "kind", "names", "free", "holds", "article",
        "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "main",
    )

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.density = self.total = 0.0
        self.main = False

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        """The subtree in page order, without recursion: pages may nest without end."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children()))


def parse(page: str) -> Node:
    """A tree of the page; missing end tags are implied, stray ones ignored, raw elements left out."""
    root = at = Node("html")
    open_tags: dict[str, int] = {}
    pos = 0

    def close(node: Node) -> None:
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.parent
        open_tags[at.tag] -= 1
        at = at.parent

    def nearest(wanted: set[str], stop: set[str]) -> Node | None:
        if not any(open_tags.get(t) for t in wanted):
            return None
        node = at
        while node is not root and node.tag not in stop:
            if node.tag in wanted:
                return node
            node = node.parent
        return None

    while match := _TOKEN.search(page, pos):
        if match.start() > pos:
            at.items.append(page[pos : match.start()])
        pos = match.end()
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            if match[0].startswith("<![CDATA["):
                at.items.append(html.escape(match[0][9:].removesuffix("]]>")))
            continue
        if match["end"] or match["end2"]:
            if open_tags.get(tag) and (node := nearest({tag}, set())):
                close(node)
            elif tag == "p":
                at.items.append(Node("p", "", at))
            continue
        attrs = match["attrs"] if match["tag"] else match["attrs2"]
        if tag in ("html", "body"):
            if tag == "body" and not any(n.tag == "body" for n in root.children()):
                if node := nearest({"head"}, set()):
                    close(node)
            if tag == "html" or open_tags.get("body"):
                continue
        if tag in _ENDS_P and (node := nearest({"p"}, {"td", "th", "table", "button", "object"})):
            close(node)
        if tag in _IMPLIED:
            while node := nearest(*_IMPLIED[tag]):
                close(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        node = Node(tag, attrs, at)
        at.items.append(node)
        if tag not in _VOID and not attrs.rstrip().endswith("/"):
            open_tags[tag] = open_tags.get(tag, 0) + 1
            at = node
    if pos < len(page):
        at.items.append(page[pos:])
    return root


def _mark(node: Node) -> None:
    """What tag, role, style, class and id say of an element: ``kind`` and the aside words of its names."""
    attrs = {}
    if node.attrs.strip():
        for name, *values in _ATTR.findall(node.attrs):
            attrs.setdefault(name.lower(), "".join(values).lower())
    node.names = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = _NAME.findall(name)
        if words and words[0] not in _STATE_FIRST and words[-1] not in _STATE_LAST:
            node.names.update(_ASIDE_NAMES.intersection(words))
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        node.kind = "hidden"
    elif node.tag in _BODIES or node.tag == "body":
        node.kind = "body"
        node.names = node.names & _COMMENT_NAMES if node.tag == "article" else set()
    elif node.tag in _HEADINGS:
        node.kind, node.names = "", set()
    elif node.tag in _FRAME_TAGS or attrs.get("role") in _FRAME_ROLES:
        node.kind = "frame"
    elif node.tag in _ASIDE_TAGS or attrs.get("role") in _ASIDE_ROLES:
        node.kind = "aside"
    else:
        node.kind = ""
        if node.tag in ("p", "b", "i", "em", "strong"):
            node.names = set()


def _weigh(order: list[Node]) -> None:
    """Characters of every element, those of them outside links and asides (``free``), and what it holds.

    ``holds`` is a set of "main", "h1", "title", a h1 that isn't a link, and "heading";
    ``article`` has the free characters of the largest article, comments left out.
    """
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        below = [x for x in node.children() if x.kind != "hidden"]
        node.chars = own + sum(x.chars for x in below)
        node.free = 0 if node.tag == "a" else own + sum(x.free for x in below if x.kind != "aside" or x.holds - {"heading"} or x.article)
        node.holds = set().union(*(x.holds for x in below))
        node.article = max([0, *(x.article for x in below), *(x.free for x in below if x.tag == "article" and not x.names)])
        for x in below:
            if x.tag in _HEADINGS and x.chars:
                node.holds.add("heading")
            if x.tag in ("main", "h1") and x.chars:
                node.holds.add(x.tag)
                if x.tag == "h1" and x.free:
                    node.holds.add("title")


def prune(root: Node) -> None:
    """Drop asides, in place.

    A tag, role or name says that an element is an aside, however much text it
    has; only the structure of the page can say otherwise. An element stays that
    holds a main, a h1 or an article of half the largest one's text, but for a h1
    that a menu, sidebar or footer inside an article or main has, or that links
    from a page's header. And names are void where nothing else has text: each
    article, main and the page around them is taken by itself, and while it has
    no paragraph, h1 or article outside what would go, the name whose elements hold
    most text outside links is ignored, those of comments last. The same goes for the
    tag of each form and page header, never for those of menus, footers and sidebars.
    Inside an article or main, 'header' and the like say nothing of an element with
    a heading, and 'widget' only of one that is mostly links.
    """
    order = list(root.walk())
    for node in order:
        _mark(node)
    _weigh(order)
    scopes = [root]
    while scopes:
        scope, void = scopes.pop(), set()
        while True:
            gone, words, inner, told = _sorted_out(scope, root, void)
            if told or not words:
                break
            void.add(max(sorted(words), key=lambda w: (w not in _COMMENT_NAMES, words[w])))
        for parent, asides in gone:
            parent.items = [x for x in parent.items if isinstance(x, str) or id(x) not in asides]
        scopes += inner


def _sorted_out(scope: Node, root: Node, void: set[str]):
    """What would go from ``scope`` if the names in ``void`` say nothing.

    Asides by parent; free characters of those that only names tell, by name; the
    articles and mains inside; and whether a paragraph, h1 or article stays.
    """
    gone: list[tuple[Node, set[int]]] = []
    words: dict[str, int] = {}
    inner: list[Node] = []
    told = False
    stack = [scope]
    while stack:
        node, asides = stack.pop(), set()
        for x in node.children():
            names = _aside_words(x, scope is root, root, void)
            if names is not None:
                asides.add(id(x))
                for w in names:
                    words[w] = words.get(w, 0) + x.free
            elif x.tag in _BODIES and not x.names:
                inner.append(x)
                told = told or x.free > 0
            else:
                told = told or x.free > 0 and (x.tag in ("p", "h1") or x.tag in _BLOCK and _own_chars(x) >= _PARAGRAPH)
                stack.append(x)
        if asides:
            gone.append((node, asides))
    return gone, words, inner, told or _own_chars(scope) >= _PARAGRAPH


def _own_chars(node: Node) -> int:
    return sum(len("".join(x.split())) for x in node.items if isinstance(x, str))


def _aside_words(node: Node, at_root: bool, root: Node, void: set[str]) -> set[str] | None:
    """None for what stays; else the names without which the element would stay (none if its tag or role alone tells)."""
    if node.kind == "hidden":
        return set()
    names = set(node.names)
    if not at_root:
        if node.tag == "header" or "heading" in node.holds:
            names -= _TITLE_NAMES
        if 2 * node.free > node.chars:
            names -= _BOX_NAMES
    if node.kind == "frame" and (at_root or node.tag != "header"):
        names.add(f"<{node.tag} {id(node)}>")
    names -= void
    firm = node.kind == "aside"
    if not (firm or names) or "main" in node.holds or node.article and 2 * node.article >= root.article:
        return None
    if firm and not at_root:
        return set()
    if ("title" if node.tag == "header" and at_root else "h1") in node.holds:
        return None
    return set() if firm else names


def measure(body: Node) -> None:
    """Composite density of every node, and the sum of its children's.

    Characters per tag, scaled by a logarithm that falls with the share of
    characters and tags that belong to links: with C, T, L and K characters,
    tags, link characters and link tags of a node, and l/c the link share of
    the body, density = C/T * log(C/L * T/K) to the base ln(C*L/(C-L) + C*l/c + e).
    Zero denominators count as one.
    """
    order = list(body.walk())
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        below = node.children()
        node.chars = own + sum(x.chars for x in below)
        node.tags = len(below) + sum(x.tags for x in below)
        is_link = node.tag == "a"
        node.link_chars = node.chars if is_link else sum(x.link_chars for x in below)
        node.link_tags = sum(x.link_tags for x in below) + is_link
    share = body.link_chars / max(1, body.chars)
    for node in order:
        if node.chars:
            c, t, link, k = node.chars, max(1, node.tags), node.link_chars, node.link_tags
            base = math.log(c * link / max(1, c - link) + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, link) * t / max(1, k))) / math.log(max(base, math.e**0.5) + 1e-9)
    for node in reversed(order):
        below = node.children()
        node.total = sum(x.density for x in below)
        node.best = max([node, *(x.best for x in below)], key=lambda x: x.total)


def select(body: Node) -> list[Node]:
    """The nodes that hold the main text, in page order.

    The node with the largest density sum is the heart of the text; the least
    density on its path up to the body is the threshold. Every node that reaches
    it gives the largest-sum node of its subtree. Where one of these lies in an
    article or main element the whole element is taken, so that short blocks
    such as headings stay; elsewhere a heading right before a taken block stays.
    """
    heart = body.best if body.best.total > 0 else body
    threshold, node = heart.density, heart
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    taken: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        if node.main or node.density < threshold:
            continue
        chosen = node.best if node.best.total > 0 else node
        outer, up = chosen, chosen
        while up is not body and up.parent is not None:
            up = up.parent
            if up.tag in _BODIES:
                outer = up
        if not outer.main:
            for x in outer.walk():
                x.main = True
            taken.append(outer)
        stack.extend(reversed(node.children()))
    for node in taken:
        siblings = node.parent.children() if node.parent and node is not body else []
        for left, right in zip(siblings, siblings[1:]):
            if right.main and left.tag in _HEADINGS:
                left.main = True
    return [n for n in body.walk() if n.main and not (n is not body and n.parent and n.parent.main)]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space made one space, trimmed."""
    out, line = [], []

    def end_block():
        if text := " ".join(html.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif item.tag in _BLOCK:
            end_block()
            stack.append(None)
            stack.extend(reversed(item.items))
        else:
            stack.extend(reversed(item.items))
    end_block()
    return out


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by an empty line; '' where there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    body = next((x for x in root.children() if x.tag == "body"), root)
    measure(body)
    if not body.chars:
        return ""
    return "\n\n".join(blocks(select(body)))


def extract(pages: DataFrame, html_col: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``columns`` and the main ``text`` of every page.

    NULL and empty pages give ''. Pages are read whole and don't meet, so rows
    may repeat and any column may be NULL.
    """
    keep = pages.select(F.struct(*columns).alias("row"), F.col(html_col).alias("html"))

    def extracted(batches):
        for batch in batches:
            texts = batch.column("html").to_pylist()
            for a, b in slices(texts):
                made = pa.array([main_text(t) for t in texts[a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row")[a:b], made], names=["row", "text"])

    kind = keep.schema["row"].dataType.simpleString()
    return keep.mapInArrow(extracted, f"row {kind}, text string").select("row.*", "text")
