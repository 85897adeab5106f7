"""Main-text extraction by composite text density.

A page becomes a tree of its elements. Every node has its characters, its link
characters, its tags and its link tags; their link-adjusted ratio is the node's
density. The subtree with the largest sum of child densities is the text,
widened along its path to the body by all blocks that reach the smallest density
on that path; sparse blocks of links are left out of it. Inline elements count
and have densities, but their text goes with the block around them.

Reading a page takes time in proportion to its length, however deep or broken
its tags are.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hgroup center nav header footer aside form fieldset "
    "menu dialog search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never main text; what a page calls such blocks is evidence only, see ``_drop_named``.
NOT_TEXT = RAW | frozenset("head nav footer aside form button select option input menu dialog search canvas audio video".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Class and id names that pages give to what is not main text; strong ones tell inside an article too.
STRONG_NAME = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|newsletter|subscri(?:be|ption)|sign-?up|login|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side-bar|comments?|comment-?list|"
    r"replies|disqus|skip-?link)",
    re.I,
)
WEAK_NAME = re.compile(
    r"(?:widgets?|related|recommend(?:ed|ations)?|trending|popular|share|sharing|social|footer|masthead|site-?header|page-?header|top-?bar|"
    r"respond|pager|pagination|toc|copyright|legal|disclaimer|toolbar)",
    re.I,
)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute's name and, after an equals sign, where its value starts.
ATTRIBUTE_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
BARE_VALUE = re.compile(r"[^\s>]*")
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("td th tr thead tbody tfoot caption html body".split()) | frozenset(["hr"])
#: A start tag of the key ends an open element of the values, up to their container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Node:
    """An element: ``items`` holds strings and elements in page order."""

    __slots__ = ("tag", "parent", "items", "skip", "inline", "chars", "link_chars", "tags", "links", "density", "total", "holds", "within", "named")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip, self.inline = tag, parent, skip, tag not in BLOCKS
        self.items: list[str | Node] = []
        self.chars = self.link_chars = self.tags = self.links = 0
        self.density = self.total = 0.0
        self.holds = self.within = False
        self.named = ""


def _unwanted(tag: str, found: dict[str, str], in_article: bool) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return True
    if not found:
        return False
    if found.get("role", "").lower() in NOT_TEXT_ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    return "hidden" in found or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower()


def _named(tag: str, found: dict[str, str]) -> str:
    """What a block's names say, by whole tokens: ``strong`` or ``weak`` for a class, ``id``, or nothing."""
    if not found or tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return ""
    for name, pattern, says in (("class", STRONG_NAME, "strong"), ("class", WEAK_NAME, "weak"), ("id", STRONG_NAME, "id"), ("id", WEAK_NAME, "id")):
        if any(map(pattern.fullmatch, found.get(name, "").split())):
            return says
    return ""


class Tags:
    """The tags of a page in order, read as browsers read them."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes of a start tag from ``at`` on, and where the tag ends; -1 if the page breaks off in it."""
        page, found = self.page, {}
        while True:
            m = ATTRIBUTE_NAME.match(page, at)
            if m is None:
                end = page.find(">", at)
                return found, end + 1 if end >= 0 else -1
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in self.last and quote and self.last[quote] > at:
                    stop = page.find(quote, at + 1)
                    value, at = page[at + 1 : stop], stop + 1
                else:  # a value without quotes, or one whose quote never ends
                    value = BARE_VALUE.match(page, at)[0]
                    at += len(value)
            found.setdefault(m[1].lower(), references.unescape(value) if "&" in value else value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """(kind, value, attributes): ``text`` pieces, ``start`` and ``end`` tags; comments and the like are passed over."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                yield "text", page[at:], {}
                return
            follows = page[lt + 1 : lt + 2]
            if follows == "/" and TAG_NAME.match(page, lt + 2):
                kind, name = "end", TAG_NAME.match(page, lt + 2)
            elif follows and follows.isascii() and follows.isalpha():
                kind, name = "start", TAG_NAME.match(page, lt + 1)
            elif follows in ("!", "?", "/") and follows:
                yield "text", page[at:lt], {}
                if page.startswith("<!--", lt):
                    end = -1 if page.startswith(("<!-->", "<!--->"), lt) else page.find("-->", lt + 4)
                    at = page.find(">", lt) + 1 if page.startswith(("<!-->", "<!--->"), lt) else end + 3 if end >= 0 else n
                elif page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt)
                    at = end + 3 if end >= 0 else n
                else:
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else n
                continue
            else:  # no tag: the sign itself
                yield "text", page[at : lt + 1], {}
                at = lt + 1
                continue
            if lt > at:
                yield "text", page[at:lt], {}
            found, at = self.attributes(name.end())
            if at < 0:
                return
            tag = name[0].lower()
            yield kind, tag, found
            if kind == "start" and tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    return
                end = page.find(">", end.end())
                at = end + 1 if end >= 0 else n


def parse(page: str) -> Node:
    """The tree of elements, with links counted where they stand.

    Unclosed and misnested tags end where a browser would end them: a
    paragraph at the next block, a list item at the next, all at their parent.
    """
    root = Node("html", None, False)
    node, stack, blocks = root, [root], [0]  # open elements, and which of them are blocks
    places: dict[str, list[int]] = {}
    anchors = 0

    def text(piece: str) -> None:
        if piece and not node.skip:
            piece = references.unescape(piece) if "&" in piece else piece
            node.items.append(piece)
            chars = len(piece) - piece.count(" ")
            node.chars += chars
            node.link_chars += chars if anchors else 0

    def close(depth: int) -> None:
        nonlocal node, anchors
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            anchors -= tag == "a"
        while blocks[-1] >= depth:
            blocks.pop()
        node = stack[-1]

    def last(names: set[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    for kind, tag, found in Tags(page):
        if kind == "text":
            text(tag)
            continue
        if kind == "end":
            if places.get(tag) and (tag in BLOCKS or places[tag][-1] > blocks[-1]):
                close(places[tag][-1])  # an inline end tag does not close a block
            continue
        if tag in RAW:
            continue
        if tag in ENDS_P and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in VOID:
            if tag in ("br", "hr") and not node.skip:
                node.items.append(" ")
            continue
        if tag in SIBLINGS:
            ended, container = SIBLINGS[tag]
            if (depth := last(ended)) > last(container):
                close(depth)
        if tag in ("html", "body"):
            continue
        if stack[-1].tag == "head" and tag != "head":
            close(len(stack) - 1)
        unwanted = node.skip or _unwanted(tag, found, bool(places.get("article") or places.get("main")))
        child = Node(tag, node, unwanted)
        child.named = "" if unwanted or child.inline else _named(tag, found)
        node.items.append(child)
        node = child
        if tag == "a":
            anchors += 1
            node.links += not node.skip
        places.setdefault(tag, []).append(len(stack))
        if not child.inline:
            blocks.append(len(stack))
        stack.append(node)
    return root


def _density(chars: int, link_chars: int, tags: int, links: int, share: float) -> float:
    """Characters to a tag, less for links; ``share`` is the page's share of link characters."""
    lc, t, lt = max(link_chars, 1), max(tags, 1), max(links, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / t * max(math.log(max(chars / lc * t / lt, 1.0)) / math.log(base + 1), 0.0)


def _drop_named(order: list[Node]) -> list[Node]:
    """The nodes that stay when blocks with names of what is not main text are dropped, on evidence.

    A named block goes if half its text or more is links. By its class it also
    goes if it stands outside an article or main with text, or, for a strong
    name, if it holds at most half of the page's text. No block around such an
    article goes.
    """
    total = order[0].chars
    holds_article: set[int] = set()
    for x in order:
        if x.tag in ("article", "main") and x.chars:
            up: Node | None = x
            while up is not None and id(up) not in holds_article:
                holds_article.add(id(up))
                up = up.parent
    left, inside = [], set()
    for x in order:
        if x.parent is not None and x.parent.skip:
            x.skip = True
            continue
        if x.tag in ("article", "main") or id(x.parent) in inside:
            inside.add(id(x))
        if x.named and x.chars and id(x) not in holds_article:
            aside = bool(holds_article) and id(x) not in inside
            if 2 * x.link_chars >= x.chars or (x.named in ("strong", "weak") and aside) or (x.named == "strong" and 2 * x.chars <= total):
                x.skip = True
                up = x.parent
                while up is not None:
                    up.chars -= x.chars
                    up.link_chars -= x.link_chars
                    up.tags -= x.tags + 1
                    up.links -= x.links
                    up = up.parent
                continue
        left.append(x)
    return left


def measure(root: Node) -> list[Node]:
    """Fill in densities bottom up; all nodes that may be text, in page order."""
    order: list[Node] = []
    pending = [root]
    while pending:
        node = pending.pop()
        order.append(node)
        pending += [x for x in reversed(node.items) if isinstance(x, Node) and not x.skip]
    for node in reversed(order):
        for child in node.items:
            if isinstance(child, Node) and not child.skip:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + 1
                node.links += child.links
    order = _drop_named(order)
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            node.density = _density(node.chars, node.link_chars, node.tags, node.links, share)
    for node in order:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.skip)
        if any(isinstance(x, str) and not x.isspace() for x in node.items):
            node.total += node.density if not node.tags else 0.0
    return order


def blocks_of(node: Node) -> list[str]:
    """The text blocks under a node in page order, white space folded."""
    out: list[str] = []
    run: list[str] = []
    pending: list[str | Node | None] = [node]

    def flush() -> None:
        if run:
            if block := " ".join("".join(run).split()):
                out.append(block)
            run.clear()

    while pending:
        x = pending.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if x is None or not x.inline:
            flush()
        if x is not None and not x.skip:
            pending += reversed(x.items) if x.inline else [None, *reversed(x.items)]
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page, blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = measure(root)
    best = max(order, key=lambda x: x.total)  # the first of equals, so the outer one
    while best.inline:
        best = best.parent
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    # an article or main on the path ends the part of it that sets the threshold: what lies outside must be as dense as what is in it
    inside = max((k for k, x in enumerate(path) if x.tag in ("article", "main")), default=len(path) - 1)
    threshold = min(x.density for x in path[: inside + 1])
    on_path = set(map(id, path))
    for x in reversed(order):
        dense = not x.inline and x.chars > 0 and x.density >= threshold
        x.holds = dense or id(x) in on_path or any(isinstance(y, Node) and not y.skip and y.holds for y in x.items)
    top = best
    for outer in path[1:]:
        inner = [x for x in outer.items if isinstance(x, Node) and not x.skip]
        rest = [x for x in inner if id(x) not in on_path and x.chars]
        paragraphs = outer.tag in ("article", "main") and any(x.tag == "p" for x in rest)
        if paragraphs or any(x.holds or x.tag in HEADINGS for x in rest) or _own_density(outer, inner, root) >= threshold:
            top = outer
    # what is short but no list of links stays with the text around it; the tag decides only there
    for x in order:
        around = x.parent is not None and x.parent.within
        if not x.inline and x.chars and not (x.holds or x.tag in HEADINGS or (around and (x.tag == "p" or 2 * x.link_chars <= x.chars))):
            x.skip = True
        x.within = x is best or x.tag in ("article", "main") or around
    return "\n".join(blocks_of(top))


def _own_density(node: Node, inner: list[Node], root: Node) -> float:
    """The density of the text that stands in a node and in none of its blocks; below all others if there is none."""
    blocks = [x for x in inner if not x.inline]
    chars, link_chars, links = (getattr(node, k) - sum(getattr(x, k) for x in blocks) for k in ("chars", "link_chars", "links"))
    if chars <= 0 or not any(not x.isspace() if isinstance(x, str) else x.inline and not x.skip and x.chars for x in node.items):
        return -1.0
    tags = 1 + sum(x.tags + 1 for x in inner if x.inline)
    return _density(chars, link_chars, tags, links, root.link_chars / max(root.chars, 1))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for each row of ``pages``.

    Null html is an empty page with empty text. Repeated rows, null ids and
    null urls are kept as they are; other columns are ignored; an empty table
    gives no rows. Pages of any length are read whole.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
