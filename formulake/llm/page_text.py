"""Main text of web pages by tree scoring.

A page is parsed into a tree of blocks; elements that are never article text (scripts, menus,
headers, footers, sidebars, and elements whose role says so) are left out with all they hold. So
are forms and elements whose class or id names a notice, an advert, comments and the like, unless
they hold most of the page's text (``keep_frames``); if next to nothing is left, they are kept. Every paragraph passes points
to its ancestors: one, one for each comma, and one for each hundred characters up to three;
the parent gets all of them, the grandparent half, the next ones a share that falls with their
distance. Other blocks that hold text directly are paragraphs too and their own parent. An
element's points are discounted by its link density, the share of its text that is inside links.
The element with the most points is the main container. Siblings join it if their
own points reach a fifth of its points, or if they are paragraphs of some length with few links;
headings of the page's level one belong to it too, and what stands between such siblings: headings, and
blocks of any length with few links. So do headings right before the first of them, and behind the last
one a heading like those before with the blocks under it.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one space. Nothing is capped. A null page counts as empty;
a page without paragraphs is scored by its bare text blocks; a page without text gives "".
Repeated rows give repeated rows, extra columns are left out, empty tables give empty results.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import known_text, small_batches

# Fixed values of HTML: elements without content, with raw text, and that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of the key ends an open element of the values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"},
}
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SCOPES = frozenset("article aside body div dl footer form header main nav ol section table td th ul".split())
NEVER = frozenset(
    "script style noscript iframe template svg math object head nav footer aside button select "
    "textarea input menu dialog".split()
)
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|advertising|banners?|breadcrumbs?|consent|cookies?|"
    r"footer|header|masthead|menus?|menubar|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|"
    r"promos?|promotions?|promoted|related|share|shares|sharing|sharebar|sidebars?|social|socials|"
    r"sponsors?|sponsored|subscribe|subscription|toolbar|widgets?)(?:$|[\s_-])", re.I,
)
#: What readers write may be most of a page's text and still isn't the article.
TALK = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|commenters?|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Says what stands beside the element, not what it is.
BESIDE = re.compile(r"\b(?:has|with|without|no|hide|show)[-_]\w+", re.I)
HEAD_TAGS = frozenset("head title meta link style script base noscript template".split())
UNLIKELY_ROLE = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"\s+")
PARAGRAPHS = frozenset("p pre td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDER_CHARS = 25  # characters that stand directly in another block to make it a paragraph
LEVELS = 6  # ancestors that a paragraph passes points to
WRAPS, LITTLE = 0.5, 0.1  # of a page's text outside links: a doubtful element is its frame; too little is left
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25


class Node:
    """An element: its children are nodes and, as text, what stands between them."""

    __slots__ = ("tag", "parent", "parts", "points", "chars", "linked", "kept", "doubt")

    def __init__(self, tag: str, parent: Node | None, kept: bool = True, doubt: str = ""):
        self.tag, self.parent, self.kept, self.doubt = tag, parent, kept and not doubt, doubt if kept else ""
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0


def never(tag: str, attrs: str) -> bool:
    """Whether an element is no article text whatever it holds."""
    if tag in NEVER:
        return True
    if not attrs or tag in ("body", "html", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'")).strip().lower()
        if name == "role" and value in UNLIKELY_ROLE or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs, re.I))


def doubt(tag: str, attrs: str) -> str:
    """Why an element is left out unless it frames the page: "talk", "name", "form" or nothing."""
    found = "form" if tag == "form" else ""
    if tag in ("body", "html", "main"):
        return found
    for name, value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            value = BESIDE.sub(" ", html.unescape(value.strip("\"'")))
            if TALK.search(value):
                return "talk"
            if UNLIKELY.search(value):
                found = "name"
    return found


def close(node: Node, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> Node:
    """The node that is open after the nearest open element of these tags has ended, if any is."""
    at: Node | None = node
    while at is not None and at.parent is not None:
        if at.tag in tags:
            return at.parent
        if at.tag in scopes:
            return node
        at = at.parent
    return node


def parse(page: str) -> Node:
    """The tree of a page; ends that are missing are put where a browser would put them."""
    root = node = Node("html", None)
    at, in_head = 0, False
    while at < len(page):
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            node.parts.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if found["cdata"] is not None:
            node.parts.append(found["cdata"])
        if found["tag"] is None:
            continue
        tag, attrs = found["tag"].lower(), found["attrs"] or ""
        if found["end"]:
            if tag == "br":
                node.parts.append(Node("br", node))
            else:
                node = close(node, {tag}, frozenset() if tag in SCOPES else SCOPES - {tag})
            continue
        if tag in ("html", "body"):
            node, in_head = close(node, {"head"}, frozenset()) if in_head else node, False
            continue  # the root stands for both
        if in_head and tag not in HEAD_TAGS:
            node, in_head = close(node, {"head"}, frozenset()), False
        in_head = in_head or tag == "head"
        if tag in ENDS_PARAGRAPH:
            node = close(node, {"p"}, SCOPES)
        if tag in ENDS:
            node = close(node, ENDS[tag], SCOPES - ENDS[tag])
        child = Node(tag, node, not never(tag, attrs), doubt(tag, attrs) if attrs or tag == "form" else "")
        node.parts.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            child.kept, child.doubt = False, ""
        elif tag not in VOID:
            node = child
    return root


def walk(root: Node):
    """Kept nodes in page order, each with whether it is inside a link."""
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        yield node, linked
        stack += [(c, linked) for c in reversed(node.parts) if isinstance(c, Node) and c.kept]


def measure(root: Node) -> None:
    """Characters and linked characters of every kept node, with all it holds."""
    order = list(walk(root))
    for node, linked in order:
        own = sum(len(SPACE.sub(" ", t).strip()) for t in node.parts if isinstance(t, str))
        node.chars, node.linked = own, own if linked else 0
    for node, _ in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def own_text(node: Node) -> str:
    """The text of a paragraph with its inline elements."""
    return SPACE.sub(" ", " ".join(blocks(node))).strip()


def pass_points(root: Node) -> list[Node]:
    """Points of all ancestors of paragraphs; returns the nodes that have some."""
    nodes = [n for n, _ in walk(root)]
    direct = {id(n): sum(len(t.strip()) for t in n.parts if isinstance(t, str)) for n in nodes}
    holders = BLOCKS - PARAGRAPHS - HEADINGS
    paragraphs = [
        n for n in nodes
        if n.tag in PARAGRAPHS and n.chars or n.tag in holders and direct[id(n)] >= HOLDER_CHARS
    ] or [n for n in nodes if direct[id(n)]]
    scored: list[Node] = []
    for paragraph in paragraphs:
        text = own_text(paragraph)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
        above, level = paragraph.parent if paragraph.tag in PARAGRAPHS else paragraph, 0
        while above is not None and level < LEVELS:
            if above.points == 0:
                scored.append(above)
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    return scored


def blocks(top: Node) -> list[str]:
    """Texts of the blocks of an element in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [top]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            flush()
        elif part.kept:
            if part.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(part.parts))
    flush()
    return out


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    measure(root)
    scored = pass_points(root)
    if not scored:
        return []
    value = {id(n): n.points * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])  # the first of equals
    # an only child of an article or main element stands for all of it
    above = best.parent
    while above is not None and best.tag not in ("article", "main"):
        if above.tag in ("article", "main"):
            best = above
            break
        above = above.parent
    if best.parent is None:
        return [best]
    least = SIBLING_SHARE * value.get(id(best), best.points)
    row = [n for n in best.parent.parts if isinstance(n, Node) and n.kept and n.chars]

    def belongs(node: Node) -> bool:
        strong = value.get(id(node), 0.0) >= least and node.points > 0
        plain = node.tag in PARAGRAPHS and node.chars >= SIBLING_CHARS and density(node) < SIBLING_LINKS
        return node is best or strong or plain or node.tag == "h1"

    chosen = [i for i, node in enumerate(row) if belongs(node)]
    first, last = chosen[0], chosen[-1]
    own = set(chosen) | {i for i in range(first, last) if fills(row[i])}
    while first and row[first - 1].tag in HEADINGS:
        first -= 1
        own.add(first)
    levels = {row[i].tag for i in own if row[i].tag in HEADINGS}
    at = last + 1
    while at + 1 < len(row) and row[at].tag in levels and fills(row[at + 1]) and row[at + 1].tag not in HEADINGS:
        own.add(at)
        at += 1
        while at < len(row) and fills(row[at]) and row[at].tag not in HEADINGS:
            own.add(at)
            at += 1
    return [row[i] for i in sorted(own)]


def fills(node: Node) -> bool:
    """Whether an element belongs to an article that goes on behind it."""
    return node.tag in HEADINGS or node.tag in BLOCKS and density(node) < SIBLING_LINKS


def keep_frames(root: Node) -> None:
    """Keeps doubtful elements that hold the article.

    That is one with most of the page's text outside links; readers' talk only if the page's
    main element or first heading is in it. If little text is left then, all doubtful ones are kept.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        stack += [(c, linked) for c in node.parts
                  if isinstance(c, Node) and (c.kept or c.doubt)]
    doubtful = [n for n, _ in order if n.doubt]
    if not doubtful:
        return
    plain: dict[int, int] = {}
    titled: set[int] = set()
    for node, linked in reversed(order):  # every child comes after its parent in order
        own = 0 if linked else sum(len(t.strip()) for t in node.parts if isinstance(t, str))
        plain[id(node)] = plain.get(id(node), 0) + own
        if node.parent is not None:
            plain[id(node.parent)] = plain.get(id(node.parent), 0) + plain[id(node)]
            if node.tag in ("main", "h1") or id(node) in titled:
                titled.add(id(node.parent))
    total = plain[id(root)]
    for node in doubtful:
        if plain[id(node)] > WRAPS * total and (node.doubt != "talk" or id(node) in titled):
            node.kept = True
    left = total
    for node in doubtful:
        above = node.parent
        while above is not None and above.kept:
            above = above.parent
        if not node.kept and above is None:  # the outermost one left out
            left -= plain[id(node)]
    if left < LITTLE * total:
        for node in doubtful:
            node.kept = True


def main_text(page: str | None) -> str:
    root = parse(page or "")
    keep_frames(root)
    return " ".join(t for node in main_nodes(root) for t in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points for every page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(main_text)

    out = pages.select("page_id", "url", text_of(known_text("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
