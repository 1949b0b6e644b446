"""Main text of web pages by tree scoring.

A page is read into a tree of elements once. Paragraphs earn points for their length and
their commas and pass them to their ancestors, the nearer the more; what an ancestor has is
discounted by the share of its text that is links. The best container is kept with those
siblings that belong to it, and all of its blocks are given out in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# fixed values: elements by what they do in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key is ended by a start of any of these.
ENDED_BY = {
    "p": BLOCK - {"td", "th", "tr", "tbody", "body", "html"} | {"td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Elements that hold running text, lists or tables.
WRITTEN = frozenset("p ul ol dl pre blockquote table figure".split())
#: Ends inside these do not reach outside.
FENCES = frozenset("table td th article section main ul ol".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog svg canvas template object embed audio video "
                    "input datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus respond replies reply cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended widget widgets login signin signup register search toolbar pagination pager alert skip disclaimer".split())
#: Marks of other people's prose, which may outweigh the page's own.
OTHERS = frozenset("comment comments commentlist disqus respond replies reply related recommended".split())
#: Words that say nothing of their own beside a mark: inside the article a name is furniture only if it is made of such and marks.
PLAIN = frozenset(
    "area bar block body box btn button buttons card cards container content entry footer form frame group head holder icon icons inline "
    "inner item items js label large layer left line link links list main media mid middle bottom page panel placeholder post right row "
    "section site slot small small tag text title top unit wrap wrapper zone".split())
#: What a page says it has or lacks: "has-sidebar" names no sidebar.
_ABOUT = re.compile(r"(?:^|(?<=[-_\s]))(?:has|with|without|no)(?:[-_]|(?=[A-Z]))\S*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """An element: its children are texts and other elements, in order."""

    __slots__ = ("tag", "attributes", "children", "parent", "points")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.points = 0.0


def parse(page: str) -> Node:
    """The page as a tree; unclosed, misnested and cut-off elements end where a reader would end them."""
    root = Node("html", "", None)
    node, at, lower = root, 0, None
    while True:
        m = _TAG.search(page, at)
        if m is None:
            node.children.append(page[at:])
            return root
        if m.start() > at:
            node.children.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = node
            while up is not root and up.tag != tag and not (up.tag in FENCES and tag not in BLOCK):
                up = up.parent
            if up is not root and up.tag == tag:
                node = up.parent
            continue
        if tag in ("html", "body"):
            continue
        while node.tag in ENDED_BY and tag in ENDED_BY[node.tag]:
            node = node.parent
        if tag in BLOCK:  # an open inline element does not carry a paragraph past its end
            up = node
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag in ENDED_BY and tag in ENDED_BY[up.tag]:
                node = up.parent
        child = Node(tag, m[3] or m[6] or "", node)
        node.children.append(child)
        if tag in VOID or child.attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):  # lower case may change lengths; then look without it
                end = re.compile(f"</{tag}", re.I).search(page, at)
                end = end.start() if end else -1
            else:
                end = lower.find(f"</{tag}", at)
            if end < 0:
                return root
            at = end
        node = child


def _dropped(node: Node, inside: bool, core: Callable[[float], bool]) -> bool:
    """Whether an element is furniture: by its name, role, visibility, or a word of its class or id.

    Names say nothing against an element that ``core`` finds to hold the page's text (more than a given share of it).
    """
    if node.tag == "form" and core(0.5):
        pass
    elif node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("article", "main"):
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(node.attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in ROLES and not core(0.5):
        return True
    names = _ABOUT.sub(" ", found.get("class", "") + " " + found.get("id", ""))
    words = {w.lower() for w in _WORDS.findall(names)}
    if inside:
        marked = False
        for name in names.split():
            of_name = {w.lower() for w in _WORDS.findall(name)} - ({"header"} if node.tag in ("header", "hgroup") else set())
            marked |= bool(of_name & MARKS) and all(w in MARKS or w in PLAIN or len(w) == 1 or w.isdigit() for w in of_name)
        return marked and not core(0.9 if words & OTHERS else 0.5)
    return bool(words & MARKS) and not core(0.9 if words & OTHERS else 0.5)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _prose(root: Node) -> tuple[dict[int, int], set[int]]:
    """Characters outside links below each element (names that are always furniture have none), and what holds the largest article."""
    order, open_ = [], [root]
    while open_:
        node = open_.pop()
        order.append(node)
        open_ += [c for c in node.children if not isinstance(c, str)]
    prose: dict[int, int] = {}
    largest, most = None, 0
    for node in reversed(order):
        own = 0 if node.tag == "a" or node.tag in DROPPED and node.tag != "form" else sum(
            len(c.strip()) if isinstance(c, str) else prose[id(c)] for c in node.children)
        prose[id(node)] = own
        if node.tag in ("article", "main") and own >= most:
            largest, most = node, own
    around = set()
    while largest is not None:
        around.add(id(largest))
        largest = largest.parent
    return prose, around


def _prune(root: Node) -> None:
    """Take furniture out of the tree."""
    prose, around = _prose(root)

    def core(node: Node, inside: bool, share: float) -> bool:
        # beside an article, size alone makes no text of the page
        return id(node) in around or (inside or not around) and prose[id(node)] > share * prose[id(root)]

    open_ = [(root, False)]
    while open_:
        node, inside = open_.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children
                         if isinstance(c, str) or not _dropped(c, inside, partial(core, c, inside))]
        open_ += [(c, inside) for c in node.children if not isinstance(c, str)]


def _sizes(root: Node) -> dict[int, tuple[int, int, int]]:
    """Per element: characters, characters in links, and number of links."""
    order, open_ = [], [root]
    while open_:
        node = open_.pop()
        order.append(node)
        open_ += [c for c in node.children if not isinstance(c, str)]
    sizes: dict[int, tuple[int, int, int]] = {}
    for node in reversed(order):
        chars = linked = links = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            else:
                a, b, n = sizes[id(c)]
                chars, linked, links = chars + a, linked + b, links + n
        if node.tag == "a":
            linked, links = chars, links + 1
        sizes[id(node)] = (chars, linked, links)
    return sizes


def _drop_link_lists(root: Node, sizes: dict[int, tuple[int, int, int]]) -> None:
    """Lists of links are menus, except in an article."""
    open_ = [root]
    while open_:
        node = open_.pop()
        if node.tag in ("article", "main"):
            continue
        kept = []
        for c in node.children:
            if not isinstance(c, str) and c.tag in ("ul", "ol", "dl"):
                chars, linked, links = sizes[id(c)]
                if links >= 3 and linked >= 0.9 * chars:
                    continue
            kept.append(c)
        node.children = kept
        open_ += [c for c in kept if not isinstance(c, str)]


def _runs(root: Node) -> Iterator[tuple[Node, str]]:
    """Blocks in page order: the block element and the text of each run inside it."""
    run: list[str] = []
    holder = root
    open_: list = [("visit", root)]
    while open_:
        what, item = open_.pop()
        if what == "text":
            run.append(item)
        elif what == "end":
            if run:
                yield holder, "".join(run)
                run = []
            holder = item
        else:
            block = item.tag in BLOCK or item is root
            if item.tag == "br":
                run.append(" ")
                continue
            if block:
                if run:
                    yield holder, "".join(run)
                    run = []
                open_.append(("end", holder))
                holder = item
            for c in reversed(item.children):
                open_.append(("text", c) if isinstance(c, str) else ("visit", c))
    if run:
        yield holder, "".join(run)


def _score(root: Node) -> list[Node]:
    """Hand the paragraphs' points to their ancestors; all elements that got some."""
    scored: dict[int, Node] = {}
    for holder, text in _runs(root):
        text = _clean(text)
        if not text or re.fullmatch("h[1-6]", holder.tag):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up, level = holder if holder.tag in ("div", "section", "article", "main") else holder.parent or holder, 0
        while up is not None and level < 4:
            up.points += points / (1, 2, 6, 9)[level]
            scored[id(up)] = up
            up, level = up.parent, level + 1
    return list(scored.values())


def _container(root: Node, sizes: dict[int, tuple[int, int, int]]) -> Node | None:
    best, most = None, 0.0
    for node in _score(root):
        chars, linked, _ = sizes[id(node)]
        node.points *= 1 - linked / chars if chars else 0
        if node.points > most:
            best, most = node, node.points
    return best


def _texts(node: Node) -> list[str]:
    return [t for t in (_clean(text) for _, text in _runs(node)) if t]


def _articles(root: Node, sizes: dict[int, tuple[int, int, int]]) -> list[Node]:
    """The outermost articles in page order; one whose whole text is links only points to another."""
    found, open_ = [], [root]
    while open_:
        node = open_.pop()
        if node.tag in ("article", "main"):
            chars, linked, _ = sizes[id(node)]
            if linked < chars:
                found.append(node)
        else:
            open_ += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def _heading_only(node: Node, sizes: dict[int, tuple[int, int, int]]) -> bool:
    """Whether all text of an element is in headings."""
    headings, open_ = 0, [node]
    while open_:
        at = open_.pop()
        if re.fullmatch("h[1-6]", at.tag):
            headings += sizes[id(at)][0]
        else:
            open_ += [c for c in at.children if not isinstance(c, str)]
    return 0 < headings == sizes[id(node)][0]


def _around_articles(articles: list[Node], sizes: dict[int, tuple[int, int, int]]) -> list[Node]:
    """The articles, each with the heading right before it and long paragraphs beside it."""
    taken = []
    for article in articles:
        around = [c for c in article.parent.children if not isinstance(c, str) and sizes[id(c)][0]] if article.parent else [article]
        own = around.index(article)
        for k, c in enumerate(around):
            chars, linked, _ = sizes[id(c)]
            if c is article or c.tag == "p" and chars > 80 and linked <= 0.25 * chars or k == own - 1 and _heading_only(c, sizes):
                if not any(c is t for t in taken):
                    taken.append(c)
    return taken


def _belongs(node: Node, best: Node, sizes: dict[int, tuple[int, int, int]]) -> bool:
    """Whether a sibling of the best container is text of the same page: written as such, or a like element with such parts."""
    chars, linked, _ = sizes[id(node)]
    if re.fullmatch("h[1-6]", node.tag) or _heading_only(node, sizes):
        return True
    if not chars or linked > (0.25 if node.tag == "p" else 0.5) * chars:
        return False
    if node.tag in WRITTEN or node.tag == best.tag and node.points >= 0.2 * best.points:
        return True
    open_ = [node] if node.tag in ("div", "section", best.tag) else []
    while open_:
        for c in open_.pop().children:
            if not isinstance(c, str):
                if c.tag in WRITTEN and sizes[id(c)][0]:
                    return True
                open_.append(c)
    return False


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none.

    Articles, where a page has them, are kept whole but for furniture inside them; only other pages are scored.
    """
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    sizes = _sizes(root)
    articles = _articles(root, sizes)
    if articles:
        return "\n\n".join(t for node in _around_articles(articles, sizes) for t in _texts(node))
    _drop_link_lists(root, sizes)
    best = _container(root, sizes)
    if best is None:
        return "\n\n".join(_texts(root))
    while best.parent is not None and sizes[id(best)][0] == sizes[id(best.parent)][0]:
        best = best.parent  # it is all there is in there
    if best.parent is None:
        return "\n\n".join(_texts(best))
    around = best.parent.children
    taken = [k for k, c in enumerate(around) if c is best or not isinstance(c, str) and _belongs(c, best, sizes)]
    whole = Node(best.parent.tag, "", None)
    for k in range(taken[0], taken[-1] + 1):
        c = around[k]
        if c is best or isinstance(c, str) or c.tag == "p" or sizes[id(c)][1] <= 0.5 * sizes[id(c)][0]:
            whole.children.append(c)
    return "\n\n".join(_texts(whole))


def _extracted(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in columns:
        yield pages.map(extract, na_action=None)


def main_text(page: Column) -> Column:
    """``extract`` of each page; null and empty pages give the empty text, equal pages equal texts.

    It is a column: repeated rows, empty tables and columns of any name are those of the caller's table.
    """
    return F.pandas_udf(_extracted, "string")(page)
