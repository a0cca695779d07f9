"""HTML extraction by composite text density.

A page becomes a tree. Parts that the main text never holds by its definition leave it first:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments,
as their tag, their role, or a name made of such words alone says. Every node then has
its composite density: characters for each tag, weighed down by the share that links have
of its characters and tags, as in "DOM based content extraction via text density" (2011).
The node with the highest density sets the threshold: the lowest density on its path to
the body. Among the nodes at or over the threshold, the subtree whose children's
densities have the largest sum holds the main text, whatever its tag; children that only
mark words within a block are part of its text and not added. A sum of many paragraphs beats
one of a few sections, so that the subtree found may be one section of the text: it grows to
its parent while what stands beside it there is text as well (a block of it is BESIDE as dense as the subtree's
usual block, and it isn't mostly links), or headings alone, and in any case to the article or main element that it stands
in. What is mostly links beside it is left out.

A heading is never left out for its name; the name of a section's anchor (its id) counts only if it isn't
the section's own heading and speaks of readers' comments, adverts or the like, not of a "discussion".

Defined cases: a null page counts as empty and gives an empty text; broken markup is read
as far as it goes, with the elements that HTML closes by itself closed; repeated rows are
read one by one; character references are decoded; white space within a block becomes one
blank; blocks stand in page order, a line each. Nothing is shortened.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import only

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left ends open elements on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: But not beyond these.
HOLDS = frozenset("ul ol dl table select td th article section div body html aside nav main header footer form blockquote".split())
NEVER = frozenset(
    "script style noscript template svg canvas math head title iframe object embed audio video map form button select textarea input label fieldset "
    "nav aside footer menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments "
    "disqus replies respond discussion social sharing related recommended newsletter subscribe subscription signup login search widget "
    "widgets toolbar pagination pager paywall disclaimer copyright".split()
)
#: Words that say nothing of their own in a name; "ad-slot" is an advert and "cookie-bar" a notice, but "notice-period" is no notice.
PLAIN = frozenset(
    "site page main global top bottom left right center inner outer upper lower box bar block list item items wrap wrapper container area section panel "
    "slot unit zone link links left right primary secondary sticky fixed user reader posts articles form thread x".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Titles, which no name takes out.
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names that articles have for sections of their own as well; as an id alone they take nothing out.
ALSO_SECTIONS = frozenset("discussion related search notice notices alert copyright disclaimer advertising social recommended promotion banner menu header".split())
#: Part of the usual density of its blocks that text beside the main node has to reach, and the share of links over which it is no text.
BESIDE, LINKS = 0.2, 0.5
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "off", "held", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, off: bool) -> None:
        self.tag, self.parent, self.off = tag, parent, off
        self.held = tag in ("article", "main") or parent is not None and parent.held  # stands in an article
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _named_off(names: str, but: frozenset[str] = frozenset()) -> bool:
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.findall(name)]
        if len(parts) == 1 and parts[0] in but:
            continue
        if any(x in NAMES for x in parts) and all(x in NAMES or x in PLAIN or x.isdigit() for x in parts):
            return True
    return False


def _is_off(tag: str, attrs: list[tuple[str, str | None]], inside: Node) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main"):
        return False
    own = {k: v or "" for k, v in attrs}
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    if tag in TITLES:
        return False
    if tag == "header":
        return not inside.held  # within the article it holds the heading
    return bool(attrs) and (_named_off(own.get("class", "")) or _named_off(own.get("id", ""), ALSO_SECTIONS if inside.held or tag == "section" else frozenset()))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#", None, False)
        self.open: Counter[str] = Counter()  # elements that have not ended, by tag

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def _leave(self, until: Node) -> None:
        while self.now is not until.parent:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            closes = CLOSES.get(tag, ())
            up = self.now
            while up.parent and up.tag not in ("p", *closes) and up.tag not in HOLDS:
                up = up.parent
            while up.tag in closes or up.tag == "p":
                self._leave(up)
                up = self.now
                if up.tag not in closes:
                    break
        node = Node(tag, self.now, self.now.off or _is_off(tag, attrs, self.now))
        self.now.items.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        up = self.now
        while up.parent and up.tag != tag:
            if up.tag in HOLDS and tag not in HOLDS:
                return  # ends nothing outside the element that it stands in
            up = up.parent
        if up.parent:
            self._leave(up)

    def handle_data(self, data: str) -> None:
        if not self.now.off:
            self.now.items.append(data)


def _in_order(root: Node) -> list[Node]:
    """The nodes that stay, parents before children."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and not x.off]
    return found


def _densities(root: Node) -> list[Node]:
    nodes = _in_order(root)
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, str):
                node.chars += sum(map(len, x.split()))
            elif not x.off:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    share = root.link_chars / max(1, root.chars)
    for n in nodes:
        if n.chars:
            links, tags = max(1, n.link_chars), max(1, n.tags)
            by = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / tags * math.log(max(1.0, n.chars / links * tags / max(1, n.link_tags)) + 1e-9) / by
    return nodes


def _children(node: Node) -> float:
    return sum(x.density for x in node.items if isinstance(x, Node) and not x.off and x.tag in BLOCK)


def main_node(root: Node) -> Node | None:
    """The subtree that holds the main text."""
    nodes = [n for n in _densities(root) if n.chars]
    if not nodes:
        return None
    dense = max(nodes, key=lambda n: n.density)
    threshold, up = dense.density, dense
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent if up.tag != "body" else None
    best = max((n for n in nodes if n.density >= threshold), key=_children)
    if not _children(best):
        best = dense
    while best.parent and best.tag not in BLOCK:
        best = best.parent
    return _grown(best, threshold)


def _grown(node: Node, threshold: float) -> Node:
    """The node, or what it is a part of: where text stands beside it, and up to the article that it stands in."""
    own = sorted(x.density for x in node.items if isinstance(x, Node) and not x.off and x.tag in BLOCK and not _is_title(x)) or [node.density]
    least = BESIDE * own[len(own) // 2]
    while node.parent and node.tag not in ("article", "main", "body", "html"):
        beside = [x for x in node.parent.items if x is not node and (x.strip() if isinstance(x, str) else x.chars and not x.off)]
        if not (node.parent.held or all(_is_title(x) for x in beside) or any(_is_text(x, least) for x in beside)):
            break
        for x in beside:
            if isinstance(x, Node) and not _is_title(x) and x.link_chars > LINKS * x.chars and x.density < threshold:
                x.off = True
        node = node.parent
    return node


def _is_title(x: Node | str) -> bool:
    return isinstance(x, Node) and x.tag in HEADINGS


def _is_text(x: Node | str, least: float) -> bool:
    if isinstance(x, str):
        n = sum(map(len, x.split()))
        return n * math.log(n + 1) >= least
    return x.link_chars <= LINKS * x.chars and any(y.density >= least for y in _in_order(x))


def blocks(node: Node) -> list[str]:
    """The texts of the blocks of a subtree in page order."""
    out: list[str] = []
    open_block: list[str] = []

    def end() -> None:
        if text := " ".join("".join(open_block).split()):
            out.append(text)
        open_block.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            open_block.append(x)
        elif x.tag == "br":
            open_block.append(" ")
        elif not x.off:
            inner: list[Node | str | None] = list(reversed(x.items))
            if x.tag in BLOCK:
                end()
                inner.insert(0, None)
            todo += inner
    end()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    node = main_node(tree.root)
    return "\n".join(blocks(node)) if node else ""


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(t) for t in texts], dtype=object)

    return pages.withColumn(into, F.pandas_udf(each, "string")(F.col(f"`{html}`")))


def page_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    found = extract(only(pages, "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
