"""Main text of web pages by minimum-cut labelling (operator 4).

A page becomes its blocks of text. A linear classifier of block features gives every block a cost of being content and one
of being boilerplate, the capacities to the two terminals of a flow network. Neighbours on the page and blocks of the same
container are joined by smoothness edges, so that cutting between like places costs more. The minimum cut, found by
maximum flow, labels all blocks of the page at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.lineage import bounded_batches

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("audio canvas datalist embed head iframe math noscript object script select style svg template textarea title video".split())
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag of these shows what follows in an unseen element, unless that turns out to be closed by its own end tag.
SHOWS = BLOCK - VOID - {"option", "optgroup"}
APART = frozenset("aside button dialog fieldset footer menu nav search".split())
WITHIN = frozenset(["article", "main"])
#: Names of these say nothing about their text.
NAMELESS = WITHIN | frozenset("body h1 h2 h3 h4 h5 h6 html".split())
#: A start tag of these closes an open one of the second set, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
APART_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert author banner bio breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion "
    "disqus dialog feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted "
    "recommended related replies reply responses share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets".split()
)
#: Within an article or main these name its own head.
HEAD_NAMES = frozenset("banner header masthead".split())
#: A name that starts so tells of a layout, not of what its element is.
LAYOUT = frozenset("has hide is no not show with without".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    apart: bool = False
    named: Node | None = None  # the innermost of the element and those around it that a name sets apart
    mute: bool = False
    within: bool = False
    unseen: bool = False
    link: bool = False
    container: int = 0
    shown_from: int | None = None
    wraps: bool = False


@dataclass
class Block:
    tag: str
    container: int
    apart: bool
    within: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    names: Node | None = None
    named: bool = False


class Blocks(HTMLParser):
    """Cuts a page into blocks of text, whatever the state of its markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("", None)
        self.depth_of: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.containers = 0
        self.articles = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.top.tag == "head" and tag not in IN_HEAD:
            self._pop()
        if tag in BLOCK:
            self.current = None
            if self.depth_of.get("p"):
                self._close({"p"}, {"button", "table", "td", "th"})
        elif tag == "br":
            self.handle_data(" ")
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID:
            return
        if self.top.unseen and tag in SHOWS:
            self._show()
        up = self.top
        node = Node(tag, up, up.apart, up.named, up.mute and tag not in BLOCK, up.within, up.unseen or tag in UNSEEN, up.link or tag == "a", up.container)
        if tag in BLOCK and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.containers += 1
            node.container = self.containers
        if tag in WITHIN:
            node.within = True
            if tag == "main" or not self.articles:
                self._wrapped(up)
            self.articles += tag == "article"
        apart = tag in APART or tag == "header" and not up.within or self._set_apart(attrs)
        named = tag == "form" or tag not in NAMELESS and self._names_apart(attrs, up.within)
        if apart:
            node.apart = True
        if named:
            node.named = node
        if (apart or named) and tag not in BLOCK and "-" not in tag:
            node.mute = True
        self.top = node
        self.depth_of[tag] = self.depth_of.get(tag, 0) + 1

    @staticmethod
    def _set_apart(attrs: list[tuple[str, str | None]]) -> bool:
        for key, value in attrs:
            if key == "role":
                if value in APART_ROLES:
                    return True
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and "display:none" in value.replace(" ", ""):
                return True
        return False

    @staticmethod
    def _names_apart(attrs: list[tuple[str, str | None]], within: bool) -> bool:
        for key, value in attrs:
            if key in ("class", "id"):
                for name in (value or "").split():
                    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
                    if parts and parts[0] not in LAYOUT and any(p in APART_NAMES and not (within and p in HEAD_NAMES) for p in parts):
                        return True
        return False

    @staticmethod
    def _wrapped(node: Node) -> None:
        """The elements around main or the first article of a page are no longer apart by their names."""
        while node is not None and not node.wraps:
            node.wraps = True
            node = node.parent

    def _show(self) -> None:
        """Takes the open unseen elements for unclosed ones; the blocks from here on go again if an end tag closes them."""
        node = self.top
        while node is not None and node.unseen:
            node.unseen = False
            if node.tag in UNSEEN and node.shown_from is None:
                node.shown_from = len(self.blocks)
            node = node.parent

    def _pop(self) -> str:
        tag = self.top.tag
        self.depth_of[tag] -= 1
        self.top = self.top.parent
        return tag

    def _close(self, tags: set, until: set) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``until`` lies inside it."""
        node, found = self.top, None
        while node.tag:
            if node.tag in tags:
                found = node
                if not node.parent or node.parent.tag not in tags:
                    break
            elif node.tag in until:
                break
            node = node.parent
        while found is not None and self._pop() and self.top is not found.parent:
            pass

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.current = None
        if self.depth_of.get(tag):
            node = self.top
            while self._pop() != tag:
                node = self.top
            if node.shown_from is not None:
                del self.blocks[node.shown_from :]
                self.current = None

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_data(self, data: str) -> None:
        if self.top.tag == "head" and data.strip():
            self._pop()
        if self.top.unseen or self.top.mute:
            return
        if self.current is None:
            if not data.strip():
                return
            node = self.top
            tag = node
            while tag.tag and tag.tag not in BLOCK:
                tag = tag.parent
            self.current = Block(tag.tag, node.container, node.apart, node.within, names=node.named)
            self.blocks.append(self.current)
        self.current.parts.append(data)
        if self.top.link:
            self.current.linked += len(data.strip())

    def finished(self) -> list[Block]:
        self.close()
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
            node = b.names
            while node is not None and node.wraps:
                node = node.parent.named
            b.named = node is not None
        return [b for b in self.blocks if b.text]


def evidence(block: Block) -> int:
    """The classifier's evidence for content, in hundredths of a logit; negative for boilerplate."""
    n = len(block.text)
    density = min(1.0, block.linked / n)
    out = 60 * math.log1p(n / 20) - 60 - 300 * density
    if block.tag == "p":
        out += 60
    elif block.tag[:1] == "h" and len(block.tag) == 2:
        out += 60
    elif block.tag in ("li", "td", "th", "dd", "dt"):
        out -= 40
    if block.text[-1] in ".!?\"'»”…":
        out += 40
    if block.within:
        out += 500
    if block.apart:
        out -= 1200
    elif block.named:
        out -= 700
    return round(out)


class Flow:
    """A flow network with integer capacities; maximum flow by level graphs and blocking flows."""

    def __init__(self, n: int):
        self.to: list[list[int]] = [[] for _ in range(n)]
        self.head: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.to[a].append(len(self.head))
        self.head.append(b)
        self.room.append(there)
        self.to[b].append(len(self.head))
        self.head.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.to)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in self.to[a]:
                b = self.head[e]
                if self.room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def saturate(self, source: int, sink: int) -> list[int]:
        """Levels from the source in the residual network of a maximum flow: -1 on the sink's side."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return level
            turn = [0] * len(self.to)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(k for k, e in enumerate(path) if not self.room[e])
                    a = self.head[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.to[a]
                while turn[a] < len(edges):
                    e = edges[turn[a]]
                    if self.room[e] and level[self.head[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    a = self.head[e ^ 1]
                    turn[a] += 1
                    continue
                path.append(e)
                a = self.head[e]


def content_blocks(blocks: list[Block]) -> list[bool]:
    """For each block, whether the minimum cut leaves it on the side of content."""
    n = len(blocks)
    flow = Flow(n + 2)
    source, sink = n, n + 1
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        e = evidence(b)
        if e > 0:
            flow.join(source, k, e)
        elif e < 0:
            flow.join(k, sink, -e)
        if k:
            like = b.apart == blocks[k - 1].apart and b.named == blocks[k - 1].named and b.within == blocks[k - 1].within
            flow.join(k - 1, k, 60 if like else 15, 60 if like else 15)
        near = last.get(b.container)
        if near is not None and near != k - 1:
            flow.join(near, k, 30, 30)
        last[b.container] = k
    level = flow.saturate(source, sink)
    return [level[k] >= 0 for k in range(n)]


def main_text(html: str | None) -> str:
    """The main text of a page: its content blocks, one to a line."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    blocks = parser.finished()
    content = content_blocks(blocks)
    if not any(content) and any(b.named for b in blocks):  # names that leave a page without text are those of its layout
        for b in blocks:
            b.named = False
        content = content_blocks(blocks)
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text (empty if the page has none) and n_chars (its code points) for every row of ``pages``.

    A null or empty page has no text. Markup may be broken or end early. Rows may repeat, ids and urls may be null. Other
    columns are not read. White space within a block becomes one space; nothing else of a content block is changed.
    """
    bounded_batches(pages.sparkSession)
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"].tolist()]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInPandas(run, f"id {id_kind}, url {url_kind}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
