"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks of text at block elements. A classifier of a block's
place and shape (sectioning elements and class names above it, link density,
length, punctuation) gives its cost as content and as boilerplate; these costs
become terminal capacities of a flow network. Neighbouring blocks, and blocks
with the same parent, are tied by smoothness edges that grow with DOM proximity.
The minimum cut is the labelling of least total cost; blocks on the source side
are the content.

Scripts, styles, templates, comments and form controls never make blocks.
Character references are decoded, white space inside a block becomes one space,
empty blocks vanish and blocks are joined by one newline in page order. Null
and empty pages give the empty text. End tags may be left out: a head ends at the
first thing that is not of a head, an option at the next one, and a skipped element
that no end tag closes is read as if its start tag were not there. Names of classes and ids count by whole words, and not where
a word before or after takes them back (`no-sidebar`, `comments-open`); marks on an element with most of the page's
text say nothing unless an article lies outside it, and a page with no content by its marks gives its unmarked blocks. Nothing is dropped or capped otherwise.
Repeated rows are extracted row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from gridlens.llm.text import as_key, exact, longs

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mrow mtext mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mfenced semantics".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("script style template noscript head title svg iframe object select textarea button option datalist canvas audio video annotation annotation-xml".split())
HEAD_ITEMS = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: the end of these is the end of the page if their end tag is missing.
RAW = frozenset("script style".split())
OPTIONS = frozenset("option optgroup".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: an element of these holds list items, cells and options of its own.
SCOPES = frozenset("table ul ol dl menu select".split())
BOILER_TAGS = frozenset("nav footer aside form header menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
#: fixed values: words of class names, ids and roles, their endings, and words before or after them that take them back.
BOILER_WORDS = "nav menu footer header sidebar advert banner cookie notice promo share sharing social related comment breadcrumb popup modal subscribe newsletter login widget sponsor consent toolbar pagination copyright masthead disclaimer".split()
BOILER_NAMES = frozenset("ad ads adv hidden complementary contentinfo navigation search alert".split())
CONTENT_WORDS = "article content entry post story main".split()
ENDINGS = "(?:s|es|ed|ing|bar|box|list|block|wrap|wrapper|container|area|section|inner|link|links|item|isement|isements|ising|overlay|row|column|form)?"
BEFORE, AFTER = frozenset("no not has with without hide hides show shows is can".split()), frozenset("open opened closed enabled disabled off on allowed free left right".split())
BOILER = re.compile(f"(?:{'|'.join(BOILER_WORDS)}){ENDINGS}")
CONTENT = re.compile(f"(?:{'|'.join(CONTENT_WORDS)}){ENDINGS}|body-?text")
COMMENTS = re.compile("comments?|commentlist|commentarea|respond|disqus")
#: marks on an element with more than this share of the page's text say nothing, if no article of this many characters lies outside it.
MOST_TEXT, ARTICLE = 0.6, 200
#: a page without content by its marks gives its unmarked blocks, if they have so many characters and no more than half of them in links.
LEAST_TEXT = 40
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCALE = 100


def words_of(names: str) -> list[str]:
    """The words of a class name or id: parts between hyphens, underscores and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+", names)]


def named(attrs: list[tuple[str, str | None]]) -> tuple[int, int, bool]:
    """What class, id, role and visibility say: (boilerplate marks, content marks, whether the marks hold whatever the element's size)."""
    boiler = content = firm = False
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for name in v.split():
                words = words_of(name)
                for i, w in enumerate(words):
                    if i and words[i - 1] in BEFORE or i + 1 < len(words) and words[i + 1] in AFTER and w not in ("sidebar", "ad", "ads", "nav", "menu", "banner"):
                        continue
                    mark = bool(BOILER.fullmatch(w)) or w in BOILER_NAMES
                    boiler |= mark
                    firm |= mark and bool(COMMENTS.fullmatch(w))
                    content |= bool(CONTENT.fullmatch(w))
    hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
    return 2 * boiler + 9 * hidden, int(content), firm or hidden


@dataclass
class Block:
    text: str
    node: int
    box: int
    depth: int
    boiler: int
    content: int
    links: int
    heading: bool


@dataclass
class Node:
    """An element: its parent and nearest block element, how deep that is, and its own marks."""

    parent: int
    box: int
    depth: int
    boiler: int = 0
    content: int = 0
    firm: bool = False
    article: bool = False


class Blocks(HTMLParser):
    """Text blocks of a page with what the classifier needs of their place."""

    def __init__(self, unclosed: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.skips: list[tuple[str, int]] = []  # tags open within what is skipped, and the number of the start tag
        self.unclosed, self.starts = unclosed, 0
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int]] = []  # tag, node number
        self.tree = [Node(0, 0, 0)]
        self.open_p = 0
        self.linked, self.heads, self.words, self.in_links = 0, 0, [], 0

    def _flush(self) -> None:
        if self.words and (text := " ".join("".join(self.words).split())):
            at = self.stack[-1][1] if self.stack else 0
            self.blocks.append(Block(text, at, self.tree[at].box, self.tree[at].depth, 0, 0, min(self.in_links, len(text)), self.heads > 0))
        self.words, self.in_links = [], 0

    def handle_starttag(self, tag, attrs):
        self.starts += 1
        if self.skips:
            self._skip_ends(tag)
        if self.skips or tag in SKIPPED and self.starts not in self.unclosed:
            if not self.skips:
                self._flush()
            if tag not in VOID:
                self.skips.append((tag, self.starts))
            return
        if tag not in INLINE:
            self._flush()
            self._close_implied(tag)
        elif tag in ("br", "wbr", "img"):
            self.words.append(" ")
        if tag in VOID:
            return
        over = self.stack[-1][1] if self.stack else 0
        node = Node(over, self.tree[over].box, self.tree[over].depth, 3 * (tag in BOILER_TAGS), 2 * (tag in CONTENT_TAGS), False, tag in CONTENT_TAGS)
        if tag not in INLINE:
            node.box, node.depth = len(self.tree), node.depth + 1
        if attrs and tag not in ("a", "html", "body"):
            less, more, node.firm = named(attrs)
            node.boiler, node.content = node.boiler + less, node.content + more
        self.stack.append((tag, len(self.tree)))
        self.tree.append(node)
        self.linked += tag == "a"
        self.open_p += tag == "p"
        self.heads += tag in HEADINGS

    def _skip_ends(self, tag: str) -> None:
        """A start tag ends a skipped head it has no place in, and an open option."""
        names = [x[0] for x in self.skips]
        if names[0] == "head" and (tag == "body" or len(names) == 1 and tag not in HEAD_ITEMS):
            self.skips.clear()
        elif tag in OPTIONS and "option" in names:
            del self.skips[len(names) - 1 - names[::-1].index("option") :]
        elif names[0] == "option" and tag not in INLINE:
            self.skips.clear()

    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    def _close_implied(self, tag: str) -> None:
        """A block element ends an open paragraph; list items, cells and rows end their like."""
        if self.open_p:
            self._pop("p")
        if tag in CLOSED_BY:
            for name, _ in reversed(self.stack):
                if name in CLOSED_BY[tag]:
                    return self._pop(name)
                if name in SCOPES:
                    return None

    def _pop(self, tag: str) -> None:
        while self.stack:
            name = self.stack.pop()[0]
            self.linked -= name == "a"
            self.open_p -= name == "p"
            self.heads -= name in HEADINGS
            if name == tag:
                return

    def handle_endtag(self, tag):
        if self.skips:
            names = [x[0] for x in self.skips]
            if tag in names:
                del self.skips[len(names) - 1 - names[::-1].index(tag) :]
                return
            if names[0] == "template" or all(x[0] != tag for x in self.stack):
                return
            self.skips.clear()  # what holds the skipped element ends, and it with that
        if tag not in INLINE:
            self._flush()
        if self.stack and self.stack[-1][0] == tag or any(x[0] == tag for x in self.stack):
            self._pop(tag)

    def handle_data(self, data):
        if len(self.skips) == 1 and self.skips[0][0] == "head" and not data.isspace():
            self.skips.clear()
        if not self.skips:
            self.words.append(data)
            if self.linked:
                self.in_links += len(data)


def weigh(parser: Blocks) -> list[Block]:
    """The blocks with the marks above them.

    A mark says nothing on an element with most of the page's text, such as the form or the wrapper of a whole
    page, unless an article lies outside it; marks of comments hold all the same, and end what an article around them says.
    """
    tree, n = parser.tree, len(parser.tree)
    size, inner = [0] * n, [0] * n
    for b in parser.blocks:
        size[b.node] += len(b.text)
    for v in range(n - 1, 0, -1):  # children have higher numbers
        if tree[v].article:
            inner[v] = size[v]
        size[tree[v].parent] += size[v]
        inner[tree[v].parent] += inner[v]
    marks, inside = [(0, 0)] * n, [False] * n
    for v in range(1, n):
        node = tree[v]
        boiler, content = marks[node.parent]
        inside[v] = inside[node.parent] or node.article
        own = node.boiler
        if own and not node.firm and size[v] > MOST_TEXT * size[0] and inner[0] - (size[v] if inside[v] else inner[v]) < ARTICLE:
            own = 0
        if node.firm and own:
            content = 0
        marks[v] = boiler + own, content + node.content
    for b in parser.blocks:
        b.boiler, b.content = marks[b.node]
    return parser.blocks


def blocks_of(html: str) -> tuple[list[Block], list[Node]]:
    unclosed: frozenset[int] = frozenset()
    while True:
        parser = Blocks(unclosed)
        parser.feed(html)
        parser.close()
        left = {at for tag, at in parser.skips if tag in SKIPPED and tag not in RAW}
        if not left or left <= unclosed:
            parser._flush()
            return weigh(parser), parser.tree
        unclosed |= left


def costs(b: Block) -> tuple[int, int]:
    """Capacities (as content, as boilerplate): what the cut pays if the block is labelled the other way."""
    n = len(b.text)
    link = b.links / n
    content = 0.6 * (b.content > 0) + 1.2 * min(b.content, 2) + 0.8 * min(n, 300) / 300 + 0.3 * any(c in b.text for c in ".!?;:,") + 0.3 * b.heading
    boiler = 1.6 * b.boiler + 2.0 * link * (link > 0.3) + 0.7 * (n < 40 and not b.heading) * (b.content == 0) + 0.6 * (b.content == 0) * (n < 120)
    return int(content * SCALE), int(boiler * SCALE)


def smoothness(a: Block, b: Block, tree: list[Node]) -> int:
    """Tie of two neighbours: more for more common ancestors, none across a change of section."""
    if a.boiler != b.boiler or a.content != b.content:
        return 2
    x, y = a.box, b.box
    while x != y:  # up to the nearest common one: no further than the blocks are apart
        if tree[x].depth >= tree[y].depth:
            x = tree[tree[x].parent].box
        else:
            y = tree[tree[y].parent].box
    return int(SCALE * 0.4 * (1 + tree[x].depth) / (1 + max(a.depth, b.depth)))


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (undirected ties), by shortest augmenting paths."""
    n = len(source)
    s, t = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in range(n):  # what flows straight through a node needs no search
        through = min(source[v], sink[v])
        if source[v] > through:
            tie(s, v, source[v] - through, 0)
        elif sink[v] > through:
            tie(v, t, sink[v] - through, 0)
    for a, b, c in edges:
        if c > 0:
            tie(a, b, c, c)
    while True:
        level, queue = [-1] * (n + 2), deque([s])
        level[s] = 0
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(out[v]):
                path.append(out[v][at[v]])
                v = to[path[-1]]
            elif v == s:
                break
            else:
                at[to[path[-1] ^ 1]] += 1
                v = to[path.pop() ^ 1]


def label(blocks: list[Block], tree: list[Node]) -> list[bool]:
    """True for the content blocks."""
    if not blocks:
        return []
    both = [costs(b) for b in blocks]
    edges = [(i, i + 1, smoothness(blocks[i], blocks[i + 1], tree)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):  # the next block under the same container, over what stands between
        parent = tree[tree[b.box].parent].box
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, smoothness(blocks[last[parent]], b, tree) // 2))
        last[parent] = i
    return min_cut([c for c, _ in both], [b for _, b in both], edges)


def main_text(html: str | None) -> str:
    if not isinstance(html, str) or not html:
        return ""
    blocks, tree = blocks_of(html)
    kept = [b for b, keep in zip(blocks, label(blocks, tree), strict=True) if keep]
    if not kept:
        plain = [b for b in blocks if not b.boiler]
        size = sum(len(b.text) for b in plain)
        kept = plain if size >= LEAST_TEXT and 2 * sum(b.links for b in plain) <= size else []
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page; one narrow pass in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": longs(exact(batch["page_id"])), "url": batch["url"], "text": [main_text(h) for h in batch["html"]]})

    return pages.select(as_key(pages[id_col]).alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInPandas(run, "page_id long, url string, text string")
