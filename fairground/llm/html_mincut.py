"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from fairground.llm.common import small_batches

#: Elements (fixed values of HTML): those that hold no prose, those without an end tag, and those that
#: begin and end blocks.
SILENT = frozenset("head script style template noscript svg math iframe object canvas audio video title select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of the given names (as far as the innermost of the scope).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: What the elements around a block say, in units of cost; the same for words of class and id.
TAG_SAYS = {"article": 4, "main": 4, "nav": -8, "footer": -8, "aside": -8, "form": -8, "menu": -8, "dialog": -8, "button": -8, "fieldset": -6}
ROLE_SAYS = {"navigation": -8, "banner": -8, "contentinfo": -8, "complementary": -8, "search": -8, "dialog": -8, "alert": -8, "main": 4, "article": 4}
AGAINST = frozenset(
    "ad ads advert adverts advertisement advertising adv sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager form search copyright legal disclaimer skip".split()
)
FOR = frozenset("article content post entry main story body text".split())
HEADER_SAYS, CLASS_SAYS, CLASS_FOR = -6, -8, 2
#: Elements that hold the whole page: their classes speak of the page, not of a part of it.
WHOLE = ("html", "body")
#: Share of a page's letters from which on an element around an article is a page of its own, as it were: its classes
#: say no more than those of body.
NEARLY_ALL = 0.9
#: Units of cost to integer capacities; smoothness between blocks next to each other and between blocks
#: of one parent, divided by one more than their distance in the tree.
SCALE, ADJACENT, SIBLING = 100, 1.0, 0.6

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "parent", "depth", "says", "silent", "inside", "block", "against", "good", "letters", "forgiven")

    def __init__(self, tag: str, attrs: list, parent: _Element | None) -> None:
        self.tag, self.parent = tag, parent
        #: The innermost element around that is a block, this one included, else the page.
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.depth = parent.depth + 1 if parent else 0
        self.silent = (parent.silent if parent else False) or tag in SILENT
        self.inside = (parent.inside if parent else False) or tag in ("article", "main")
        says = TAG_SAYS.get(tag, 0)
        #: What class and id say against it, whether it looks like an article, the letters in it and in all below, and
        #: what is taken back of what was said against it and what is around it.
        self.against, self.good, self.letters, self.forgiven = 0, tag in ("article", "main"), 0, 0
        if tag == "header" and not self.inside:
            says += HEADER_SAYS
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)} if tag not in WHOLE else set()
                if words & AGAINST:
                    self.against += CLASS_SAYS
                elif "header" in words and not self.inside:
                    self.against += HEADER_SAYS
                elif words & FOR:
                    says += CLASS_FOR
                    self.good = True
            elif name == "role":
                says += ROLE_SAYS.get(value.lower(), 0)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                self.silent = True
        self.says = (parent.says if parent else 0) + says + self.against


class _Page(HTMLParser):
    """Blocks in page order: element of the first text, text, characters, characters within links, and
    what the elements around all of its text say, by their share of the characters.

    Open elements are kept by name as well, so that the nearest of a name is known at once, however many
    are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = _Element("#page", [], None)
        self.blocks: list[tuple[_Element, str, int, int, float]] = []
        self.text: list[str] = []
        self.owner: _Element | None = None
        self.links = self.linked = self.said = self.heard = 0
        self.named: dict[str, list[_Element]] = {}
        self.elements = [self.top]

    def end_block(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                says = self.said / self.heard if self.heard else self.owner.says
                self.blocks.append((self.owner, text, len(text), min(self.linked, len(text)), says))
            self.text, self.linked, self.said, self.heard = [], 0, 0, 0
        self.owner = None

    def open(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_block()
            if tag != "html":
                self.pop({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"})
        if tag in ENDS:
            self.pop(*ENDS[tag])
        if tag == "br":
            self.text and self.text.append(" ")
        if tag not in VOID:
            self.top = _Element(tag, attrs, self.top)
            self.elements.append(self.top)
            self.named.setdefault(tag, []).append(self.top)
            self.links += tag == "a"

    def pop(self, names: set, scope: set) -> None:
        """Close the nearest open element of these names, unless one of the scope comes first."""
        e = self.nearest(names)
        within = self.nearest(scope)
        if e is not None and (within is None or within.depth <= e.depth):
            self.close_to(e)

    def nearest(self, names) -> _Element | None:
        open_ = [self.named[n][-1] for n in names if self.named.get(n)]
        return max(open_, key=lambda e: e.depth) if open_ else None

    def close_to(self, e: _Element) -> None:
        while self.top is not e.parent:
            self.links -= self.top.tag == "a"
            self.named[self.top.tag].pop()
            self.top = self.top.parent

    def forgive(self) -> None:
        """Take back what classes say against elements that hold nearly all of the page and an article in it."""
        for e in reversed(self.elements[1:]):  # what is within an element comes after it
            e.parent.letters += e.letters
        holds = set()
        for e in self.elements:
            if e.good and e.parent is not None:
                above = e.parent
                while above is not None and id(above) not in holds:
                    holds.add(id(above))
                    above = above.parent
        for e in self.elements[1:]:
            own = e.against if e.letters >= NEARLY_ALL * self.elements[0].letters and id(e) in holds else 0
            e.forgiven = e.parent.forgiven - own

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        e = self.nearest((tag,))
        if e is not None:
            self.close_to(e)

    def handle_data(self, data: str) -> None:
        if self.top.silent:
            return
        if self.owner is None:
            self.owner = self.top
        self.text.append(data)
        letters = len(data) - data.count(" ")
        self.said += letters * self.top.says
        self.heard += letters
        self.top.letters += letters
        if self.links > 0:
            self.linked += len(data)


def blocks_of(html: str | None) -> list[tuple[_Element, str, int, int, float]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.end_block()
    page.forgive()
    return [(e, text, n, linked, says + e.forgiven) for e, text, n, linked, says in page.blocks]


def _container(e: _Element) -> _Element:
    """The element that holds the block: above inline elements and the block's own."""
    return e.block.parent or e.block


def _distance(a: _Element, b: _Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def _evidence(block: tuple[_Element, str, int, int, float]) -> float:
    """Over 0 for content, under it for boilerplate."""
    e, text, n, linked, says = block
    words = text.count(" ") + 1
    score = says + min(words, 40) / 20 - 6.0 * linked / n - (0.0 if e.inside else 1.5)
    score += {"p": 0.5, "h1": 1.0, "h2": 0.5, "h3": 0.5, "pre": 0.5, "blockquote": 0.5, "li": -0.5, "td": -0.5}.get(e.block.tag, 0.0)
    return score


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow; edges carry their capacity either way.

    Breadth-first levels, then augmenting paths along them, until the sink can't be reached."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: int, back: int) -> None:
        adj[a].append(len(to))
        adj[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i in range(n):
        if source[i]:
            link(s, i, source[i], 0)
        if sink[i]:
            link(i, t, sink[i], 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                pushed = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed
                path, u = [], s
                continue
            while at[u] < len(adj[u]):
                e = adj[u][at[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                e = path.pop()
                u = to[e ^ 1]
                continue
            path.append(e)
            u = to[e]


def main_text(html: str | None) -> str:
    """The blocks that a minimum cut leaves on the content side, one a line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    # neighbours with one parent that lean the same way are one node of the graph
    nodes: list[list] = []
    for i, block in enumerate(blocks):
        score, parent = _evidence(block), _container(block[0])
        if nodes and nodes[-1][1] is parent and (nodes[-1][0] > 0) == (score > 0):
            nodes[-1][0] += score
            nodes[-1][2].append(i)
        else:
            nodes.append([score, parent, [i]])
    cost = [round(SCALE * x[0]) for x in nodes]
    edges, last = [], {}
    for i, (_, parent, _) in enumerate(nodes):
        if i:
            edges.append((i - 1, i, round(SCALE * ADJACENT / (1 + _distance(nodes[i - 1][1], parent)))))
        if (j := last.get(id(parent))) is not None and j < i - 1:
            edges.append((j, i, round(SCALE * SIBLING)))
        last[id(parent)] = i
    content = min_cut([max(c, 0) for c in cost], [max(-c, 0) for c in cost], edges)
    return "\n".join(blocks[b][1] for keep, node in zip(content, nodes, strict=True) if keep for b in node[2])


def _extract(batches):
    for batch in batches:
        text = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    A page's blocks are nodes of a graph; neighbours of one parent that lean the same way are one node. What speaks for or against a block (the elements around it,
    their classes, its links and length) are the capacities to the two terminals; edges between blocks
    next to each other, and between blocks of one parent, keep neighbours together. The minimum cut labels
    all blocks at once; it is found page by page, nothing is shuffled.

    Null or empty html, and pages without content, give an empty text. Unclosed and unknown elements,
    missing ends and bare text are taken as browsers do, as far as text goes. Repeated pages come as
    often as they occur, null ids and urls stay null, an empty table gives no rows; other columns are
    ignored."""
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
