"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block its log-odds of being content; they become the capacities to the terminals (content as source,
boilerplate as sink). Blocks that follow each other and blocks that share a container are joined by smoothness edges, heavier the closer they are in the DOM.
The minimum cut, found by maximum flow, separates content from the rest: a short line between paragraphs goes with them, one between menu entries with those.

The classifier adds the evidence of the containers (what elements and their names say) and that of the block's own shape: share of its text in links, words, whether it ends like a
sentence, its element. The odds of each shape are trained on the pages at hand: where containers are outspoken, their blocks count as examples, in one pass over all pages
with sums of a fixed size. PRIOR_BLOCKS blocks of fixed odds of each kind come first, so that few pages don't sway them.

Blocks whose own capacity outweighs all their edges keep their side in some minimum cut; they are settled first, and what is left falls apart into
small graphs for the flow. Reading a page takes time in proportion to its length, whatever its markup.

Text of a block: character references decoded, white space (and <br>) turned into one space, trimmed; blocks are joined in page order by two newlines.

Defined cases: a null or empty page has empty text; text outside any element is a block; unclosed and misnested markup is read as far as it goes; a tag, comment or
script that the page ends in isn't text; a null page_id is an ordinary row; pages of any length are read whole; repeated rows repeat; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import bound_batches

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED_TAGS = frozenset("script style noscript template svg iframe textarea title object select button head math canvas audio video datalist".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
#: Elements that end an open <p>, and elements that end an open one of their own kind.
ENDS_P = BLOCK_TAGS - {"body", "html", "head", "option", "optgroup"}
ENDS_OWN = frozenset("li dd dt option tr td th p".split())
#: Elements that a <p> outside of them doesn't reach into.
P_SCOPE = frozenset("td th table caption button html".split())

# Evidence of containers: log-odds of content by element, and by words in class, id or role.
CONTAINER_ODDS = {"article": 2.0, "main": 1.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "header": -6.0, "address": -2.0}
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist respond reply replies discussion disqus share sharing social related recommended recommendations widget widgets toolbar copyright legal pagination pager tags tagcloud search skip toc".split())
GOOD_WORDS = frozenset("article articlebody content entry post story body text main".split())
BAD_ODDS, GOOD_ODDS, START_ODDS = -6.0, 1.0, 0.5
LEAST_ODDS, MOST_ODDS = -9.0, 3.0

# Evidence of a block's shape: upper bounds of the bins of its link share and words, and the odds that training starts from.
LINK_BINS, WORD_BINS = (0.0, 0.2, 0.5, 0.9), (2, 5, 10, 20, 40)
SHAPE_ODDS = {
    "links": (0.4, 0.4, -0.7, -2.0, -3.0),
    "words": (-1.0, -0.7, -0.2, 0.4, 1.0, 1.6),
    "ending": (-0.4, 0.5),
    "element": (0.0, 0.8, 0.5, -0.4, -0.3),
}
ELEMENT_KIND = {"p": 1, "blockquote": 1, "pre": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "td": 4, "th": 4, "dt": 4, "dd": 4}
#: Shapes depend on each other, so their odds count in part; one shape says no more than this.
SHAPE_SHARE, SHAPE_MOST = 0.6, 2.5
#: The prior's weight in blocks; containers beyond these odds are outspoken.
PRIOR_BLOCKS, OUTSPOKEN = 200, (-3.0, 1.0)

#: Smoothness: of neighbours in the page, of neighbours in a container, and what each step up the DOM to a common container leaves.
NEXT_EDGE, SIBLING_EDGE, PER_STEP = 1.2, 0.8, 0.7

# Possessive, so that no tag is read twice. A quote counts after an equals sign only.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Names like these tell of the page, not of the element.
_ABOUT = re.compile(r"(?:no|has|with|without)[-_]")


@dataclass(slots=True)
class Element:
    tag: str
    up: Element | None
    depth: int
    good: float
    bad: float
    in_article: bool
    skipped: bool
    #: The nearest open <p> that a new block element ends.
    p: Element | None = None


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    element: Element
    odds: float = 0.0
    edges: dict[int, float] = field(default_factory=dict)


def _names(attributes: str) -> set[str]:
    """The words in class, id and role."""
    out: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            if not _ABOUT.match(token):
                out.update(_SPLIT.split(token))
    return out


def _open(tag: str, attributes: str, up: Element | None) -> Element:
    good, bad = (up.good, up.bad) if up else (0.0, 0.0)
    in_article = bool(up and up.in_article) or tag in ("article", "main")
    own = CONTAINER_ODDS.get(tag, 0.0)
    if tag == "header" and up and up.in_article:
        own = 0.0  # an article's own heading
    if attributes and tag not in ("body", "html"):
        names = _names(attributes)
        if names & GOOD_WORDS:
            own += GOOD_ODDS
        elif names & BAD_WORDS:
            own = min(own, 0.0) + BAD_ODDS
    if own < 0:  # what stands around it says no more
        good, bad = 0.0, max(LEAST_ODDS, bad + own)
    elif own > 0 and not bad:
        good = min(MOST_ODDS, good + own)
    elif tag == "main":
        bad = max(bad, -1.0)
    e = Element(tag, up, up.depth + 1 if up else 0, good, bad, in_article, bool(up and up.skipped) or tag in SKIPPED_TAGS)
    e.p = e if tag == "p" else None if tag in P_SCOPE or up is None else up.p
    return e


class _Reader:
    """Reads one page from left to right, once."""

    def __init__(self, page: str):
        self.page, self.blocks, self.parts = page, [], []
        self.at = self.root = _open("html", "", None)
        self.open: Counter = Counter()
        self.links = self.link_depth = 0
        self.quotes = True  # whether quotes may still hide the end of a tag

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append(Block(text, self.links, self.at))
        self.links = 0

    def text(self, begin: int, end: int) -> None:
        if end > begin and not self.at.skipped:
            text = self.page[begin:end]
            if "&" in text:
                text = _html.unescape(text)
            self.parts.append(text)
            if self.link_depth:
                self.links += len(text.strip())

    def close_to(self, e: Element) -> None:
        """Leaves e and all within it."""
        x = self.at
        while x is not e:
            self.open[x.tag] -= 1
            x = x.up
        self.open[e.tag] -= 1
        self.at = e.up

    def tag_end(self, place: int) -> int:
        """Where the > of a tag stands, or -1."""
        if self.quotes:
            end = _ATTRIBUTES.match(self.page, place).end()
            if end < len(self.page):
                return end
            self.quotes = False  # a quote without end: from here on they don't count
        return self.page.find(">", place)

    def read(self) -> list[Block]:
        page, n, place, begin = self.page, len(self.page), 0, 0
        while (lt := page.find("<", place)) >= 0:
            place = lt + 1
            if page.startswith("!--", place):
                end = page.find("-->", place + 1)
                end = n if end < 0 else end + 3
            elif page[place : place + 1] in ("!", "?"):
                end = page.find(">", place) + 1 or n
            else:
                closing = page.startswith("/", place)
                m = _NAME.match(page, place + closing)
                if not m:
                    continue  # a sign, not a tag
                end = self.tag_end(m.end()) + 1
                if not end:
                    end = n
                else:
                    self.text(begin, lt)
                    end = begin = self.tag(m[0].lower(), closing, m.end(), end)
                    place = end
                    continue
            self.text(begin, lt)
            place = begin = end
        self.text(begin, n)
        self.flush()
        return self.blocks

    def tag(self, tag: str, closing: bool, place: int, end: int) -> int:
        """Takes in one tag; where to read on."""
        if closing:
            if tag == "a":
                self.link_depth = max(0, self.link_depth - 1)
            if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
                if self.open[tag] > 0:
                    self.flush()
                    e = self.at
                    while e.tag != tag:
                        e = e.up
                    self.close_to(e)
                elif tag in BLOCK_TAGS:
                    self.flush()
            return end
        if tag == "br":
            self.parts.append(" ")
            return end
        if tag in RAW_TAGS:
            m = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(self.page, end)
            if tag == "title":
                self.flush()
            return (self.page.find(">", m.end()) + 1 or len(self.page)) if m else len(self.page)
        if tag == "a":
            self.link_depth += 1
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            if tag in BLOCK_TAGS:
                self.flush()
                self.link_depth = 0 if tag != "div" else self.link_depth
            if tag in VOID_TAGS or tag == "html":
                return end
            if tag in ENDS_P and self.at.p is not None:
                self.close_to(self.at.p)
            if tag in ENDS_OWN and self.at.tag == tag:
                self.close_to(self.at)
            if tag == "body":
                self.at = self.root
                self.open.clear()
            self.at = _open(tag, self.page[place : end - 1], self.at)
            self.open[tag] += 1
        return end


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    return _Reader(page).read()


def shape(block: Block) -> tuple[int, int, int, int]:
    """The bins of a block, in the order of SHAPE_ODDS."""
    links = min(1.0, block.link_chars / len(block.text))
    words = block.text.count(" ") + 1
    return sum(links > x for x in LINK_BINS), sum(words > x for x in WORD_BINS), int(block.text[-1] in ".!?:\"”»…。！？"), ELEMENT_KIND.get(block.element.tag, 0)


def train(pages: DataFrame, share: int = 1) -> dict[str, tuple[float, ...]]:
    """The odds of each shape, from the blocks of outspoken containers of all pages; a caller may ask for one page of `share` only, by hash of its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                for b in blocks_of(page.as_py() or ""):
                    said = b.element.good + b.element.bad
                    if said < OUTSPOKEN[0] or said > OUTSPOKEN[1]:
                        seen.update((k, x, said > 0) for k, x in enumerate(shape(b)))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))] + [pa.array([r[1] for r in rows], pa.int64())], ["shape", "bin", "good", "n"])

    drawn = pages.select(F.col("html").cast("string").alias("html"))
    if share > 1:
        drawn = drawn.filter(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)
    sums = drawn.mapInArrow(run, "shape int, bin int, good boolean, n long").groupBy("shape", "bin", "good").agg(F.sum("n").alias("n"))
    return shape_odds({(r["shape"], r["bin"], r["good"]): r.n for r in sums.collect()})  # a row for each bin and side


def shape_odds(seen: dict[tuple[int, int, bool], int]) -> dict[str, tuple[float, ...]]:
    """Log-odds by bin from counts of (shape, bin, good) blocks, the prior's blocks added."""
    out = {}
    for k, (name, prior) in enumerate(SHAPE_ODDS.items()):
        sides = []
        for good in (False, True):
            share = [math.exp(o / 2 if good else -o / 2) for o in prior]
            counts = [seen.get((k, x, good), 0) + PRIOR_BLOCKS * w / sum(share) for x, w in enumerate(share)]
            sides.append([c / sum(counts) for c in counts])
        out[name] = tuple(max(-SHAPE_MOST, min(SHAPE_MOST, math.log(g / b))) for b, g in zip(*sides, strict=True))
    return out


def weigh(blocks: list[Block], odds: dict[str, tuple[float, ...]] = SHAPE_ODDS) -> None:
    """Log-odds and smoothness edges of the blocks."""
    tables = list(odds.values())
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        e = b.element
        b.odds = START_ODDS + e.good + e.bad + SHAPE_SHARE * sum(t[x] for t, x in zip(tables, shape(b), strict=True))
        if i:
            x, y, steps = blocks[i - 1].element, e, 0
            while x is not y:
                x, y = (x.up, y) if x.depth > y.depth else (x, y.up) if y.depth > x.depth else (x.up, y.up)
                steps += 1
            _edge(blocks, i - 1, i, NEXT_EDGE * PER_STEP ** min(steps, 99))
        up = id(e.up)
        if up in last_in:
            _edge(blocks, last_in[up], i, SIBLING_EDGE)
        last_in[up] = i


def _edge(blocks: list[Block], i: int, j: int, w: float) -> None:
    blocks[i].edges[j] = blocks[i].edges.get(j, 0.0) + w
    blocks[j].edges[i] = blocks[j].edges.get(i, 0.0) + w


def label(odds: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Content or not for each node: the minimum of the sum of the odds given up and of the edges cut; ties are boilerplate."""
    n = len(odds)
    odds, side = list(odds), [None] * n
    work = deque(range(n))
    while work:
        i = work.popleft()
        if side[i] is not None:
            continue
        free = sum(w for j, w in edges[i].items() if side[j] is None)
        if odds[i] > free or -odds[i] >= free:
            side[i] = odds[i] > free
            for j, w in edges[i].items():
                if side[j] is None:
                    odds[j] += w if side[i] else -w
                    work.append(j)
    for begin in range(n):
        if side[begin] is None:  # a connected part of what is left
            part, seen = [begin], {begin}
            for i in part:
                new = [j for j in edges[i] if side[j] is None and j not in seen]
                part += new
                seen.update(new)
            for i, s in zip(part, _max_flow([odds[i] for i in part], [{j: w for j, w in edges[i].items() if side[j] is None} for i in part], part), strict=True):
                side[i] = s
    return side


def _max_flow(odds: list[float], edges: list[dict[int, float]], names: list[int]) -> list[bool]:
    """Dinic's algorithm; the nodes that the source still reaches."""
    n = len(odds)
    place = {x: i for i, x in enumerate(names)}
    cap: list[dict[int, float]] = [{place[j]: w for j, w in e.items()} for e in edges] + [{}, {}]
    s, t, tiny = n, n + 1, 1e-9
    for i, o in enumerate(odds):
        if o > 0:
            cap[s][i] = o
            cap[i].setdefault(s, 0.0)
        elif o < 0:
            cap[i][t] = -o
            cap[t].setdefault(i, 0.0)
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return [i in level for i in range(n)]
        ways = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                path = [s]
                ways[s] = iter(list(cap[s]))
                continue
            for v in ways[u]:
                if cap[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level.pop(u, None)


def extract(page: str | None, odds: dict[str, tuple[float, ...]] = SHAPE_ODDS) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    weigh(blocks, odds)
    keep = label([b.odds for b in blocks], [b.edges for b in blocks])
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    d = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    bound_batches(pages.sparkSession)
    odds = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py(), odds) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url {d.schema['url'].dataType.simpleString()}, text string, n_chars long")
