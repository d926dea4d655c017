"""Main text of web pages by minimum cut.

A page becomes a sequence of text blocks. A linear classifier gives each block the log-odds of being content, from its text
and from what its ancestors in the document tree are. Positive log-odds are the capacity from the source, negative
ones the capacity to the sink; blocks that follow each other, and blocks of one container, are joined by edges
whose capacity falls with their distance in the tree. The minimum cut is the labelling of least cost: content is what the
source still reaches after the maximum flow.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)", re.S)  # a quote counts only where a value begins
#: Ends of the elements that hold no elements; without one they reach to the end of the page.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title")}
#: Elements whose text is not the page's; an unclosed one ends with its container.
SKIP = frozenset("noscript template svg math select iframe object audio video canvas button".split())
#: One attribute after another, so that nothing inside a value or another name is taken for one.
ATTRS = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
OUT_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
IN_TAGS = frozenset("article main".split())
OUT_WORDS = frozenset("ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
                      "cookies disclaimer disqus dropdown footer gdpr login menu menubar modal nav navbar navigation newsletter notice overlay "
                      "pager pagination popup promo promoted promotion recommend recommended related replies reply respond search share sharing "
                      "sidebar signin signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
#: Words that may stand beside one of those in a name: "site-footer", "comments-area", "ad-slot-2"; any other word ("share-price") makes it another name.
BESIDE_WORDS = frozenset("area article articles bar block body bottom box btn button buttons col column container content div entries entry form global group header "
                         "holder icon icons id inner item items js left link links list main message module new outer page panel post posts primary "
                         "recent right row section secondary site slot social title top unit view wrap wrapper".split())
REPLY_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEAD_WORDS = frozenset("header masthead heading-bar".split())
DEEPEST = 512  # steps of a place in the tree; deeper elements take their place from the one above
IN_WORDS = frozenset("article body content entry main post story text".split())


@dataclass(frozen=True)
class Weights:
    """Of the classifier (log-odds of content) and of the smoothness edges."""

    bias: float = -2.0
    words: float = 1.1  # times log(1 + words)
    links: float = -5.0  # times the share of words inside links
    content_tag: float = 4.0
    content_name: float = 1.5
    out: float = -14.0  # in a menu, footer, sidebar, form, advert, notice or comment
    header: float = -8.0  # in a page header
    copyright: float = -4.0
    headline: float = 1.5
    next_block: float = 1.2
    same_container: float = 0.8


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    named: bool
    out: bool
    header: bool
    headline: bool
    path: tuple[int, ...]
    doubt: int = 0  # the element whose name alone puts the block outside


class Element:
    __slots__ = ("doubt", "foreign", "header", "inside", "key", "link", "named", "out", "path", "skip", "tag")

    def __init__(self, tag: str, key: int, above: Element | None, attrs: str):
        self.tag, self.key = tag, key
        self.inside, self.named, self.out, self.header, self.link = (above.inside, above.named, above.out, above.header, above.link) \
            if above else (False, False, False, False, False)
        self.doubt = above.doubt if above else 0
        self.path = (key,) if not above else above.path if tag in INLINE or len(above.path) >= DEEPEST else (*above.path, key)
        self.skip = tag in SKIP or above is not None and above.skip
        self.foreign = tag in ("svg", "math") or above is not None and above.foreign
        if tag in IN_TAGS:
            self.inside, self.doubt = True, 0  # what holds the article is not outside, whatever its name
        elif tag in OUT_TAGS:
            self.out = True
        elif tag == "header" and not self.inside:
            self.header = True
        elif tag == "a":
            self.link = True
        if attrs and tag not in ("html", "body") and ("=" in attrs or "hidden" in attrs):
            self.look(attrs)

    def look(self, attrs: str) -> None:
        for name, *values in ATTRS.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                self.out = True
            if name == "role" and value in ("navigation", "complementary", "contentinfo", "alert", "search"):
                self.out = True
            if name not in ("class", "id", "role", "aria-label"):
                continue
            parts = [{w.lower() for w in WORD.findall(part)} for part in ([value] if name == "aria-label" else value.split())]
            words = set().union(*parts)
            told = [p & OUT_WORDS for p in parts if p & OUT_WORDS and all(w in OUT_WORDS or w in BESIDE_WORDS or w.isdigit() for w in p)]
            if any(t & REPLY_WORDS for t in told):
                self.out = True
            elif told and self.tag not in IN_TAGS:
                self.doubt = self.doubt or self.key
            elif words & HEAD_WORDS and not self.inside:
                self.header = True
            elif words & IN_WORDS or value == "main":
                self.named = True


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    keys, stack = 0, [Element("html", 0, None, "")]
    pieces: list[tuple[str, bool]] = []
    where = stack[0]
    open_: Counter[str] = Counter()
    at = 0

    def end() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(p.split()) for p, link in pieces if link)
                out.append(Block(text, text.count(" ") + 1, linked, where.inside, where.named, where.out, where.header,
                                 any(open_[h] for h in ("h1", "h2", "h3")), where.path, where.doubt))
            pieces = []

    def innermost(tag: str, barrier: frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element of that name, 0 if there is none above a barrier."""
        if open_[tag]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    return k
                if stack[k].tag in barrier:
                    return 0
        return 0

    def close(k: int) -> None:
        if k:
            open_.subtract(e.tag for e in stack[k:])
            del stack[k:]

    while m := TOKEN.search(page, at):
        skip = stack[-1].skip
        if m.start() > at and not skip:
            if not pieces:
                where = stack[-1]
            pieces.append((html.unescape(page[at: m.start()]), stack[-1].link))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1], m[3] or ""
        whole = attrs.endswith("/") and (stack[-1].foreign or tag in ("svg", "math"))
        if tag == "br":
            if not skip:
                pieces.append((" ", False))
            continue
        if tag in RAW and not closing:
            if not whole:
                stop = RAW[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if closing:
            k = innermost(tag)
            if tag not in INLINE and not (stack[k].skip if skip and k else skip or tag in SKIP):
                end()
            close(k)
            continue
        if tag in ("button", "select"):
            close(innermost(tag))
            skip = stack[-1].skip
        if not skip:
            if tag not in INLINE and tag not in SKIP:
                end()
            if tag in CLOSES_P:
                close(innermost("p", frozenset(("div", "article", "section", "td", "li", "blockquote", "main", "aside", "table"))))
            elif tag == "li":
                close(innermost("li", frozenset(("ul", "ol", "menu"))))
            elif tag in ("td", "th", "tr"):
                close(innermost(tag, frozenset(("table",))))
        if tag not in VOID and not whole:
            keys += 1
            stack.append(Element(tag, keys, stack[-1], attrs))
            open_[tag] += 1
    if at < len(page) and not stack[-1].skip:
        if not pieces:
            where = stack[-1]
        pieces.append((html.unescape(page[at:]), stack[-1].link))
    end()
    return out


def log_odds(b: Block, w: Weights) -> float:
    s = w.bias + w.words * log1p(b.words) + w.links * min(1.0, b.linked / b.words)
    s += w.content_tag * b.inside + w.content_name * b.named + w.out * b.out + w.header * b.header + w.headline * (b.headline and b.inside)
    return s + w.copyright * b.text.startswith(("\N{COPYRIGHT SIGN}", "Copyright "))


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps between two places of the tree."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the source side of the minimum cut (Dinic's maximum flow)."""
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            edge(s, i, x, 0.0)
        elif x < 0:
            edge(i, t, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while next_[v] < len(out[v]):
                e = out[v][next_[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                next_[v] += 1
            if next_[v] < len(out[v]):
                path.append(out[v][next_[v]])
                v = to[path[-1]]
            elif v == s:
                break
            else:
                level[v] = -2
                v = to[path.pop() ^ 1]


def main_text(page: str | None, weights: Weights = Weights()) -> str:  # noqa: B008
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    under = Counter()
    for b in blocks:
        under[b.doubt] += b.words * (not b.out)
    whole = 0 if any(b.inside and not (b.out or b.doubt) for b in blocks) else sum(under.values())
    for b in blocks:  # a name puts an element outside, unless it holds most of the words of a page without an article
        b.out |= b.doubt > 0 and not 2 * under[b.doubt] > whole > 0
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, weights.next_block / (1 + distance(blocks[i - 1].path, b.path))))
        parent = b.path[-2] if len(b.path) > 1 else b.path[-1]
        if parent in last:
            edges.append((last[parent], i, weights.same_container / (i - last[parent])))
        last[parent] = i
    keep = min_cut([log_odds(b, weights) for b in blocks], edges)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null, empty or text-free html gives an empty text; broken markup (unclosed elements, a page cut anywhere) is read to its
    end; an unclosed element without text of the page, such as a button, ends with its container. An element is outside by its tag, its role, or by a name made up of
    words for such parts; a name does not count for an article, for what holds one, or for what holds most of the words of a page without one. Repeated rows are extracted
    once each, other columns are not read. Character references are decoded once, white space inside a block is one space, blocks are joined by one newline.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    cols = [pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(work, "page_id long, url string, text string, n_chars long")
