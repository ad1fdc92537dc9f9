"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the element tree. A logistic classifier over elements,
class and id words, link density, length and punctuation gives each block a cost for either label; these are
capacities to the two terminals. Neighbours, and more so blocks of the same container, are joined by smoothness
edges. The minimum cut, found by maximum flow, separates content from boilerplate, so that an unsure block (a short
line, a heading, a cell) goes with what stands around it.

The classifier and the smoothness are fitted on labelled pages that ``html_training`` makes, a fixed number from a
fixed seed; both are small vectors.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches

_RAW = frozenset("script style noscript template svg iframe object canvas textarea select title noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_ITEM = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset("ul ol dl menu table".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Elements that a block shares with others; what stands between such an element and its text is the block's own.
_OWN = _HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot figcaption summary caption".split())
_NEVER = frozenset("nav aside footer form button dialog menu fieldset".split())
_ARTICLE = frozenset(["article", "main"])
#: Words of class and id names that speak against content or for it, and such that only say what a page has.
BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social"
    " related recommend recommended recommendations comment comments commentlist replies reply disqus widget pagination pager toolbar search tags hidden"
    " complementary contentinfo dialog aside teaser".split()
)
#: Of these one is enough, whatever stands beside it in a name ("post-comments"); others count by their share of it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter comment comments"
    " commentlist replies disqus related share sharing pagination pager popup modal complementary contentinfo".split()
)
GOOD = frozenset("article content post entry story main body text prose".split())
_HAS = frozenset("with has no without layout".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*(=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?)?")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
#: A block of more words is no surer to be prose.
MOST_WORDS = 40
FEATURES = ["one", "never", "header", "bad", "good", "inside", "nested", "links", "list_links", "words", "ends", "commas", "paragraph", "heading", "item", "cell"]


@dataclass
class Block:
    """Text of one block, characters of it in links, its element, its container and its inherited marks."""

    text: str
    linked: int
    tag: str
    parent: int
    mark: tuple


class Page:
    """Elements and text blocks of a page; one pass, each character read a bounded number of times."""

    def __init__(self, page: str):
        self.tags, self.parents, self.names, self.holds = [""], [0], [()], [False]
        self.stack, self.links, self.parts, self.linked = [0], 0, [], 0
        self.raw: list[tuple[str, int, int]] = []
        self._parse(page)
        self._flush()

    def _parse(self, page: str) -> None:
        at = 0
        while (lt := page.find("<", at)) >= 0:
            self._take(page[at:lt])
            if page.startswith("<!--", lt):
                short = next((k for k in (">", "->") if page.startswith(k, lt + 4)), None)
                end = lt + 4 + len(short) if short else page.find("-->", lt + 4) + 3
                at = end if end > 2 else len(page)
            elif m := _TAG.match(page, lt + 1):
                at = self._open(page, m[0].lower(), m.end())
            elif page.startswith("</", lt) and (m := _TAG.match(page, lt + 2)):
                at = self._attributes(page, m.end())[0]
                self._close(m[0].lower())
            elif page.startswith(("<!", "<?", "</"), lt):
                at = page.find(">", lt) + 1 or len(page)
            else:
                self._take("<")
                at = lt + 1
        self._take(page[at:])

    @staticmethod
    def _attributes(page: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """Past the tag's end, its attributes, and whether it closes itself; a tag that never ends takes the rest."""
        out = []
        while True:
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if m[1]:
                out.append((m[1].lower(), m[3] or m[4] or m[5] or ""))
            if at >= len(page) or (m[2] and page[at] in "\"'" and m[3] is None and m[4] is None and m[5] is None):
                return len(page), out, False
            if page[at] == ">":
                return at + 1, out, page[at - 1] == "/"

    def _take(self, text: str) -> None:
        if text:
            self.parts.append(html.unescape(text) if "&" in text else text)
            if self.links:
                self.linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.raw.append((text, min(self.linked, len(text)), self.stack[-1]))
        self.parts.clear()
        self.linked = 0

    def _cut(self, i: int) -> None:
        self.links -= sum(self.tags[s] == "a" for s in self.stack[i:])
        del self.stack[i:]

    def _open(self, page: str, tag: str, at: int) -> int:
        at, attributes, closed = self._attributes(page, at)
        if tag == "br":
            self.parts.append(" ")
            return at
        if tag not in _INLINE and tag not in _VOID or tag == "hr":
            self._flush()
        if tag in _RAW:
            end = None if closed and tag == "svg" else _CLOSE[tag].search(page, at)
            return at if closed and tag == "svg" else self._attributes(page, end.end())[0] if end else len(page)
        if tag in _VOID:
            return at
        if tag in _ENDS_PARAGRAPH:
            self._end(("p",))
        if tag in _ENDS_ITEM:
            self._end(_ENDS_ITEM[tag])
        node = len(self.tags)
        names, hidden = [], False
        for name, value in attributes:
            if name in ("class", "id", "role"):
                names.append(value)
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value and bool(re.search(r"display\s*:\s*none", value))
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.names.append((tuple(names), hidden))
        self.holds.append(False)
        if tag in _ARTICLE:
            up = self.stack[-1]
            while up and not self.holds[up]:
                self.holds[up] = True
                up = self.parents[up]
        self.links += tag == "a"
        self.stack.append(node)
        return at

    def _end(self, tags) -> None:
        """Close what is open of ``tags``, unless a list or another block holds it."""
        for i in range(len(self.stack) - 1, max(0, len(self.stack) - 64), -1):
            tag = self.tags[self.stack[i]]
            if tag in tags:
                self._cut(i)
                if "tr" not in tags:
                    return
            elif tag in _LISTS or tag not in _INLINE and tag not in _OWN:
                return

    def _close(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
            return
        for i in range(len(self.stack) - 1, max(0, len(self.stack) - 512), -1):
            open_ = self.tags[self.stack[i]]
            if open_ == tag:
                self._cut(i)
                return
            if open_ not in _INLINE and tag in _INLINE:
                return

    def _marks(self) -> list[tuple]:
        """What each element passes on: never, header, bad, good, inside, nested, tag of the block, container."""
        out = [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "", 0)]
        for i in range(1, len(self.tags)):
            never, header, bad, good, inside, nested, tag, box = out[self.parents[i]]
            own = self.tags[i]
            names, hidden = self.names[i]
            if hidden or own in _NEVER:
                never = 1.0
            if own == "header" and not inside:
                header = 1.0
            if names:
                w = [x.lower() for n in names for x in _NAME.findall(n)]
                wrapper = self.holds[i] or own in ("html", "body")
                if w and not wrapper and not _HAS.intersection(w):
                    n_bad = sum(x in BAD for x in w)
                    if own in _ARTICLE:  # an article's names say what it has, unless it is a comment itself
                        n_bad = len(w) * (not {"comment", "reply"}.isdisjoint(w))
                    speaks = 1.0 if n_bad and not STRONG.isdisjoint(w) else max(0.5, n_bad / len(w)) if n_bad else 0.0
                    bad, good = max(bad, speaks), 0.0 if speaks else max(good, 1.0 if any(x in GOOD for x in w) else 0.0)
                    inside = 0.0 if speaks == 1.0 else inside  # a part of the article that is none of its text
            if own == "article":
                nested = 1.0 if inside == 1.0 and any(self.tags[a] == "article" for a in self._above(i)) else nested
            if own in _ARTICLE:
                inside, header = 1.0, 0.0
            if own not in _INLINE:
                tag = own
                box = i if own not in _OWN else box
            out.append((never, header, bad, good, inside, nested, tag, box))
        return out

    def _above(self, i: int) -> Iterator[int]:
        while i := self.parents[i]:
            yield i

    def blocks(self) -> list[Block]:
        """The blocks in order; white space within a block is one blank."""
        marks = self._marks()
        return [Block(text, linked, marks[n][6], marks[n][7], marks[n][:6]) for text, linked, n in self.raw]


def features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` a block."""
    linked, chars = {}, {}
    for b in blocks:
        linked[b.parent] = linked.get(b.parent, 0) + b.linked
        chars[b.parent] = chars.get(b.parent, 0) + len(b.text)
    rows = [
        (
            1.0, *b.mark, b.linked / len(b.text), linked[b.parent] / chars[b.parent], float(np.log1p(min(MOST_WORDS, b.text.count(" ")))), b.text[-1] in ".!?:\"”»",
            min(1.0, b.text.count(",") / 3), b.tag == "p", b.tag in _HEADINGS, b.tag in ("li", "dt", "dd"), b.tag in ("td", "th"),
        )
        for b in blocks
    ]
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Classifier weights, and smoothness across containers and within one."""

    weights: tuple[float, ...]
    across: float
    within: float
    #: No block is surer than this, so that enough neighbours outweigh any.
    surest: float = 8.0

    def scores(self, blocks: list[Block]) -> list[float]:
        x = features(blocks)
        scores = np.clip(x @ np.array(self.weights), -self.surest, self.surest)
        return np.where(x[:, FEATURES.index("never")] > 0, -self.surest, scores).tolist()  # hidden, or of an element that holds no main text

    def labels(self, blocks: list[Block]) -> list[bool]:
        return min_cut(self.scores(blocks), edges(blocks, self.across, self.within))


def edges(blocks: list[Block], across: float, within: float) -> list[tuple[int, int, float]]:
    """Neighbours, and a block with the last one of its container where others lie between."""
    out = [(i, i + 1, within if a.parent == b.parent else across) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i - last.get(b.parent, i) > 1:
            out.append((last[b.parent], i, within))
        last[b.parent] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut; ties go to boilerplate.

    A node whose own score outweighs all its edges is sure of its side, and settled first: its edges become
    capacity to a terminal of its neighbours. Maximum flow (shortest augmenting paths by layers) decides the rest.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, side = list(scores), [None] * n
    wait = deque(range(n))
    while wait:
        i = wait.popleft()
        if side[i] is None and abs(own[i]) > sum(near[i].values()) + 1e-12:
            side[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if side[i] else -w
                del near[j][i]
                wait.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if own[i] > 0 else (i, sink)
            room[a][b] = abs(own[i])
            room[b].setdefault(a, 0.0)
        while True:
            depth = {source: 0}
            line = deque([source])
            while line:
                i = line.popleft()
                for j, w in room[i].items():
                    if w > 1e-12 and j not in depth:
                        depth[j] = depth[i] + 1
                        line.append(j)
            if sink not in depth:
                break
            ways = {i: iter(list(room[i])) for i in depth}
            path = [source]
            while path:
                i = path[-1]
                if i == sink:
                    flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                    path = [source]
                    continue
                for j in ways[i]:
                    if room[i][j] > 1e-12 and depth.get(j) == depth[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()
        for i in rest:
            side[i] = i in depth
    return [bool(s) for s in side]


def main_text(page: str | None, model: Model | None = None) -> str:
    """The content blocks of a page, joined by one newline; empty if it has none."""
    if model is None:
        from marlstone.llm.html_training import fitted

        model = fitted()
    found = Page(page or "").blocks()
    return "\n".join(b.text for b, s in zip(found, model.labels(found), strict=True) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page has empty text. Unclosed elements, stray end tags and unterminated comments end where
    a browser would end them, at the latest with the page; pages may be of any length and are read whole, in time
    that grows with it. Ties of a cut go to boilerplate. Repeated rows stay; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    from marlstone.llm.html_training import fitted

    small_batches(pages.sparkSession)
    used = model or fitted()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, used) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": list(map(len, text))})

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
