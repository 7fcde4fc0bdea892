"""HTML extraction: minimum-cut labelling of a page's blocks.

A page is read as blocks: runs of text between tags of block elements. A classifier gives each block the log-odds of being
article text from its element, the elements around it, names in class and id, its links and its length. Log-odds become
terminal capacities: what it costs to call a block boilerplate (from the source) or content (to the sink). Neighbouring
blocks, and siblings below one element, are joined by edges whose capacity falls with their distance in the tree. The
minimum cut, found by maximum flow, separates content from boilerplate.

The classifier's odds are set by hand, from what elements and names mean; there are no labelled pages to fit them on. What speaks
against an element starts anew below it: however good the element stands that a comment, an advert or a form is in, and whatever
element or name stands inside, that subtree begins below zero. A name counts by the words it is made of (`comment-list`), but
not where these tell of a state (`comments-open`, `has-sidebar`, `ad-free`). On an article, and on elements that hold most
of the page's text, only whole names count against (`comment`, not `related-content`), as others tell of what else the page has; so does a form.

Defined cases: null, empty and textless pages give an empty text; markup that is never closed ends with the page, but for
buttons and the like, whose start tag is then skipped; repeated
rows each get their text; an empty table gives an empty result; other columns stay. Nothing of a content block is cut off.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, small_batches, strings

#: A tag ends at > or, unfinished, before the next < or at the end. No part can be read in two ways, so the time is linear.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style template iframe svg canvas audio video select button textarea title head annotation annotation-xml".split())
#: Of these, those whose content is no markup: without an end tag they go on to the end of the page. Others then count as absent.
RAW = frozenset("script style iframe textarea title".split())
#: Elements with text for readers without what they show; it counts inside an article only.
FALLBACK = frozenset(("noscript", "object"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag closes first.
CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")} | {t: ("p",) for t in BLOCKS - {"p", "li", "dd", "dt", "td", "th", "tr", "body", "html"}}
#: Names in class, id and role that speak against and for content.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar comment comments commentlist reply replies "
    "respond discussion disqus pagination pager widget copyright skip search complementary contentinfo dialog".split()
)
FOR = frozenset("article content main post entry story body text".split())
#: Elements around the whole page or all its content, whose names tell of its layout and so don't speak against it.
WHOLE = frozenset(("html", "body", "main"))
#: Words that, just before or just after a name, make it the state of something else.
BEFORE = frozenset("has have no not with without can supports".split())
AFTER = frozenset("open opened closed enabled disabled required free allowed active inactive on off visible shown".split())
#: An element with a larger share of the page's text holds the article, whatever its name is made of.
MOST = 0.6
#: A header of an article (inside one, or named so) is no header of the page.
HEADERS = frozenset(("header", "masthead"))
#: Elements below so many others are taken as children of the last of these.
DEEPEST = 512
FORBIDDING = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0}
OWN = {"p": 1.0, "h1": 1.0, "h2": 0.7, "h3": 0.5, "blockquote": 0.7, "pre": 0.7, "li": -0.3, "td": -0.3, "th": -0.3, "dt": -0.3, "dd": 0.0}
NEIGHBOUR, SIBLING = 0.8, 0.6


def _against(words: list[str]) -> bool:
    """The name has a word that speaks against content and isn't a state."""
    return any(w in AGAINST and (i == 0 or words[i - 1] not in BEFORE) and (i + 1 == len(words) or words[i + 1] not in AFTER) for i, w in enumerate(words))


def around(tag: str, attributes: str, inside: bool, most: bool) -> tuple[float, bool]:
    """What an element adds to the log-odds of all below it, and whether that starts anew below zero. inside: it stands in an article; most: it
    holds most of the page's text."""
    v, anew = (0.0, False) if tag == "form" and most else (FORBIDDING.get(tag, 0.0), tag in FORBIDDING)
    if tag == "header":
        v, anew = (-2.0, False) if inside else (-9.0, True)
    elif tag in ("article", "main"):
        v = 4.0
    good = bad = False
    if attributes and not attributes.isspace():
        for k, a, b, c in _ATTRIBUTE.findall(attributes):
            k, value = k.lower(), a or b or c
            if k in ("class", "id", "role", "itemprop"):
                for one in value.split():
                    words = [x.lower() for x in _NAME.findall(one)]
                    good = good or not FOR.isdisjoint(words)
                    if inside or not FOR.isdisjoint(words):
                        words = [w for w in words if w not in HEADERS]
                    if tag not in WHOLE and (len(words) == 1 or not most and tag != "article"):
                        bad = bad or _against(words)
            elif k == "hidden" or k == "aria-hidden" and value == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                v, anew = min(v, -9.0), True
    if bad:
        return min(v, 0.0) - 7.0, True
    return (v, True) if anew else (v + 1.5 if good and tag not in ("body", "html") else v, False)


class Block:
    __slots__ = ("element", "linked", "odds", "path", "tag", "text")

    def __init__(self, text: str, tag: str, path: tuple[int, ...], element: int, linked: int):
        self.text, self.tag, self.path, self.element, self.linked = text, tag, path, element, linked
        self.odds = 0.0

    def judge(self, context: float) -> None:
        words = self.text.count(" ") + 1
        share = min(1.0, self.linked / max(1, len(self.text)))
        self.odds = max(-12.0, min(12.0, context + OWN.get(self.tag, 0.0) + 0.5 * (min(math.log2(1 + words), 7.0) - 3.0) - 4.0 * share + (0.4 if self.text[-1] in ".!?:;…\"”" else 0.0)))


def contexts(out: list[Block], elements: list[tuple[int, str, str, bool]]) -> list[float]:
    """Log-odds below each element. elements: parent (which comes first), name, attributes, in an article."""
    size = [0] * len(elements)
    for b in out:
        size[b.element] += len(b.text)
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i][0]] += size[i]
    odds, below = [0.0] * len(elements), [False] * len(elements)
    for i, (parent, tag, attributes, inside) in enumerate(elements[1:], 1):
        v, anew = around(tag, attributes, inside, size[i] > MOST * size[0])
        below[i] = below[parent] or anew
        if anew:
            odds[i] = max(-20.0, min(odds[parent], 0.0) + v)
        else:
            odds[i] = max(-20.0, min(6.0, odds[parent] + (min(v, 0.0) if below[parent] else v)))
    return odds


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    elements: list[tuple[int, str, str, bool]] = [(0, "", "", False)]
    stack: list[tuple[str, int, bool, tuple[int, ...]]] = [("", 0, False, (0,))]  # name, element, in an article, path
    parts: list[str] = []
    linked = depth_a = 0
    serial = at = 0
    n = len(page)
    unclosed: set[str] = set()  # elements without an end tag further on

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, element, _, path = stack[-1]
                out.append(Block(text, tag, path, element, linked))
            parts.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if depth_a:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(1) == "/"
        if name in DROPPED or name in FALLBACK and not stack[-1][2]:
            if not closing and not m.group(3).endswith("/"):
                close = None if name in unclosed else re.compile(rf"<(/?){name}(?![\w-])[^>]*>?", re.I).search(page, at)
                if name in RAW or close and not close.group(1) and name not in ("button", "select", "head"):  # raw text, or one in another
                    close = None if name in unclosed else re.compile(rf"</{name}(?![\w-])[^>]*>?", re.I).search(page, at)
                if not close:
                    unclosed.add(name)
                    at = n if name in RAW else at
                elif close.group(0).startswith("</"):
                    at = close.end()
            continue
        if name == "a":
            depth_a = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in VOID:
                closes = CLOSES.get(name, ())
                while closes and stack[-1][0] in closes:
                    stack.pop()
                serial += 1
                _, parent, inside, path = stack[-1]
                if len(stack) <= DEEPEST:
                    path = (*path, serial)
                elif len(stack) > 4 * DEEPEST:  # far deeper than any page: not kept open
                    continue
                elements.append((parent, name, m.group(3), inside))
                stack.append((name, len(elements) - 1, inside or name in ("article", "main"), path))
    flush()
    odds = contexts(out, elements)
    for x in out:
        x.judge(odds[x.element])
    return out


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def content(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut. odds > 0: what is left to the source of a block's terminal capacities once the flow
    straight through it is taken (ln(1+e^s) - ln(1+e^-s) = s); edges hold in both directions."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(i: int, j: int, forth: float, back: float) -> None:
        out[i].append(len(to)), to.append(j), cap.append(forth)
        out[j].append(len(to)), to.append(i), cap.append(back)

    for i, s in enumerate(odds):
        if s > 0:
            edge(source, i, s, 0.0)
        elif s < 0:
            edge(i, sink, -s, 0.0)
    for i, j, w in edges:
        edge(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for k in out[i]:
                if cap[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        while True:  # a blocking flow, path by path
            path: list[int] = []
            i = source
            while i != sink:
                while place[i] < len(out[i]):
                    k = out[i][place[i]]
                    if cap[k] > tiny and level[to[k]] == level[i] + 1:
                        break
                    place[i] += 1
                if place[i] < len(out[i]):
                    path.append(out[i][place[i]])
                    i = to[path[-1]]
                elif not path:
                    break
                else:
                    i = to[path.pop() ^ 1]
                    place[i] += 1
            if i != sink:
                break
            least = min(cap[k] for k in path)
            for k in path:
                cap[k] -= least
                cap[k ^ 1] += least


def labelled(page: str) -> list[tuple[str, bool]]:
    """Text and label (content) of every block."""
    b = blocks(page)
    edges = [(i, i + 1, NEIGHBOUR / (1 + distance(b[i].path, b[i + 1].path) / 2)) for i in range(len(b) - 1)]
    last: dict[int, int] = {}
    for i, x in enumerate(b):  # siblings: blocks whose elements stand below one element
        if len(x.path) < 2:
            continue
        k = x.path[-2]
        if k in last and last[k] != i - 1:
            edges.append((last[k], i, SIBLING))
        last[k] = i
    return list(zip([x.text for x in b], content([x.odds for x in b], edges), strict=True))


def extract_text(page: str) -> str:
    return "\n".join(t for t, ok in labelled(page) if ok)


def extract(df: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each page, without the column of the page. A column with the output's name is replaced."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in (out.lower(), source.lower())]
    src = df.select(*keep, F.col(source).cast("string").alias(fresh(df, "_page", out)[0]))
    schema = src.select(*keep).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([extract_text(p) for p in strings(b.column(b.num_columns - 1))], pa.string())], names=[*keep, out])

    return src.mapInArrow(run, schema)
