"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text without a block-level tag
between, each with its root-to-leaf tag path. Text length and punctuation are
summed per path and divided by the number of blocks on it; both ratios are
smoothed along the page and fused to one score. Paths that score at least
the page's own threshold in the mean of their blocks are content; their blocks are the content nodes.

The elements that hold the content nodes' text are the article: all outermost ``article`` elements with any, else ``main``, else
the innermost container with nearly all of it. In an article or main every block stays, however short and whatever it links
to, unless it is chrome. In a container that no mark tells apart, blocks stay that score or lie between content nodes,
headings, and lists, tables and quotations that stand beside content nodes, unless they are link lists.

What is never an article (menus, adverts, reader comments) is chrome and scores 0. Tags say so for sure; forms
and class names do only of an element that holds less than half of what scores.

Elements are numbered and point to their parents, so a page costs time in proportion to its
length, however deep its tags nest and however broken they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Fixed values of HTML: elements without content, with raw content, inline elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table td th body html article section div".split())

#: Elements and name parts (of class, id and role) that aren't the article.
CHROME_TAGS = frozenset("head nav footer aside button menu dialog".split())
#: Elements that are chrome unless they hold the page, as class names make them.
FORM_TAGS = frozenset(("form", "fieldset"))
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead footer sidebar side aside widget complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay"
    " comment comments discussion disqus respond replies reply reader-comments share sharing social related recommended newsletter subscribe subscription signup login"
    " search pagination pager toolbar legal copyright disclaimer".split()
)
#: Parts that leave a compound name what its other parts say: "comments-area" names comments, "search-results" doesn't name a search box.
LAYOUT_NAMES = frozenset("area bar block bottom box buttons column container fixed form global icons inner item items left links list main outer page primary right row secondary section site sticky title top wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no name makes chrome.
NEVER_NAMED = MAIN_TAGS | {"html", "body"}
CONTAINERS = frozenset("html body article main section div td table tbody tr center".split())
#: Elements whose items belong to the text beside which they stand.
GROUPS = frozenset("ul ol dl table blockquote figure pre".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

#: Element of a start tag's attributes up to its end, quotes respected.
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SENTENCE = re.compile(r"[.!?…。！？]")
#: Threshold of content nodes, in mean scores; what blocks next to them need of it; least share of the
#: content's text that an article or main, or another element, holds; least share of links that makes a block a link list.
CONTENT, BESIDE = 0.5, 0.1
ARTICLE_SHARE, CONTAINER_SHARE, LINK_SHARE = 0.5, 0.9, 0.6


class Page:
    """Elements (arrays by number; 0 is the page itself) and the blocks of text in them."""

    def __init__(self):
        self.tag, self.parent, self.path = [""], [0], [0]
        self.chrome, self.main, self.named = [False], [False], [0]
        self.named_parent = {}  # element that is chrome by name -> the next one above, or 0
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []

    def add(self, tag: str, parent: int, attributes: str, block: bool) -> int:
        at = len(self.tag)
        main = self.main[parent] or tag in MAIN_TAGS
        chrome, named = chrome_of(tag, attributes, main)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1) if block else self.path[parent])
        self.chrome.append(self.chrome[parent] or chrome)
        self.main.append(main)
        self.named.append(at if named else self.named[parent])
        if named:
            self.named_parent[at] = self.named[parent]
        return at


class Block:
    __slots__ = ("chrome", "element", "linked", "named", "path", "pieces", "tag", "text")

    def __init__(self, page: Page, element: int, inner: int):
        self.element, self.path, self.tag = element, page.path[element], page.tag[element]
        self.chrome, self.named = page.chrome[inner], page.named[inner]
        self.pieces: list[str] = []
        self.linked: list[str] = []

    @property
    def own(self) -> int:
        """Characters that count for the ratios: a link's only if the block reads as a sentence."""
        return len(self.text) if self.linked < LINK_SHARE * len(self.text) or SENTENCE.search(self.text) else len(self.text) - self.linked

    @property
    def link_list(self) -> bool:
        return self.own < (1 - LINK_SHARE) * len(self.text) or self.own == 0


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def is_chrome_name(word: str) -> bool:
    """Whether one class, id or role names what isn't the article: all of its parts must say so, layout words aside."""
    if word in CHROME_NAMES:
        return True
    parts = {x for x in re.split(r"[\W\d_]+", word) if x}
    return not CHROME_NAMES.isdisjoint(parts) and parts <= CHROME_NAMES | LAYOUT_NAMES


def chrome_of(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element isn't the article by its tag or the attribute hidden, and whether by a name."""
    if tag in CHROME_TAGS or tag == "header" and not in_main:
        return True, False
    if not attributes:
        return False, tag in FORM_TAGS
    found = attributes_of(attributes)
    names = [] if tag in NEVER_NAMED else [w for k in ("class", "id", "role") for w in found.get(k, "").lower().split()]
    return "hidden" in found, tag in FORM_TAGS or any(map(is_chrome_name, names))


class Open:
    """The open elements: a stack, where each tag stands in it, and its topmost block-level element."""

    def __init__(self):
        self.elements, self.tags, self.at, self.blocks, self.links = [0], [""], defaultdict(list), [0], 0

    def push(self, element: int, tag: str, block: bool) -> None:
        self.at[tag].append(len(self.tags))
        if block:
            self.blocks.append(len(self.tags))
        self.elements.append(element)
        self.tags.append(tag)
        self.links += tag == "a"

    def cut(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.elements.pop()
            self.at[tag].pop()
            self.links -= tag == "a"
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else 0

    def close(self, tag: str) -> None:
        depth = self.last(tag)
        if depth and (tag not in INLINE or depth > self.blocks[-1]):  # an inline end tag doesn't close blocks
            self.cut(depth)

    def begin(self, tag: str) -> None:
        """Closes what a block-level start tag ends: an open paragraph, and some end their like."""
        if self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            like = CLOSES[tag]
            scope = max(map(self.last, SCOPES - {"td", "th"}))
            if tag in ("tr", "thead", "tbody", "tfoot"):
                found = [p[bisect_right(p, scope)] for t in like if (p := self.at.get(t)) and p[-1] > scope]
                if found:
                    self.cut(min(found))
            else:
                depth = max(map(self.last, like))
                if depth > scope:
                    self.cut(depth)


def parse(html: str) -> Page:
    page, stack = Page(), Open()
    current: Block | None = None
    at, size, last_end, quotes = 0, len(html), html.rfind(">"), True

    def text(part: str) -> None:
        nonlocal current
        if current is None:
            if part.isspace():
                return
            current = Block(page, stack.elements[stack.blocks[-1]], stack.elements[-1])
            page.blocks.append(current)
        current.pieces.append(part)
        if stack.links:
            current.linked.append(part)

    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        if begin > at:
            text(html[at:begin])
        at = begin
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(html, at)
        if m is None and html[at + 1 : at + 2] not in ("!", "?", "/") or at > last_end:
            text("<")
            at += 1
            continue
        if m is None:  # a declaration, or an end tag of no name
            at = html.find(">", at) + 1
            continue
        tag, rest = m[2].lower(), m.end()
        end = ATTRIBUTES.match(html, rest) if quotes else None
        if end is None:  # quotes that don't close mean nothing from here on
            quotes = False
            at = html.find(">", rest) + 1
        else:
            at = end.end()
        attributes = html[rest : at - 1]
        if m[1]:
            if tag == "br" and current:
                current.pieces.append(" ")
            stack.close(tag)
            if tag not in INLINE:
                current = None
            continue
        if tag in RAW:
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                at = size if end is None or end.end() > last_end else html.find(">", end.end()) + 1
            continue
        if tag in VOID:
            if tag not in INLINE:
                current = None
            elif current:
                current.pieces.append(" ")
            continue
        if tag in INLINE:
            if attributes or tag == "a":
                stack.push(page.add(tag, stack.elements[-1], attributes, False), tag, False)
            else:
                stack.push(stack.elements[-1], tag, False)
            continue
        current = None
        stack.begin(tag)
        stack.push(page.add(tag, stack.elements[-1], attributes, True), tag, True)
    kept = []
    for b in page.blocks:
        b.text = " ".join(unescape("".join(b.pieces)).split())
        if b.text:
            b.linked = len(" ".join(unescape("".join(b.linked)).split()))
            kept.append(b)
    page.blocks = kept
    return page


def path_scores(found: list[Block]) -> list[float]:
    """Fused tag-path ratio of each block, smoothed along the page; chrome scores 0 and smooths nothing."""
    length, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        length[b.path] += b.own
        marks[b.path] += len(PUNCTUATION.findall(b.text)) if b.own else 0
        nodes[b.path] += 1
    text = [length[b.path] / nodes[b.path] for b in found]
    punctuation = [marks[b.path] / nodes[b.path] for b in found]
    weights = [math.exp(-2.0 * k * k) for k in (-1, 0, 1)]

    def smooth(x: list[float]) -> list[float]:
        out = []
        for i in range(len(x)):
            near = [(weights[k + 1], x[i + k]) for k in (-1, 0, 1) if 0 <= i + k < len(x) and not found[i + k].chrome]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near) if near else 0.0)
        return out

    return [0.0 if b.chrome else t * (1 + p) for b, t, p in zip(found, smooth(text), smooth(punctuation), strict=True)]


def content_nodes(found: list[Block]) -> tuple[list[float], float, list[bool]]:
    """Scores, threshold, and which blocks are content nodes: those on paths whose blocks reach the threshold in the mean."""
    score = path_scores(found)
    scored = [s for s in score if s > 0]
    threshold = CONTENT * sum(scored) / len(scored) if scored else math.inf
    total, nodes = defaultdict(float), defaultdict(int)
    for b, s in zip(found, score, strict=True):
        if s > 0:
            total[b.path] += s
            nodes[b.path] += 1
    return score, threshold, [s > 0 and total[b.path] >= threshold * nodes[b.path] for b, s in zip(found, score, strict=True)]


def judge_names(page: Page) -> None:
    """Makes blocks chrome that lie in elements which are so by name, except elements that hold most of the page's content.
    An element beside an article or main with any text that scores gets no such exception."""
    found = page.blocks
    if not any(b.named for b in found):
        return
    score, _, content = content_nodes(found)
    total = in_main = 0
    held, held_main = defaultdict(int), defaultdict(int)
    for b, s, c in zip(found, score, content, strict=True):
        if c:
            total += b.own
            held[b.named] += b.own
        if s > 0 and page.main[b.element]:
            in_main += 1
            held_main[b.named] += 1
    for e in sorted(page.named_parent, reverse=True):
        held[page.named_parent[e]] += held[e]
        held_main[page.named_parent[e]] += held_main[e]
    kept = {0: True}
    for e in sorted(page.named_parent):
        kept[e] = kept[page.named_parent[e]] and 2 * held[e] > total and held_main[e] == in_main
    for b in found:
        b.chrome = b.chrome or not kept[b.named]


def article_of(page: Page, content: list[bool]) -> list[int]:
    """The outermost articles with content nodes, if they hold enough of the content's text; else the innermost main with enough, or container with nearly all of it."""
    n = len(page.tag)
    weight, depth, outer = [0] * n, [0] * n, [0] * n
    for b, c in zip(page.blocks, content, strict=True):
        if c:
            weight[b.element] += len(b.text)
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    for e in range(1, n):
        depth[e] = depth[page.parent[e]] + 1
        outer[e] = outer[page.parent[e]] or (e if page.tag[e] == "article" else 0)
    articles = [e for e in range(1, n) if outer[e] == e and weight[e]]
    if articles and sum(weight[e] for e in articles) >= ARTICLE_SHARE * weight[0]:
        return articles
    for tags, share in ((("main",), ARTICLE_SHARE), (CONTAINERS, CONTAINER_SHARE)):
        held = [e for e in range(1, n) if page.tag[e] in tags and weight[e] >= max(1, share * weight[0])]
        if held:
            return [max(held, key=lambda e: (depth[e], weight[e], -e))]
    return [0]


def beside_content(page: Page, content: list[bool]) -> list[bool]:
    """Per block whether it is an item of a list, table or quotation that stands beside content nodes."""
    direct = {page.parent[b.element] for b, c in zip(page.blocks, content, strict=True) if c} | {b.element for b, c in zip(page.blocks, content, strict=True) if c}
    good = [False] * len(page.tag)  # elements of a group, whose parent holds content nodes
    for e in range(1, len(page.tag)):
        good[e] = page.tag[e] in GROUPS and (good[page.parent[e]] or page.parent[e] in direct) or good[page.parent[e]]
    return [good[b.element] for b in page.blocks]


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty if there is none. A page may be of any length and depth, and may break off anywhere."""
    page = parse(html or "")
    judge_names(page)
    found = page.blocks
    score, threshold, content = content_nodes(found)
    if not any(content):
        return ""
    roots = article_of(page, content)
    inside = [False] * len(page.tag)
    for e in roots:
        inside[e] = True
    for e in range(1, len(page.tag)):
        inside[e] = inside[e] or inside[page.parent[e]]
    within = [inside[b.element] and not b.chrome for b in found]
    if page.tag[roots[0]] in MAIN_TAGS:
        return "\n".join(b.text for b, w in zip(found, within, strict=True) if w)
    nodes = [i for i in range(len(found)) if content[i] and within[i]]
    if not nodes:
        return ""
    first, last, beside = nodes[0], nodes[-1], beside_content(page, content)
    keep = []
    for i, b in enumerate(found):
        if within[i] and (content[i] or not b.link_list and (first < i < last or beside[i] or b.tag in HEADINGS or score[i] >= BESIDE * threshold)):
            keep.append(i)
    if not any(found[i].tag == "h1" for i in keep):  # the title may stand before the container
        keep[:0] = [i for i in range(first) if found[i].tag == "h1" and not found[i].chrome and not within[i]][-1:]
    return "\n".join(found[i].text for i in keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row. A null or empty page has an empty text;
    repeated rows are extracted separately; other columns are not read. Several articles of a page are one text. What no element or name tells from
    the article is lost only where the page marks no article and its path scores too little."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(each, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
