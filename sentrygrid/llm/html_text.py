"""Main text of web pages by two passes of block rules (operator 12).

Markup is read into blocks: runs of text between the tags that end a line, each with its length, its share of text in
links, its share of stop words, and the elements that it lies in.

Pass one decides what it can.  Blocks of menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments, by
element, role or the words of class and id, are bad; so are blocks full of links.  Blocks of an article element
are good.  Elsewhere long blocks with many stop words are good, long ones with links and few stop words are bad, and blocks
that are short or have a middling share stay open.

Pass two: an open block takes the label of the nearest decided one, where blocks of its own container are nearer than
others; headings look to what follows.  At equal distance a middling block is good and a short one bad.  On a page where
nothing is decided, open blocks are the text.

Character references are decoded, white space within a block (of Unicode) becomes one space, and blocks that are good are
joined by line feeds in page order.  One line break is white space, two end a block.

A page is one row, read in one pass in time linear in its length, whole.  Defined results: null and empty pages and pages
without text have the empty text; broken markup is read leniently (an unclosed tag or comment goes to the end, an unclosed
script hides the rest); repeated rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrygrid.llm.common import slices

#: Frequent function words of the languages that are expected; another list can be given.
STOP_WORDS = frozenset("""
the of and to in is that it for was on are as with his they at be this have from or had by but not what all were we when your can there which their if will each about how
de la le les et des en un une du que qui dans pour pas sur au avec ce il elle est sont par plus ne se son sa ses nous vous leur mais
der die das und ist nicht ein eine zu den von mit sich des auf im dem auch es an werden aus er hat dass sie nach wird bei wie oder
el los las y del se por con una su para es al lo como pero sus ha o este si porque esta entre cuando muy sin sobre
""".split())
#: Shares of link text above which blocks are bad, outside and inside articles; characters of long blocks; shares of stop words.
LINKS, ARTICLE_LINKS, LONG, FEW, MANY = 0.2, 0.5, 80, 0.05, 0.15

SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video select button textarea datalist".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINE = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same kind, or of the listed kinds, closes.
CLOSED_BY = {"p": LINE - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: Elements and roles of boilerplate and of the article; a header within an article belongs to it.
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of class and id.
BAD_WORDS = frozenset("""ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager skip toc topbar toolbar masthead footer foot bottom copyright colophon legal
sidebar aside rail widget widgets related recommended recommendations popular trending teaser
notice notices alert cookie cookies consent gdpr popup modal overlay paywall
comment comments commentlist disqus respond reply replies discussion
share sharing social follow newsletter subscribe subscription signup login search form""".split())
ARTICLE_WORDS = frozenset("article articlebody story post entry postbody".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: float  # share of the text in links
    heading: bool
    container: int  # number of the element that holds it
    inside: str  # "bad", "article" or ""
    label: str = ""

    def stops(self, stop_words: frozenset[str]) -> float:
        """The share of stop words."""
        words = _LETTERS.findall(self.text.lower())
        return sum(w in stop_words for w in words) / len(words) if words else 0.0


@dataclass
class _Element:
    name: str
    number: int
    inside: str
    hidden: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("", 0, "", False)])
    parts: list[tuple[str, bool]] = field(default_factory=list)
    heights: dict[str, list[int]] = field(default_factory=dict)  # of the open elements of a name; "" for those of LINE
    numbers: int = 0
    link: int = 0  # height of the stack where the open link began
    breaks: int = 0

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].hidden:
            self.breaks = self.breaks if raw.isspace() else 0
            self.parts.append((unescape(raw) if "&" in raw else raw, bool(self.link)))

    def end_block(self) -> None:
        parts, self.parts, self.breaks = self.parts, [], 0
        text = " ".join("".join(p for p, _ in parts).split())
        if not text:
            return
        linked = sum(len("".join(p.split())) for p, link in parts if link)
        top = self.stack[-1]
        heading = any(e.name in HEADINGS for e in self.stack[-2:])
        holder = next(e.number for e in reversed(self.stack) if e.name not in HEADINGS and e.name != "p")
        self.blocks.append(Block(text, linked / len("".join(text.split())) if linked else 0.0, heading, holder, top.inside))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            elif not self.stack[-1].hidden:
                self.parts.append((" ", False))
            return
        if name == "a":
            self.link = len(self.stack)
            return
        if name in LINE:
            self.end_block()
            for i in range(len(self.stack) - 1, max(0, len(self.stack) - 8), -1):
                e = self.stack[i].name
                if name in CLOSED_BY.get(e, ()):
                    self._cut(i)
                    break
                if e not in ("p", "li", "dt", "dd", "td", "th", *HEADINGS) or e == "li":
                    break
        above = self.stack[-1]
        if name in VOID or name not in LINE and name not in SKIPPED and name != above.name and not attributes:
            return
        inside, hidden = above.inside, above.hidden or name in SKIPPED
        if inside != "bad":
            found = _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ()
            values = {k.lower(): a or b or c for k, a, b, c in found}
            role = values.get("role", "").lower()
            words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(values.get(k, ""))}
            words = set() if words & {"has", "with", "no", "without"} else words  # what a wrapper has, not what it is
            hidden = hidden or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
            if name == "article" or name == "main" or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody":
                inside = "article" if not words & BAD_WORDS or name == "main" else "bad"
            elif name in BAD_ELEMENTS or role in BAD_ROLES or words & BAD_WORDS and name not in ("body", "html"):
                inside = "bad"
            elif (name == "header" or "header" in words) and inside != "article":
                inside = "bad"
            elif words & ARTICLE_WORDS and name not in ("body", "html"):
                inside = "article"
        if name in LINE or name in SKIPPED or name == above.name or hidden != above.hidden or inside != above.inside:
            if name not in LINE and inside != above.inside:
                self.end_block()
            self.numbers += 1
            for kind in (name, "") if name in LINE else (name,):
                self.heights.setdefault(kind, []).append(len(self.stack))
            self.stack.append(_Element(name, self.numbers, inside, hidden))

    def _cut(self, i: int) -> None:
        while len(self.stack) > i:
            name = self.stack.pop().name
            for kind in (name, "") if name in LINE else (name,):
                self.heights[kind].pop()
        if self.link > len(self.stack):
            self.link = 0

    def end(self, name: str) -> None:
        if name == "a":
            self.link = 0
            return
        if name in LINE:
            self.end_block()
        open_at, lines = self.heights.get(name), self.heights.get("")
        if not open_at or name not in LINE and lines and lines[-1] > open_at[-1]:
            return  # an inline end tag does not close what it lies in
        if self.stack[-1].inside != self.stack[open_at[-1] - 1].inside:
            self.end_block()
        self._cut(open_at[-1])


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page, hidden ones left out."""
    r, at, n = _Reader(), 0, len(html)
    lower: str | None = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            r.text(html[at:])
            break
        tag = _TAG.match(html, lt)
        if tag:
            r.text(html[at:lt])
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                r.end(name)
                continue
            if name in RAW and not tag[3].endswith("/"):
                if lower is None:
                    lower = html.lower() if len(html.lower()) == n else html
                close = lower.find("</" + name, at)
                while close >= 0 and (tail := lower[close + 2 + len(name) : close + 3 + len(name)]) and tail not in " \t\n\f\r/>":
                    close = lower.find("</" + name, close + 2)
                if close < 0:
                    break
                at = close
            r.start(name, tag[3])
            if name in SKIPPED and tag[3].endswith("/"):
                r.end(name)
            if name in RAW and name not in SKIPPED:  # a title outside the head, as in drawings
                r.start("template", "")
                r.end("template")
        elif html.startswith("<!--", lt):
            r.text(html[at:lt])
            close = html.find("-->", lt + 2)
            at = n if close < 0 else close + 3
        elif lt + 1 < n and (html[lt + 1] in "!?" or html[lt + 1] == "/" or html[lt + 1].isascii() and html[lt + 1].isalpha()):
            r.text(html[at:lt])
            close = html.find(">", lt)
            at = n if close < 0 else close + 1
        else:
            r.text(html[at : lt + 1])
            at = lt + 1
    r.end_block()
    return r.blocks


def _first_label(b: Block, stop_words: frozenset[str]) -> str:
    if b.inside == "bad":
        return "bad"
    if b.inside == "article":
        return "bad" if b.links > ARTICLE_LINKS else "good"
    if b.links > LINKS or "\N{COPYRIGHT SIGN}" in b.text:
        return "bad"
    if len(b.text) < LONG:
        return "short"
    share = b.stops(stop_words)
    return "good" if share >= MANY else "middling" if share >= FEW or not b.links else "bad"


def label_blocks(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """Set the labels of both passes."""
    first = [_first_label(b, stop_words) for b in blocks]
    n = len(blocks)

    def nearest(order: range) -> list[int]:
        last, out = -1, [-1] * n
        for i in order:
            out[i] = last
            last = i if first[i] in ("good", "bad") else last
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            b.label = first[i]
            continue
        around = []
        for j in (before[i], after[i]):
            if j >= 0:
                far = abs(i - j) + (0 if blocks[j].container == b.container else n)
                around.append((0 if b.heading and j > i else 1 if b.heading else 0, far, first[j] if first[i] == "middling" else {"bad": "0", "good": "1"}[first[j]]))
        if not around:
            b.label = "good"
        elif first[i] == "middling":
            b.label = max((-h, -far, label) for h, far, label in around)[2]  # at equal distance "good" > "bad"
        else:
            b.label = "good" if min(around)[2] == "1" else "bad"
    return blocks


def main_text(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    return "\n".join(b.text for b in label_blocks(read_blocks(html or ""), stop_words) if b.label == "good")


# ---------------------------------------------------------------- tables
def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))


def extract(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row a page: page_id, url, its main text and the text's code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [main_text(h.as_py(), stop_words) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = _pages(pages)
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


BLOCKS = "block int, label string, text string, link_share double, stop_share double, heading boolean"


def blocks(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row a block, bad ones too, with what the rules saw."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", *(x.split()[0] for x in BLOCKS.split(", "))]
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                kind = part.column("page_id").type
                rows = [(p, i, b.label, b.text, b.links, b.stops(stop_words), b.heading) for p, h in zip(part.column("page_id").to_pylist(), part.column("html"), strict=True) for i, b in enumerate(label_blocks(read_blocks(h.as_py()), stop_words))]
                types = [kind, pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)

    source = _pages(pages)
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, {BLOCKS}")
