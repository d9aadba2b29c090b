"""Main text of web pages by two-pass block rules.

A page becomes blocks: runs of text between block-level tags, with the number of characters inside links and the region
(article, a boilerplate container, or the page) they stand in.

Pass 1 decides blocks by themselves: boilerplate containers (menus, footers, sidebars, forms, notices, adverts, comments)
and link-dense blocks outside articles are bad; long blocks with a usual density of stop words are good; all others are
ambiguous. Names of classes and ids mark containers, unless the page's text speaks against it (the page is then read again
without the mark): a part of a longer name (``comments-open``) marks none that holds an article or main element or most of the
page's good text; a whole name (``search``, ``post tags``) marks none that is or holds the only article or main element with good
text and has most of it, nor one that has all of it, comments apart.
Pass 2: an ambiguous block takes the label of the nearest decided block before or after it (the nearer wins, a good one on
ties), looking no further than its own region; in a region without decided blocks it is good inside an article or main
element, or if the page has neither and nothing good, when it isn't linked text.

Defined cases: null html is empty; a page without main text gives the empty string; unclosed, misnested and cut tags are
read as far as they go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import map_arrow, sliced

# HTML's block-level elements, elements without text or end tag, and containers of boilerplate.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg iframe object canvas audio video head title".split())
BAD_TAGS = set("nav footer aside form menu select button textarea dialog fieldset".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notification popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations comment comments discussion"
    " disqus respond reply replies widget pagination pager toolbar search copyright masthead topbar skip tags alert alerts disclaimer cta trending popular".split()
)
OUTER_NAMES = {"header", "head", "top"}
#: Words that make ``sidebar`` the name of a layout with one.
LAYOUT_NAMES = {"has", "with", "content"}
#: Names of what readers write, which stays out even where it is all that a page has.
READER_NAMES = set("comment comments discussion disqus respond reply replies".split())
#: Stop words of six languages.
STOPS = set(
    "the of and to in is that it was for on are as with be this by from or an at not have has but which his her they we you a i"
    " de la le les et des du un une en dans que qui pour par sur est pas au avec ce il elle ne se plus"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er"
    " el los las y del que por con una su para no es al lo como más o pero sus"
    " il di che e è per non si da come con sono una della o os do em um para com não uma na".split()
)
LONG = 70
LINKED = 0.5
STOP_SHARE = 0.15
WORD = re.compile(r"[^\W\d_]+")
CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "linked", "region", "bad", "inside", "parts")

    def __init__(self, text: str, linked: int, region: int, bad: bool, inside: bool, parts: tuple[int, ...] = ()):
        self.text, self.linked, self.region, self.bad, self.inside = text, linked, region, bad, inside
        self.parts = parts  # containers that names mark


class Blocks(HTMLParser):
    """Blocks of a page in order."""

    def __init__(self, cleared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.cleared, self.count = cleared, 0  # start tags, by number, that names don't mark
        self.marked: set[int] = set()
        self.named: dict[int, bool] = {}  # marked by whole names: whether those of readers
        self.holds: set[int] = set()  # marked ones that hold, or are, an article or main element
        self.found: list[Block] = []
        self.open: list[tuple[str, bool, bool, int, tuple[int, ...]]] = []  # tag, boilerplate, inside an article, region, marks
        self.silent: list[str] = []
        self.parts: list[str] = []
        self.linked, self.in_link, self.regions = 0, False, 0

    def close_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, bad, inside, region, parts = self.open[-1] if self.open else ("", False, False, 0, ())
            self.found.append(Block(text, self.linked, region, bad, inside, parts))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent or tag in SILENT:
            if tag in SILENT and tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        elif tag in BLOCKS or tag in BAD_TAGS:
            self.close_block()
            self.in_link = False
            if tag in VOID:
                return
            while self.open and self.open[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag != "button":
                self.open.pop()  # a block ends an open paragraph
            _, bad, inside, region, parts = self.open[-1] if self.open else ("", False, False, 0, ())
            self.count += 1
            if tag in ("html", "body"):
                self.open.append((tag, bad, inside, region, parts))
                return
            given = {k: (v or "").lower() for k, v in attrs}
            given_names = (given.get("class", "") + " " + given.get("id", "")).split()
            names = set(re.split(r"[^a-z]+", " ".join(given_names)))
            if "sidebar" in names and names & LAYOUT_NAMES:
                names, given_names = names - BAD_NAMES, []
            outer = set() if inside else OUTER_NAMES
            free = self.count in self.cleared
            whole = not free and not (BAD_NAMES | outer).isdisjoint(given_names)
            main = tag in ("article", "main")
            if main:
                self.holds.update(parts)
            if main and (free or BAD_NAMES.isdisjoint(given_names)):
                if not bad:
                    inside = True
                    self.regions += 1
                    region = self.regions
            else:
                hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
                sure = tag in BAD_TAGS or hidden or (tag == "header" and not inside) or given.get("role", "") in BAD_ROLES
                part = not free and bool(names & (BAD_NAMES | outer))
                if sure:
                    parts = (*parts, -1)
                elif whole or part:
                    parts = (*parts, self.count)
                    if whole:
                        self.named[self.count] = not READER_NAMES.isdisjoint(given_names)
                    else:
                        self.marked.add(self.count)
                    if main:
                        self.holds.add(self.count)
                if not bad and (sure or whole or part):
                    bad = True
                    self.regions += 1
                    region = self.regions
            self.open.append((tag, bad, inside, region, parts))

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "a":
            self.in_link = False
        elif tag in BLOCKS or tag in BAD_TAGS:
            self.close_block()
            if any(o[0] == tag for o in self.open):
                while self.open.pop()[0] != tag:
                    pass

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in SILENT:
            if tag in VOID:
                self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    cleared: frozenset[int] = frozenset()
    while True:
        parser = Blocks(cleared)
        parser.feed(CUT_TAG.sub("", html))
        parser.close()
        parser.close_block()
        wrong = overruled(parser)
        if not wrong:
            return parser.found
        cleared |= wrong  # grows by tags of the page, so this ends


def overruled(parser: Blocks) -> set[int]:
    """Containers that names mark against the page's text."""
    if not parser.marked and not parser.named:
        return set()
    total, free, inner = 0, False, dict.fromkeys([*parser.marked, *parser.named], 0)
    for block in parser.found:
        if -1 not in block.parts and usual_text(block):
            names = [i for i in block.parts if i in parser.named]
            free |= block.inside and not block.bad
            total += 0 if names else len(block.text)
            for i in block.parts:
                if i in parser.named or not names:
                    inner[i] += len(block.text)
    out = {i for i in parser.marked if i in parser.holds or 2 * inner[i] > total}
    if not free:  # the largest of the wholly named ones against the text outside of them
        most = max((n for i, n in inner.items() if i in parser.named), default=0)
        for i, readers in parser.named.items():
            if inner[i] == most > total and (i in parser.holds and not total if readers else i in parser.holds or not total):
                out.add(i)
    return out


def usual_text(block: Block) -> bool:
    """Long, not linked, with a usual density of stop words."""
    if len(block.text) < LONG or block.linked > LINKED * len(block.text):
        return False
    words = WORD.findall(block.text.lower())
    return bool(words) and sum(w in STOPS for w in words) >= STOP_SHARE * len(words)


def first_pass(block: Block) -> bool | None:
    """True good, False bad, None ambiguous."""
    if block.bad:
        return False
    if block.linked > LINKED * len(block.text):
        return None if block.inside else False
    return True if usual_text(block) else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block of their region."""
    n = len(blocks)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            near[i] = last.get(blocks[i].region)
            if labels[i] is not None and not blocks[i].bad:
                last[blocks[i].region] = (i, labels[i])
    articles = any(b.inside for b in blocks)
    good = any(x for x in labels)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            sides = [(abs(i - s[0]), not s[1]) for s in (before[i], after[i]) if s]
            if blocks[i].inside and not any(not s[1] for s in sides):
                label = True  # only linked lines are decided near it: the article's own short text
            elif sides:
                label = not min(sides)[1]
            else:
                label = blocks[i].inside or not (articles or good)
        out.append(label)
    if articles:
        out = [x and b.inside for x, b in zip(out, blocks)]
    return out


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    kept = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.select("page_id").schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, f"page_id {kind}, url string, text string, n_chars long")
