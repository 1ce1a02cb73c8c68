"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as _entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MISC = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
_TAG = r"<(?P<end{0}>/?)(?P<tag{0}>[a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_MISC + "|" + _TAG.format("") + r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>" + "|" + _TAG.format("2"), re.S)
#: Where a quote is never closed, that tag and all after it end at the next bracket.
_LOOSE = re.compile(_MISC + "|" + _TAG.format("") + r"(?P<attrs>[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_CLASS = re.compile(r"(?<![a-zA-Z-])class\s*+=\s*+[\"']?([^\s\"'>]++)", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_PUNCTUATION = re.compile(r"[,.;:!?¿¡…。，、；：！？]")

# Element names of HTML by the role they play here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary header footer nav aside form fieldset hr head center menu dialog".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROPPED = frozenset("head nav footer aside form fieldset button select option menu dialog noscript template svg canvas object audio video map datalist".split())
_NEVER_BY_NAME = frozenset("html body main article".split())
#: Elements that part a page into regions; all other blocks are the flow of text inside one.
_SECTION = frozenset("main article section div details header center td".split())
_UNIT = frozenset("main article".split())
# An opening tag on the left ends the nearest open element of the middle that isn't outside one on the right.
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table",))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr"), ("table",))),
}
_SCOPE = frozenset("html body main article section div ul ol dl table blockquote td th figure details header footer nav aside form".split())
# Words in class, id or role that mark what isn't the article wherever they stand in a name.
_BAD = frozenset("ads adbox adslot advert adverts advertisement advertising adsense sponsored nav navbar navigation breadcrumb breadcrumbs sidebar sidebars cookie cookies gdpr comments commentlist disqus pagination".split())
# Words that do so alone, or beside words that say nothing: a search box isn't the article, search results may be.
_BAD_ALONE = frozenset(
    "ad sponsor sponsors promo promotion banner banners menu menubar submenu rail complementary header masthead topbar toolbar footer contentinfo colophon "
    "copyright comment reply replies respond consent notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login pager skip hidden".split()
)
# Words that an article's own parts have, too: of those the scores decide.
_PERHAPS = frozenset("legal share sharing social related recommended recommendations search widget widgets".split())
_SAYS_NOTHING = frozenset(
    "site page main global block box wrapper wrap container list section area bar inner outer top bottom left right col column module panel group item items "
    "links link buttons button icons media posts post articles stories news this to form field body text title content slot unit the a of and".split()
)
_NEUTRAL_FIRST = frozenset("has with no is js not without".split())
_ARTICLE_NAMES = frozenset("article entry post content story".split())
# Headings above readers' comments.
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?", re.I)

#: A region outside the article's own stays if its score is this share of the page's mean score or more.
ELSEWHERE = 1 / 4
#: The same for a path within the article's region, and for one in a marked article's nested regions, or in another of several marked articles.
WITHIN, NESTED = 1 / 50, 1 / 8
#: The same for a region whose name is that of other things as often as not: both its path and itself have to be that good.
PERHAPS = 1 / 2


@dataclass(slots=True)
class Frame:
    """An open element, and what it has from those above it."""

    tag: str
    dropped: bool = False
    soft: int = 0  # 1: named as what may be other than the article; 2: as what is
    path: int = 0
    region: int = 0
    unit: int = 0
    links: int = 0
    heading: bool = False
    in_header: bool = False
    in_table: bool = False


@dataclass(slots=True)
class Block:
    """A text block: its path of block-level tags, the element that parts regions and the marked article it is in, and whether it stands right in that article."""

    text: str
    link_chars: int
    path: int
    region: int
    unit: int
    own: bool
    heading: bool
    soft: int
    in_table: bool


def _named_bad(word: str) -> int:
    """2 for the name of what isn't the article, 1 for one that may be its own, else 0."""
    parts = [x.lower() for x in _NAME_PART.findall(word)]
    if not parts or parts[0] in _NEUTRAL_FIRST:
        return 0
    if _BAD.intersection(parts):
        return 2
    for level, words in ((2, _BAD_ALONE), (1, _PERHAPS | _BAD_ALONE)):
        alone = words.intersection(parts)
        if alone and all(p in alone or p in _SAYS_NOTHING for p in parts) and not ("header" in alone and _ARTICLE_NAMES.intersection(parts)):
            return level
    return 0


def _marked(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether the element is hidden, and how surely its class, id or role names something other than the article."""
    if not attrs:
        return False, 0
    if "=" not in attrs:
        return attrs.strip(" /").lower() == "hidden", 0
    bad = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, 0
        if name in ("class", "id", "role") and tag not in _NEVER_BY_NAME or name == "class" and tag == "article":
            bad = max(bad, *map(_named_bad, value.split()), 0)
    return False, bad


class Page:
    """One pass over a page: its text blocks in order. All that an element has from above is kept in its frame, and
    paths are numbers, so a tag costs the same at any depth."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.regions = 0
        self.own: set[int] = set()  # regions that are marked articles
        self.stack = [Frame("")]
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each name
        self.open_blocks: list[int] = [0]
        self.open_scopes: list[int] = [0]
        self.pieces: list[str] = []
        self.links = 0
        self.home = self.stack[0]
        self._read(page)

    def _say(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and not top.dropped:
            raw = _entities.unescape(raw) if "&" in raw else raw
            if not self.pieces:
                if raw.isspace():
                    return
                self.home = top
            self.pieces.append(raw)
            if top.links:
                self.links += len("".join(raw.split()))

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            home = self.home
            # Of an article's header its headings stay.
            if text and (home.heading or not home.in_header):
                self.blocks.append(Block(text, min(self.links, len(text)), home.path, home.region, home.unit, home.region in self.own, home.heading, home.soft, home.in_table))
        self.links = 0

    def _nearest(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _pop_to(self, k: int) -> None:
        if self.open_blocks[-1] >= k and not self.stack[k - 1].dropped:
            self._flush()
        for frame in self.stack[k:]:
            self.open[frame.tag].pop()
        for places in (self.open_blocks, self.open_scopes):
            while places[-1] >= k:
                places.pop()
        del self.stack[k:]

    def _close(self, tag: str) -> None:
        # An inline end tag doesn't close blocks.
        if self.open[tag] and (tag in _BLOCK or self.open[tag][-1] > self.open_blocks[-1]):
            self._pop_to(self.open[tag][-1])

    def _push(self, tag: str, attrs: str) -> None:
        block = tag in _BLOCK
        if block:
            ended, limits = _ENDS.get(tag, ((), ()))
            nearest = self._nearest(ended)
            if nearest > self._nearest(limits):
                self._pop_to(nearest)
            elif self._nearest(("p",)) > self.open_scopes[-1]:
                self._pop_to(self._nearest(("p",)))
            if not self.stack[-1].dropped:
                self._flush()
        over = self.stack[-1]
        hidden, bad = (False, 0) if over.dropped else _marked(tag, attrs)
        frame = Frame(tag, over.dropped or hidden or tag in _DROPPED or tag == "header" and not over.unit, max(over.soft, bad), over.path, over.region, over.unit, over.links + (tag == "a"), over.heading or tag in _HEADING, over.in_header, over.in_table or tag == "table")
        if block and tag not in ("html", "body"):
            parts = tag in _SECTION and not frame.in_table
            # Elements that part regions are told apart by their class, too.
            name = f"{tag}.{_CLASS.search(attrs)[1]}" if parts and attrs and _CLASS.search(attrs) else tag
            frame.path = self.paths.setdefault((over.path, name), len(self.paths) + 1)
            if parts:
                self.regions += 1
                frame.region = self.regions
            if tag in _UNIT:
                frame.unit, frame.in_header = frame.region, False
                self.own.add(frame.region)
            frame.in_header = frame.in_header or tag == "header"
        place = len(self.stack)
        self.stack.append(frame)
        self.open[tag].append(place)
        if block:
            self.open_blocks.append(place)
        if tag in _SCOPE or tag in _DROPPED:
            self.open_scopes.append(place)

    def _read(self, page: str) -> None:
        at, tokens = 0, _TOKEN
        while m := tokens.search(page, at):
            if tokens is _TOKEN and m["tag2"]:
                tokens = _LOOSE
                m = tokens.match(page, m.start())
            self._say(page[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                self._close(tag)
            elif tag == "br":
                self._say(" ")
            elif tag == "hr":
                self._flush()
            elif tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in _VOID:
                if self.stack[-1].tag == "head" and tag in _BLOCK:
                    self._pop_to(len(self.stack) - 1)
                self._push(tag, m["attrs"])
        self._say(page[at:])
        self._flush()


def _smooth(x: list[float]) -> list[float]:
    """Weights 1, 2, 1 along the page."""
    return [(x[max(i - 1, 0)] + 2 * v + x[min(i + 1, len(x) - 1)]) / 4 for i, v in enumerate(x)]


class Ratios:
    """The scores of the paths, the regions and the marked articles that some blocks of a page lie on.

    Every path gets two ratios, text length and punctuation a block, links not counted. Both are smoothed
    along the page, fused as length * (1 + punctuation), and averaged over the path again; a region, and an article, has the same
    two ratios of its own blocks, fused. The page's mean score is weighted by length.
    """

    def __init__(self, blocks: list[Block]):
        seen, chars, marks, linked = (defaultdict(float) for _ in range(4))
        regions: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        units: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for b in blocks:
            said = len(b.text) - b.link_chars
            points = len(_PUNCTUATION.findall(b.text)) if 2 * b.link_chars < len(b.text) else 0
            seen[b.path] += 1
            chars[b.path] += said
            linked[b.path] += b.link_chars
            marks[b.path] += points
            for k, x in enumerate((1, said, points)):
                regions[b.region][k] += x
                units[b.unit][k] += x
        self.chars, self.linked = chars, linked
        self.region, self.unit = ({r: c / n * (1 + m / n) for r, (n, c, m) in of.items()} for of in (regions, units))
        length, punctuation = (_smooth([x[b.path] / seen[b.path] for b in blocks]) for x in (chars, marks))
        fused = [a * (1 + c) for a, c in zip(length, punctuation, strict=True)]
        self.path: dict[int, float] = defaultdict(float)
        for b, f in zip(blocks, fused, strict=True):
            self.path[b.path] += f / seen[b.path]
        self.best: dict[int, float] = defaultdict(float)  # of each region the score of its best path
        for b in blocks:
            self.best[b.region] = max(self.best[b.region], self.path[b.path])
        self.mean = sum(len(b.text) * f for b, f in zip(blocks, fused, strict=True)) / sum(len(b.text) for b in blocks)

    def heavy(self, b: Block) -> bool:
        """Whether links make up most of the path's text."""
        return self.linked[b.path] > self.chars[b.path]

    def doubtful(self, b: Block) -> bool:
        """Whether a block of a doubtful name lies on a path, or in a region, that isn't as good as the article's text."""
        return b.soft == 1 and min(self.best[b.region], self.region[b.region]) < PERHAPS * self.mean


def _of_articles(blocks: list[Block]) -> list[Block]:
    """The blocks to keep of those in marked articles.

    Of several articles the one with the most text stays, and those whose own score isn't low; others are teasers and comments. In an article the flow of text right under it
    stays, lists of links and headings with it. A region nested in it is text if its best path's score isn't low, nor its own, half as strictly; what isn't goes
    if it stands after the last text, or if links make up most of it; and so does what follows a heading for comments, and a region of a doubtful name that isn't as good as the rest.
    """
    ratios = Ratios(blocks)
    size: dict[int, int] = defaultdict(int)
    for b in blocks:
        size[b.unit] += len(b.text) - b.link_chars
    largest = max(size, key=lambda u: (size[u], -u))
    blocks = [b for b in blocks if b.unit == largest or ratios.unit[b.unit] >= NESTED * ratios.mean]
    ratios = Ratios(blocks)
    ended: set[int] = set()
    fine = []
    for b in blocks:
        if b.heading and _COMMENTS.fullmatch(b.text):
            ended.add(b.unit)
        own = (b.own or b.in_table) and not b.soft
        strong = ratios.best[b.region] >= NESTED * ratios.mean and ratios.region[b.region] >= NESTED / 2 * ratios.mean
        gone = b.unit in ended or not own and not strong and ratios.heavy(b) or ratios.doubtful(b)
        fine.append(None if gone else own or strong)
    last = {b.unit: i for i, (b, f) in enumerate(zip(blocks, fine, strict=True)) if f}
    return [b for i, (b, f) in enumerate(zip(blocks, fine, strict=True)) if f or f is False and i < last.get(b.unit, -1)]


def _of_page(blocks: list[Block]) -> list[Block]:
    """The blocks to keep of a page that marks no article.

    The region of the best path is the article's. There, paths stay that have a fiftieth of the page's mean score, headings, and links between
    texts; elsewhere, paths with a quarter of it in regions with as much that aren't mostly links, and between texts all on their paths. Elsewhere, a copyright line goes;
    anywhere, a region of a doubtful name that isn't as good as the rest.
    """
    ratios = Ratios(blocks)
    best = max(blocks, key=lambda b: (ratios.chars[b.path] * ratios.path[b.path], b.path))
    kept = [b for b in blocks if not ratios.doubtful(b) and (b.region == best.region or not _COPYRIGHT.match(b.text))]
    if len(kept) < len(blocks):
        return _of_page(kept) if kept else []
    good = lambda b: ratios.path[b.path] >= WITHIN * ratios.mean if b.region == best.region else min(ratios.path[b.path], ratios.region[b.region]) >= ELSEWHERE * ratios.mean
    text = [i for i, b in enumerate(blocks) if not ratios.heavy(b) and good(b)]
    if not text:
        return blocks
    content, paths = {*text}, {blocks[i].path for i in text}
    ended = False
    kept = []
    for i, b in enumerate(blocks):
        own = b.region == best.region
        ended = ended or own and b.heading and bool(_COMMENTS.fullmatch(b.text))
        if not ended and (i in content or own and b.heading or (own or b.path in paths) and text[0] < i < text[-1]):
            kept.append(b)
    return kept


def main_text(page: str) -> str:
    """The blocks on content paths, joined by blank lines. What is named as other than the article goes, unless nothing else is there."""
    found = Page(page).blocks
    kept = [b for b in found if b.soft < 2] or found
    marked = [b for b in kept if b.unit]
    kept = _of_articles(marked) if marked else _of_page(kept) if kept else []
    return "\n\n".join(b.text for b in kept)


_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "") for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=_SCHEMA.names,
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    One pass without a shuffle; a page's memory is a small multiple of its length. A null or
    empty page, and one without text, gives an empty text. Repeated rows give repeated results;
    an empty table gives none; other columns are not read.
    """
    return pages.select(F.col("page_id"), "url", "html").mapInArrow(_extract, _SCHEMA)
