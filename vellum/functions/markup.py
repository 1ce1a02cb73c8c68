"""Elements of HTML that end at their own end tag, found in columns.

The tags of a text go through a machine whose state is the stack of open elements, a letter for each. An end tag closes up to the nearest
open element of its name, and is passed over without one; an opening tag closes what can't hold it (a list item the item before,
a block an open paragraph); what is never closed ends with what holds it. All of it is array functions: no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import scanned
from .text import bound

#: The elements that make up a page. Other tags are part of the text between these.
NAMES = (
    "html", "head", "title", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
    "tfoot", "tr", "td", "th", "form", "fieldset", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "center", "span",
)
#: Those that hold others of any kind, enough to find where one of them ends.
CONTAINERS = ("html", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "table", "tr", "td", "form", "blockquote")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CODE = dict(zip(NAMES, _LETTERS))
#: Names that may stand in a paragraph, or that no block closes.
_IN_PARAGRAPHS = ("span", "html", "head", "title", "body")


def _codes(*names: str) -> str:
    return "".join(_CODE[n] for n in names)


def _open(closed: str, inside: str) -> str:
    """A pattern for the end of a stack: from an open element to close, if no other of the kind that it lies in is open above it."""
    return f"[{closed}][^{inside}]*$"


_PARAGRAPH = _open(_codes("p"), _codes("td", "th", "table"))
#: What opening tags close, by their names: a pattern of the stack's end.
_CLOSES = (
    (_codes("li"), f"(?:{_open(_codes('li'), _codes('ul', 'ol', 'td', 'th', 'table'))}|{_PARAGRAPH})"),
    (_codes("dt", "dd"), f"(?:{_open(_codes('dt', 'dd'), _codes('dl', 'td', 'th', 'table'))}|{_PARAGRAPH})"),
    (_codes("tr"), _open(_codes("tr"), _codes("table"))),
    (_codes("td", "th"), _open(_codes("td", "th"), _codes("tr", "table"))),
    (_codes("thead", "tbody", "tfoot"), _open(_codes("thead", "tbody", "tfoot"), _codes("table"))),
    ("".join(_CODE[n] for n in NAMES if n not in (*_IN_PARAGRAPHS, "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot")), _PARAGRAPH),
)


def _tag(names: tuple[str, ...]) -> str:
    """A pattern for the tags of these names; a > in a quoted value is part of the tag."""
    return rf"(?i)</?(?:{'|'.join(names)})(?![a-z0-9:-])[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>"


def _marks(tags: Column, names: tuple[str, ...]) -> Column:
    """array<struct(low, depth)>: for each tag how many elements are open when it has closed what it closes, and when it has opened its own."""
    known = F.array(*map(F.lit, names))
    codes = F.lit("".join(_CODE[n] for n in names))

    def read(tag: Column) -> Column:
        place = F.array_position(known, F.lower(F.regexp_extract(tag, "^</?([a-zA-Z0-9]+)", 1))).cast("int")
        return F.struct(F.substring(codes, place, F.lit(1)).alias("code"), F.startswith(tag, F.lit("</")).alias("ends"))

    def step(state: Column, tag: Column) -> Column:
        stack, code = state["stack"], tag["code"]
        above = F.length(F.call_function("substring_index", stack, code, F.lit(-1))) + 1  # what an end tag closes: its element and what is open in it
        ended = F.when(above <= F.length(stack), above).otherwise(0)
        implied = F.lit(0)
        for own, pattern in reversed(_CLOSES):
            implied = F.when(F.contains(F.lit(own), code), F.length(F.regexp_extract(stack, pattern, 0))).otherwise(implied)
        cut = F.when(tag["ends"], ended).otherwise(implied)
        return bound(
            F.length(stack) - cut,
            lambda low: F.struct(F.concat(F.substring(stack, F.lit(1), low), F.when(tag["ends"], "").otherwise(code)).alias("stack"), low.alias("low")),
        )

    # What a tag does is read from the state after it, so one more tag, which changes nothing, comes last.
    items = F.concat(F.transform(tags, read), F.array(F.struct(F.lit("-").alias("code"), F.lit(True).alias("ends"))))
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("low"))
    states = scanned(items, start, step, lambda s, _: F.struct(s["low"].alias("low"), F.length(s["stack"]).alias("depth")), "struct<low:int,depth:int>")
    return F.slice(states, 2, F.size(tags) + 1)


def _spans(tags: Column, marks: Column) -> Column:
    """array<struct(at, until, depth)>: every element in the order of opening tags: its tag's place, and that of the tag that ends it, or the number of tags.

    At one depth elements begin and end in turn. So beginnings and ends, sorted by depth and place, stand in pairs.
    """
    before = lambda i: F.coalesce(F.get(marks, i - 1)["depth"], F.lit(0))
    event = lambda depth, place, kind: F.struct(depth.alias("depth"), place.alias("place"), F.lit(kind).alias("kind"))

    def events(mark: Column, i: Column) -> Column:
        ends = F.when(before(i) > mark["low"], F.transform(F.sequence(mark["low"] + 1, before(i)), lambda d: event(d, i, 0)))
        opens = F.when(mark["depth"] > mark["low"], F.array(event(mark["depth"], i, 1)))
        none = F.array().cast("array<struct<depth:int,place:int,kind:int>>")
        return F.concat(F.coalesce(ends, none), F.coalesce(opens, none))

    last = before(F.size(tags))
    unclosed = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda d: event(d, F.size(tags), 0))).otherwise(F.array().cast("array<struct<depth:int,place:int,kind:int>>"))
    every = F.array_sort(F.concat(F.flatten(F.transform(marks, events)), unclosed))
    paired = lambda s: F.transform(s, lambda e, k: F.struct(e["place"].alias("at"), F.get(s, k + 1)["place"].alias("until"), e["depth"].alias("depth"), e["kind"].alias("kind")))
    return F.array_sort(F.filter(bound(every, paired), lambda e: e["kind"] == 1))


def page(html: Column, names: tuple[str, ...] = NAMES) -> Column:
    """struct(pieces, tags, elements) of HTML without scripts, styles and comments: the text around its tags, the tags, and elements (at, until, depth) in order."""
    pattern = _tag(names)

    def parts(tags: Column) -> Column:
        elements = bound(_marks(tags, names), lambda m: _spans(tags, m))
        return F.struct(F.split(html, pattern).alias("pieces"), tags.alias("tags"), elements.alias("elements"))

    return bound(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), parts)


def tag_of(page: Column, element: Column) -> Column:
    return F.get(page["tags"], element["at"])


def inside(page: Column, element: Column) -> Column:
    """The HTML between an element's tag and its end."""
    places = F.sequence(element["at"] + 1, element["until"])
    return F.array_join(F.transform(places, lambda k: F.concat(F.get(page["pieces"], k), F.when(k < element["until"], F.get(page["tags"], k)).otherwise(""))), "")


def named(name: str, class_name: str | None = None) -> Callable[[Column], Column]:
    """A test of an opening tag: by its name, and that one of its classes is the given one."""

    def test(tag: Column) -> Column:
        of_name = tag.rlike(rf"(?i)^<{name}[\s/>]")
        if class_name is None:
            return of_name
        return of_name & tag.rlike(rf"(?is)\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{class_name}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{class_name}(?:\s[^']*)?'|{class_name}[\s>])")

    return test


def every_inside(html: Column, test: Callable[[Column], Column], names: tuple[str, ...] = NAMES) -> Column:
    """The insides of all elements whose tag passes a test, in order; one that stands in another comes after it and is part of it, too."""
    return bound(page(html, names), lambda p: F.transform(F.filter(p["elements"], lambda e: test(tag_of(p, e))), lambda e: inside(p, e)))


def first_inside(html: Column, test: Callable[[Column], Column], names: tuple[str, ...] = NAMES) -> Column:
    """The inside of the first element whose tag passes a test; null without one."""
    pattern = _tag(names)

    def found(tags: Column) -> Column:
        # Only this element's end is looked for: the first tag after it that closes something below it.
        place = F.array_position(F.transform(tags, lambda t: ~F.startswith(t, F.lit("</")) & test(t)), True).cast("int")
        return bound(place, lambda at: F.when(at > 0, bound(_marks(tags, names), lambda m: cut(tags, m, at))))

    def cut(tags: Column, marks: Column, at: Column) -> Column:
        own = F.element_at(marks, at)["depth"]
        ends = bound(own, lambda depth: F.array_position(F.transform(F.slice(marks, at + 1, F.size(marks)), lambda m: m["low"] < depth), True).cast("int"))
        element = bound(ends, lambda n: F.struct((at - 1).alias("at"), F.when(n > 0, at + n - 1).otherwise(F.size(tags)).alias("until")))
        whole = F.struct(F.split(html, pattern).alias("pieces"), tags.alias("tags"))
        return bound(whole, lambda p: bound(element, lambda e: inside(p, e)))

    return bound(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), found)
