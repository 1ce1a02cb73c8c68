"""Selectors over one page, as plain Python: what a table of rules needs, where a column would need a pattern that is known beforehand."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .markup import CONTAINERS
from .text import ENTITIES

_NOISE = re.compile(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<ins[^>]*>.*?</ins>|<iframe[^>]*>.*?</iframe>|<!--.*?-->")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What an opening tag on the left ends, if nothing on the right is open above it.
_ENDS = {"li": ({"li", "p"}, {"ul", "ol", "td", "th", "table"}), "dt": ({"dt", "dd", "p"}, {"dl", "td", "th", "table"}), "dd": ({"dt", "dd", "p"}, {"dl", "td", "th", "table"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ENDS |= {n: ({"p"}, {"td", "th", "table"}) for n in (*CONTAINERS, "p", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure", "fieldset") if n not in ("html", "body", *_ENDS)}


_NUMBERED = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));")


def unescape(text: str) -> str:
    """The references that functions.text.unescape decodes, and no others."""

    def character(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 0 < n < 0xD800 or 0xDFFF < n <= 0x10FFFF else "\ufffd"

    for a, b in ENTITIES[:-1]:
        text = text.replace(a, b)
    return _NUMBERED.sub(character, text).replace(*ENTITIES[-1])


class Element(NamedTuple):
    name: str
    attributes: dict[str, str]
    parent: int  # place of the element that it is in; -1 for none
    inside: str


def elements(page: str) -> list[Element]:
    """All elements of a page in the order of their tags. One that isn't closed ends with what holds it."""
    page = _NOISE.sub("", page)
    found: list[list] = []
    stack: list[int] = []

    def end_from(k: int, at: int) -> None:
        for i in stack[k:]:
            found[i][3] = at
        del stack[k:]

    for m in _TAG.finditer(page):
        name = m[2].lower()
        names = [found[i][0] for i in stack]
        if m[1]:
            if name in names:
                end_from(len(names) - 1 - names[::-1].index(name), m.start())
            continue
        ended, walls = _ENDS.get(name, ((), ()))
        wall = max((k for k, n in enumerate(names) if n in walls), default=-1)
        first = next((k for k in range(wall + 1, len(names)) if names[k] in ended), None)
        if first is not None:
            end_from(first, m.start())
        attributes = {a.lower(): unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3])}
        found.append([name, attributes, stack[-1] if stack else -1, len(page), m.end()])
        if name not in _VOID:
            stack.append(len(found) - 1)
    return [Element(n, a, p, page[begin:end] if n not in _VOID else "") for n, a, p, end, begin in found]


class Step(NamedTuple):
    name: str
    classes: frozenset[str]
    id: str


@lru_cache(maxsize=4096)
def parsed(selector: str) -> tuple[Step, ...]:
    """Steps of a selector: names, .classes and #ids of an element, parted by spaces from those of one that it is in. A step that can't be read is an error."""
    steps = []
    for part in selector.split():
        m = re.fullmatch(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)", part)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        marks = re.findall(r"([.#])([\w-]+)", m[2])
        steps.append(Step((m[1] or "*").lower(), frozenset(n for k, n in marks if k == "."), next((n for k, n in marks if k == "#"), "")))
    return tuple(steps)


def _is(element: Element, step: Step) -> bool:
    return step.name in ("*", element.name) and step.classes <= set(element.attributes.get("class", "").split()) and step.id in ("", element.attributes.get("id"))


def selected(found: list[Element], selector: str) -> list[Element]:
    """The elements of a page that a selector names, in order."""
    *over, last = parsed(selector) or (Step("*", frozenset(), ""),)
    out = []
    for e in found:
        if _is(e, last):
            steps, at = list(over), e.parent
            while steps and at >= 0:
                if _is(found[at], steps[-1]):
                    steps.pop()
                at = found[at].parent
            if not steps:
                out.append(e)
    return out


def text_of(inside: str) -> str:
    return " ".join(unescape(re.sub(r"<[^>]*>", "", inside)).split())
