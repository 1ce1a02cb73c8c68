"""Tables between traditional and simplified characters, read from the rules of the ICU library that Spark ships."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from functools import lru_cache
from typing import NamedTuple

import pyspark

#: Pairs that hold whatever the rules say of them, for drivers without Spark's own libraries all there are.
TRADITIONAL = "書靈魂處鬧軍萬長號體會後來對開關時間東門馬風飛龍鳳劍俠夢記錄傳說話語學國圖畫愛戀實現無際電腦網絡標籤終結兩條從這裡經過點擊頁閱讀"
SIMPLIFIED = "书灵魂处闹军万长号体会后来对开关时间东门马风飞龙凤剑侠梦记录传说话语学国图画爱恋实现无际电脑网络标签终结两条从这里经过点击页阅读"

_RESOURCE = "com/ibm/icu/impl/data/icudata/translit/root.res"


class Table(NamedTuple):
    """Characters and what they become, place by place, and phrases that don't become what their characters do."""

    before: str
    after: str
    phrases: dict[str, str]

    def pattern(self) -> str:
        """The phrases, the longest first; RE2 reads it, too. A table without any has a pattern that nothing matches."""
        return "|".join(sorted(self.phrases, key=lambda p: (-len(p), p))) or "[^\\x{0}-\\x{10FFFF}]"

    def convert(self, text: str) -> str:
        one = dict(zip(self.before, self.after, strict=True))
        out, at = [], 0
        for m in re.finditer("|".join(sorted(self.phrases, key=lambda p: (-len(p), p))) or r"(?!)", text):
            out += [*(one.get(c, c) for c in text[at : m.start()]), self.phrases[m[0]]]
            at = m.end()
        return "".join([*out, *(one.get(c, c) for c in text[at:])])


def _rules() -> list[str]:
    """The rules between the two scripts: a↔b, a→b or a←b, with the simplified form on the left."""
    found = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar")))
    if not found:
        return []
    with zipfile.ZipFile(found[-1]) as jar:
        text = jar.read(_RESOURCE).decode("utf-16-be", "ignore")  # a bundle of strings, each ended by a null
    rules = next(part for part in text.split("\0") if "$SCDigit" in part)
    return [r.strip() for r in rules[rules.index("$SCDigit") :].split(";")]


def _expanded(rules: list[str]) -> list[tuple[str, str, str]]:
    """(left, arrow, right): rules for what stands before or after a phrase are rules of the longer phrases."""
    sets: dict[str, str] = {}
    out = []
    for r in rules:
        if m := re.fullmatch(r"(\$\w+) = \[(.+)\]", r):
            sets[m[1]] = m[2]
        elif m := re.fullmatch(r"([^\s{}$\[\]]+)\s*([↔→←])\s*([^\s{}$\[\]]+)", r):
            out.append((m[1], m[2], m[3]))
        elif m := re.fullmatch(r"(?:(\$\w+) \{ )?(\S+?)\s*(?:\}\s*(\$\w+|\[.+\]|[^\s→]+) )?\s*→\s*(\S+)", r.replace("}[", "} [").replace("]→", "] → ")):
            # The left side is the simplified one; what surrounds it stays as its own rule has it.
            first = sets.get(m[1] or "", "") or [""]
            last = sets.get(m[3], m[3].strip("[]") if m[3][0] == "[" else [m[3]]) if m[3] else [""]
            out += [(f"{a}{m[2]}{b}", "context", f"{a}\0{m[4]}\0{b}") for a in first for b in last]
    return out


def _table(pairs: list[tuple[str, str]], fixed: dict[str, str]) -> Table:
    first: dict[str, str] = {}
    for a, b in pairs:
        first.setdefault(a, b)
    one = {a: b for a, b in first.items() if len(a) == 1} | fixed
    as_characters = lambda text: "".join(one.get(c, c) for c in text)
    # What stands before a rule's phrase is compared as it has become, so a sign that changes isn't that sign any more.
    first = {a: b for a, b in first.items() if "\0" not in b or as_characters(b.split("\0")[0]) == b.split("\0")[0]}
    surrounded = {a: "".join(x if i == 1 else as_characters(x) for i, x in enumerate(b.split("\0"))) for a, b in first.items() if "\0" in b}
    phrases = {a: surrounded.get(a, b) for a, b in first.items() if len(a) > 1 and surrounded.get(a, b) != as_characters(a)}
    changed = {a: b for a, b in one.items() if a != b}
    return Table("".join(changed), "".join(changed.values()), phrases)


@lru_cache(maxsize=1)
def simplifying() -> Table:
    rules = _expanded(_rules())
    return _table([(r, l) for l, arrow, r in rules if arrow in "↔←"], dict(zip(TRADITIONAL, SIMPLIFIED, strict=True)))


@lru_cache(maxsize=1)
def traditional() -> Table:
    """Of several forms the first of the rules."""
    rules = _expanded(_rules())
    known = {l for l, arrow, _ in rules if arrow in "↔→" and len(l) == 1}
    fixed: dict[str, str] = {}
    for a, b in zip(SIMPLIFIED, TRADITIONAL, strict=True):
        if a not in known:
            fixed.setdefault(a, b)
    return _table([(l, r) for l, arrow, r in rules if arrow in ("↔", "→", "context")], fixed)
