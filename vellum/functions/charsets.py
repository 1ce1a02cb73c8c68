"""Charsets of landed bytes: found, decoded with replacement, and written, without settings of the session."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is tried, in this order among equals.
CANDIDATES = ("utf-8", "gb18030", "big5", "shift_jis", "euc-jp", "windows-1251", "windows-1252")
#: Marks at the beginning of a text, the longer before those that they begin with.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: A declared charset may be wrong about so many of its characters beyond ASCII.
TOLERATED = 0.02
_REPLACEMENT = "�".encode()
_DECLARED = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)|<\?xml[^>]{0,200}?encoding\s*=\s*[\"']([A-Za-z0-9_:.-]+)", re.I)
# Declared names by which, as browsers read them, another charset is meant that holds the first.
_MEANT = {"gb2312": "gb18030", "gbk": "gb18030", "iso8859-1": "windows-1252", "ascii": "windows-1252", "cp1252": "windows-1252", "cp1251": "windows-1251", "big5hkscs": "big5hkscs", "cp932": "shift_jis"}


def _known(name: str) -> str | None:
    """The charset that a name declares; null for one that there isn't."""
    try:
        found = codecs.lookup(name).name
    except LookupError:
        return None
    return _MEANT.get(found, {"euc_jp": "euc-jp"}.get(found, found))


# What stands as a letter with an accent would, and so counts for no charset of byte pairs: a character by itself that touches a Latin letter, one or two half-width kana (one byte
# each, elsewhere a capital or ß), and a run of them that touches a Latin letter.
_HALF = frozenset(map(chr, range(0xFF61, 0xFFA0)))
_W, _H = r"[^\x00-\x7f]", r"[\uff61-\uff9f]"
_RUNS = f"(?<!{_H}){_H}{{1,2}}(?!{_H})|(?<=[A-Za-z]){_H}+|(?<!{_H}){_H}+(?=[A-Za-z])"
_AS_LETTERS = re.compile(f"(?<=[A-Za-z]){_W}(?!{_W})|(?<!{_W}){_W}(?=[A-Za-z])|{_RUNS}")
# The same where most letters are Latin: a character by itself counts wherever it stands, but for an element's only one.
_AMONG_LATIN = re.compile(f"(?<!{_W})(?<!>){_W}(?!<|{_W})|(?<=[A-Za-z]){_W}(?!{_W})|(?<!{_W}){_W}(?=[A-Za-z])|{_RUNS}")
# Words of Latin letters, but those of escapes, and others.
_MIXED = re.compile(rf"(?:(?<![\\A-Za-z])[A-Za-z]+{_W}|{_W}+[A-Za-z])(?:[A-Za-z]|{_W})*")
# Cyrillic words without a vowel; a text has few.
_C, _VOWELS = r"[\u0400-\u045f]", "аеёиоуыэюяіїєАЕЁИОУЫЭЮЯІЇЄ"
_VOWELLESS = re.compile(f"(?<!{_C})(?:(?![{_VOWELS}]){_C})+(?!{_C})")
# Signs that texts in both charsets of single bytes have; letters beside them are what tells.
_SIGNS = frozenset("‘’“”„–—…«»°€")
# Of phonetic signs and rare Cyrillic letters, which byte pairs of others can be read as, no text is made.
_ODD = re.compile("[\u0250-\u036f\u0460-\u052f]")


def _pairs(charset: str, *rows: tuple[int, int, int, int]) -> frozenset[str]:
    """The characters of all byte pairs whose first and second byte lie in a range; a pair that is none gives nothing, not what its second byte is by itself."""
    raw = (bytes((a, b)).decode(charset, "replace") for low, high, first, last in rows for a in range(low, high + 1) for b in range(first, last + 1))
    return frozenset(c for c in raw if len(c) == 1 and c != "\ufffd")


@lru_cache(maxsize=None)
def common(charset: str) -> frozenset[str]:
    """The characters that texts in a charset are made of: by the planes in which its makers put the frequent ones."""
    if charset == "gb18030":
        return _pairs("gb2312", (0xB0, 0xD7, 0xA1, 0xFE), (0xA1, 0xA3, 0xA1, 0xFE))
    if charset in ("big5", "big5hkscs"):
        return _pairs("big5", (0xA4, 0xC6, 0x40, 0xFE), (0xA1, 0xA2, 0x40, 0xFE))
    if charset in ("shift_jis", "euc-jp"):
        return _pairs("shift_jis", (0x82, 0x83, 0x40, 0xFC), (0x88, 0x97, 0x40, 0xFC), (0x81, 0x81, 0x40, 0xAC)) | _HALF
    letters = "".join(map(chr, range(0xC0, 0x100))).replace("×", "").replace("÷", "") if charset == "windows-1252" else "".join(map(chr, range(0x410, 0x450))) + "Ёё"
    return frozenset(letters) | _SIGNS


def score(raw: bytes, charset: str) -> float:
    """How well bytes are read as text of a charset: the share of characters beyond ASCII that are common in it, less four times that of those that are none. A last character that is cut off, or none, doesn't count."""
    decoder = codecs.getincrementaldecoder(charset)("replace")
    text, cut = decoder.decode(raw), decoder.getstate()[0]
    found = Counter(text.removesuffix("�"))
    beyond = {c: n for c, n in found.items() if c >= "\x80"}
    total = sum(beyond.values())
    if not total:
        return 1.0 if raw.isascii() or charset == "utf-8" and len(cut) > 1 else 0.1 * bool(cut)
    errors = beyond.pop("�", 0)
    if charset == "utf-8":  # what is well-formed is hardly anything else
        return 1.0 - sum(n for c, n in beyond.items() if _ODD.match(c)) / (2 * total) - 4 * max(0, errors - raw.count(_REPLACEMENT)) / total
    usual = common(charset)
    share, errors = sum(n for c, n in beyond.items() if c in usual) / total, 4 * errors / total
    plain = sum(n for c, n in found.items() if c.isascii() and c.isalpha())
    if charset.startswith("windows"):
        share -= sum(beyond.get(c, 0) for c in _SIGNS) / (2 * total)
    if share <= errors:
        return share - errors  # what is taken off below wouldn't matter
    # Letters with accents stand among many without, those of another alphabet hardly among any, not in one word with them, and in words with vowels.
    if charset == "windows-1252":
        share *= max(plain / (plain + total), 0.05)
    elif charset == "windows-1251":
        mixed = sum(c >= "\x80" for c in "".join(_MIXED.findall(text))) if plain else 0
        share = (total > 1) * (share - (2 * mixed + len("".join(_VOWELLESS.findall(text)))) / total) * total / (plain + total)
    elif plain or not _HALF.isdisjoint(beyond):
        share -= sum(c in usual for c in "".join((_AMONG_LATIN if plain > total else _AS_LETTERS).findall(text))) / total
    return share - errors


def charset_of(raw: bytes, candidates: tuple[str, ...] = CANDIDATES) -> tuple[str, str]:
    """(charset, how): by a mark at the beginning, by what the text declares if that reads it, or by the statistics of its bytes. Without bytes beyond ASCII it is UTF-8."""
    for mark, charset in MARKS:
        if raw.startswith(mark):
            return charset, "mark"
    if declared := _DECLARED.search(raw):
        charset = _known((declared[1] or declared[2]).decode())
        if charset and not charset.startswith(("utf-16", "utf-32")):
            text = raw.decode(charset, "replace")
            if text.count("�") - (raw.count(_REPLACEMENT) if charset == "utf-8" else 0) <= TOLERATED * sum(n for c, n in Counter(text).items() if c >= "\x80"):
                return charset, "declared"
    if raw.isascii():
        return "utf-8", "bytes"
    best, most = candidates[0], float("-inf")
    for c in candidates:  # the first of the best; none is better than 1
        if most < 1 and (found := score(raw, c)) > most:
            best, most = c, found
    return best, "bytes"


def decode(raw: bytes) -> tuple[str, str, str]:
    charset, how = charset_of(raw)
    mark = next((m for m, c in MARKS if how == "mark" and raw.startswith(m)), b"")
    return charset, how, raw[len(mark) :].decode(charset, "replace")


# Plain functions, which get a hundred rows at a time: a batch of Arrow's holds ten thousand texts, however long, and each of their results.
@F.udf(returnType=T.StructType([T.StructField(c, T.StringType()) for c in ("charset", "how", "text")]), useArrow=False)
def decoded(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """struct(charset, how, text) of landed bytes; what the charset can't read is the replacement sign. Null is null in all three. No built-in knows these charsets in a session without legacy settings."""
    return (None,) * 3 if content is None else decode(bytes(content))


def in_charset(text: str, charset: str) -> bool:
    try:
        return bool(text.encode(charset)) or not text
    except UnicodeEncodeError:
        return False


@F.udf(returnType=T.BinaryType(), useArrow=False)
def _written(text: str | None, charset: str | None, references: bool) -> bytes | None:
    try:
        return None if text is None or charset is None else text.encode(charset, "xmlcharrefreplace" if references else "strict")
    except UnicodeEncodeError:
        return None


def encoded(x: Column, charset: str | Column, references: bool = False) -> Column:
    """A text's bytes in a charset, which may be another for each row. A character that the charset hasn't makes them null, or is written as a reference by its number, as in HTML."""
    return _written(x, F.lit(charset) if isinstance(charset, str) else charset, F.lit(references))
