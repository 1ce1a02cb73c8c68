"""Text functions on columns: cleaning, search keys, match levels, escapes, display widths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scripts

#: All white space of Unicode, written so that Java and RE2 read it alike.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: What a search key leaves out: all but letters and numbers.
NOT_KEY = r"[^\p{L}\p{N}]+"

# What a key for titles leaves out, beside white space.
TITLE_MARKS = r"《》〈〉“”\"'‘’【】\[\]（）()·._\-—:：|｜"
# What a key for comparing paragraphs leaves out, beside white space.
PARAGRAPH_MARKS = r"，。！？、；：:,.!?;《》〈〉“”\"'‘’\[\]【】（）()\-—_·┃|"

#: The same and all white space, character by character.
_NOT_IN_PARAGRAPH_KEY = PARAGRAPH_MARKS.replace("\\", "") + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def bound(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f uses it: higher-order functions aren't shared by the code generator."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean(x: Column) -> Column:
    """Runs of any white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(x, f"{SPACE}+", " "), "^ | $", "")


def _converted(x: Column, table: scripts.Table) -> Column:
    """Text by a table: phrases, the longest that begins first, and characters one by one."""
    one = lambda t: F.translate(t, table.before, table.after)
    if not table.phrases:
        return one(x)
    # Only where a phrase may begin are the phrases tried: a range that other texts fall out of at once, then the first characters.
    first = sorted({p[0] for p in table.phrases})
    pattern = f"(?=[{first[0]}-{first[-1]}])(?=[{''.join(first)}])(?:{table.pattern()})"
    known = F.create_map(*(F.lit(t) for pair in sorted(table.phrases.items()) for t in pair))

    def parts(hits: Column) -> Column:
        return F.array_join(F.transform(F.split(x, pattern), lambda t, i: F.concat(one(t), F.coalesce(F.element_at(known, F.get(hits, i)), F.lit("")))), "")

    return F.when(x.rlike(pattern), bound(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), parts)).otherwise(one(x))


def fold_variants(x: Column) -> Column:
    """Traditional text as simplified."""
    return _converted(x, scripts.simplifying())


def unfold_variants(x: Column) -> Column:
    """Simplified text as traditional, for queries to a site that has that; of several forms the first, unless a phrase has another."""
    return _converted(x, scripts.traditional())


def fold_case(x: Column) -> Column:
    """Lower case, with the letters whose case folding is another than their lower case."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def search_key(x: Column) -> Column:
    """What titles, authors and queries are compared by; null is empty."""
    return bound(F.coalesce(x, F.lit("")), lambda x: F.regexp_replace(fold_case(fold_variants(x)), NOT_KEY, ""))


def title_key(x: Column) -> Column:
    """A title without white space, quotes, brackets and dashes."""
    return F.regexp_replace(x, f"[{TITLE_MARKS}\\x09-\\x0D\\x1C-\\x20\\x85\\p{{Z}}]+", "")


def paragraph_key(x: Column) -> Column:
    """A paragraph without white space and punctuation."""
    return F.translate(x, _NOT_IN_PARAGRAPH_KEY, "")


def match_level(query: Column, title: Column, author: Column, snippet: Column) -> Column:
    """4 the same key; 3 one key contains the other; 2 all words of the query are in the title; 1 the query is
    in author or snippet; else 0. An empty query is 0; an empty title is contained in any query."""
    return level_of(query, search_key(title), search_key(author), search_key(snippet))


def level_of(query: Column, title: Column, author: Column, snippet: Column) -> Column:
    """match_level of a query and the keys of title, author and snippet."""
    q = search_key(query)
    words = F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), r"[\x09-\x0D\x1C-\x20\x85\p{Z},，;；]+"), search_key), lambda w: w != "")
    return (
        F.when(q == "", 0)
        .when(q == title, 4)
        .when(F.contains(title, q) | F.contains(q, title), 3)
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(title, w)), 2)
        .when(F.contains(author, q) | F.contains(snippet, q), 1)
        .otherwise(0)
    )


def titles_overlap(a: Column, b: Column) -> Column:
    """Whether one title's key contains the other's."""
    return F.contains(title_key(a), title_key(b)) | F.contains(title_key(b), title_key(a))


def comma_spacing(x: Column) -> Column:
    return F.regexp_replace(x, "([，,])[\t ]+", "$1")


def comma_breaks(x: Column) -> Column:
    """In HTML, paragraphs that a comma ends run on into the next."""
    return F.regexp_replace(comma_spacing(x), r"([，,])\s*</p>\s*<p>\s*", "$1")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Entities in the order in which they are replaced; &amp; is the last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
def numbered(x: Column) -> Column:
    """Text with the character references by number decoded, once; a number that is no character becomes the sign for that."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
    digits = lambda r: F.regexp_extract(r, "([0-9a-fA-F]+);", 1)
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).try_cast("int")
    char = lambda r: bound(code(r), lambda n: F.when((n > 0) & (n < 0xD800) | (n > 0xDFFF) & (n <= 0x10FFFF), _character(n)).otherwise("\ufffd"))
    parts = lambda hits: F.array_join(F.transform(F.split(x, pattern), lambda t, i: F.concat(t, F.coalesce(F.when(i < F.size(hits), char(F.get(hits, i))), F.lit("")))), "")
    return F.when(x.rlike(pattern), bound(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), parts)).otherwise(x)


def unescape(x: Column) -> Column:
    """Text with its character references decoded: those that are common here, and characters by their numbers."""
    for a, b in ENTITIES[:-1]:
        x = F.replace(x, F.lit(a), F.lit(b))
    a, b = ENTITIES[-1]
    return bound(x, lambda x: F.replace(numbered(x), F.lit(a), F.lit(b)))


def _character(n: Column) -> Column:
    """The character of a number, by its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def safe_name(x: Column, fallback: str) -> Column:
    """A name for a file: no characters that paths reserve, no dots or spaces at its ends."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]', "_"), f"{SPACE}+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^[ .]+|[ .]+$", ""), F.lit("")), F.lit(fallback))


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in text)


@F.pandas_udf(T.IntegerType())
def display_width(texts: pd.Series) -> pd.Series:
    """Columns a text takes on a terminal: wide characters two, combining ones none. No built-in knows widths."""
    return texts.map(lambda t: _width(t or ""))


def preview_heading(index: Column, source: Column, title: Column, author: Column, count: Column, status: Column) -> Column:
    """[index] source | title / author | count / status; an empty author or status is left out, a null count is unknown."""
    also = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(" / "), x)).otherwise("")
    chapters = F.coalesce(F.concat(count.cast("string"), F.lit(" chapter(s)")), F.lit("unknown chapter count"))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), source, F.lit(" | "), title, also(author), F.lit(" | "), chapters, also(status))


def reference(href: Column, title: Column) -> Column:
    return F.concat(href, F.lit(": "), title)


@F.pandas_udf(T.StringType())
def fit_display(texts: pd.Series, widths: pd.Series) -> pd.Series:
    """Texts cut to a width, with ... where something was cut, and filled with spaces."""

    def fit(text: str, width: int) -> str:
        text = text or ""
        if _width(text) > width:
            room, end, out, used = (width - 3, "...", "", 0) if width > 3 else (width, "", "", 0)
            for c in text:
                if used + _width(c) > room:
                    break
                out, used = out + c, used + _width(c)
            text = out + end
        return text + " " * max(0, width - _width(text))

    return pd.Series([fit(t, w) for t, w in zip(texts, widths, strict=True)])
