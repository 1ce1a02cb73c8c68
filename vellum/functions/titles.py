"""Numerals, chapter labels and names in titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, clean, unescape

# Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
# The numerals of headings.
HEADING_NUMERAL = "一二三四五六七八九十百零兩两"
# Headings may have these of DIGITS and UNITS, too.
NUMERAL = HEADING_NUMERAL + "〇千"
_ANY = rf"[{NUMERAL}0-9]+"

# Patterns of a chapter's number and of its label, volume and name.
CHAPTER_REF = rf"^{SPACE}*第{SPACE}*([0-9]+|[零〇一二两三四五六七八九十百千]+){SPACE}*([章回])"
SPLIT_TITLE = rf"^{SPACE}*(第{SPACE}*{_ANY}{SPACE}*章){SPACE}*(?:卷{SPACE}*((?:[一二三四五六七八九]?十[一二三四五六七八九]?|百|[一二三四五六七八九])|[0-9]+){SPACE}*(.*)|(.*)){SPACE}*$"

# A section's number as a chapter's; what follows a title; parts of a search result's title; the part mark.
SECTION_TITLE = r"^第([0-9０-９一二三四五六七八九十百千两]+)节$"
LAST_BRACKET = r"[（(][^()（）]*[)）] ?$"
BY_AUTHOR = r"(?i)\bby +([^()（）]+)$"
LAST_VOLUME = r"第[一二三四五六七八九十百零0-9]+卷[^()（）]*$"
PUBLISHED = r"- ?出[書书]版.*$"
PART_MARK = r"[（(]?[上中下][)）]?"
SITE_NAME = r" ?[-_] ?[^-_ ]+(?:小说网|书库|site)$"
SALES_WORDS = "(?:最新章节|全文阅读|免费全文阅读).*$"
UNNAMED = "未命名"


def numeral_value(x: Column) -> Column:
    """The number of a decimal or Chinese numeral; null for anything else. A later digit replaces an earlier one that no unit follows."""
    digit, unit = (F.create_map(*(F.lit(y) for kv in m.items() for y in kv)) for m in (DIGITS, UNITS))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(acc, c):
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        return F.struct(
            F.when(u.isNotNull(), acc["total"] + F.when(acc["now"] == 0, 1).otherwise(acc["now"]) * u).otherwise(acc["total"]).cast("long").alias("total"),
            F.coalesce(d, F.lit(0)).cast("long").alias("now"),
        )

    chars = F.filter(F.split(x, ""), lambda c: c != "")
    folded = F.aggregate(chars, start, step, lambda acc: acc["total"] + acc["now"])
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("long")).when(x.rlike("^[零〇一二两三四五六七八九十百千]+$"), folded)


def chapter_number(title: Column) -> Column:
    return numeral_value(F.regexp_extract(title, CHAPTER_REF, 1))


def chapter_unit(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, CHAPTER_REF, 2), F.lit(""))


def section_as_chapter(title: Column) -> Column:
    """A title that is only a section's number becomes a chapter's."""
    return F.regexp_replace(clean(title), SECTION_TITLE, "第$1章")


def split_title(raw: Column) -> Column:
    """struct(chapter, volume, name): the chapter's label, the volume's with its name, or the chapter's own name. A title of another form is the label."""
    chapter = clean(F.regexp_extract(raw, SPLIT_TITLE, 1))
    number = F.regexp_extract(raw, SPLIT_TITLE, 2)
    volume = F.concat(F.lit("卷"), number, F.regexp_replace(F.concat(F.lit(" "), clean(F.regexp_extract(raw, SPLIT_TITLE, 3))), "^ $", ""))
    fits = raw.rlike(SPLIT_TITLE)
    return F.struct(
        F.when(fits, chapter).otherwise(raw).alias("chapter"),
        F.when(fits & (number != ""), volume).otherwise("").alias("volume"),
        F.when(fits & (number == ""), clean(F.regexp_extract(raw, SPLIT_TITLE, 4))).otherwise("").alias("name"),
    )


def title_and_author(raw: Column) -> Column:
    """struct(title, author) of "title by author (tag)"; volume and edition marks at the title's end go."""
    text = clean(F.regexp_replace(clean(raw), LAST_BRACKET, ""))
    author = F.regexp_extract(text, BY_AUTHOR, 1)
    title = F.when(author != "", clean(F.regexp_replace(text, BY_AUTHOR, ""))).otherwise(text)
    title = clean(F.regexp_replace(title, LAST_VOLUME, ""))
    title = clean(F.regexp_replace(title, PUBLISHED, ""))
    title = clean(F.regexp_replace(title, PART_MARK + " ?$", ""))
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), clean(raw)).alias("title"), clean(author).alias("author"))


def result_title(raw: Column) -> Column:
    """struct(title, author) of a search result's "title (author) - site" with its sales words."""
    text = clean(F.regexp_replace(clean(unescape(raw)), SITE_NAME, ""))
    text = clean(F.regexp_replace(text, SALES_WORDS, ""))
    author = clean(F.regexp_extract(text, r"[（(]([^()（）]+)[)）]", 1))
    title = F.when(author != "", F.regexp_replace(text, r"^([^（(]*)[（(][^()（）]+[)）]", "$1")).otherwise(text)
    title = F.regexp_replace(title, r"^[ _\-：:]+|[ _\-：:]+$", "")
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), F.lit(UNNAMED)).alias("title"), author.alias("author"))


def base_title(x: Column) -> Column:
    """A title without the part mark at its end."""
    return clean(F.regexp_replace(x, PART_MARK + "$", ""))


# The title that is respaced, and how.
RESPACED = ("我们的十二年一个轮回这是传奇", "我们的十二年 一个轮回 这是传奇")


def site_title(x: Column) -> Column:
    """A book's title as its site has it: without the bar sign and the mark [BL] at its end, and one title respaced."""
    cleaned = clean(F.regexp_replace(F.replace(clean(x), F.lit("丨"), F.lit("")), r"\[BL\]$", ""))
    return F.when(cleaned == RESPACED[0], RESPACED[1]).otherwise(cleaned)


def page_volume(x: Column) -> Column:
    """The volume named in a page's heading, up to a bracket or the word by; empty if none is."""
    found = F.regexp_extract(x, rf"(第{SPACE}*{_ANY}{SPACE}*卷[^()（）]*)", 1)
    return clean(F.regexp_replace(found, r"(?i)(?:^|\s)by\s.*$", ""))


def authors_in(text: Column, query: Column) -> Column:
    """Names that a search result gives for the author: five forms in turn, cleaned, up to 12 characters, each once."""
    # The five forms.
    forms = (
        r"[（(]([^()（）]{1,20})[)）]",
        r"作者\s*[:：]\s*([^\s,，。|｜_《》()（）-]{1,20})",
        r"(?i)\bby\s*([^\s,，。|｜_《》()（）-]{1,20})",
        r"_([^_\s]{1,20})小说",
        r"《[^》]+》\s*([^_\s|｜-]{1,20})",
    )
    # Words that no name has.
    bad = ("最新章节", "全文阅读", "免费阅读", "小说", "在线阅读")
    names = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f), F.lit(1)) for f in forms)))
    names = F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(unescape(n), f"{SPACE}+", ""), "^[_\\-：:|｜]+|[_\\-：:|｜]+$", ""))

    def fine(n):
        ok = (n != "") & (n != query) & (F.length(n) <= 12)
        for b in bad:
            ok = ok & ~F.contains(n, F.lit(b))
        return ok

    return F.array_distinct(F.filter(names, fine))
