"""Functions on columns against values written out."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text, titles, urls


def values(spark, rows, *columns):
    """Each row's values of the columns made from `x`."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *(c(F.col("x")).alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]


def test_numerals(spark):
    cases = {"十": 10, "二十": 20, "一百零五": 105, "两千": 2000, "二三": 3, "12": 12, "九千九百九十九": 9999, "x": None, "": None, "二x": None}
    assert [v for (v,) in values(spark, list(cases), titles.numeral_value)] == list(cases.values())


def test_match_levels(spark):
    cases = [
        ("", "a", "", "", 0),
        ("abc", "", "", "", 3),
        ("Straße", "STRASSE", "", "", 4),
        ("書", "书", "", "", 4),
        ("全球，高考！", "全球高考", "", "", 4),
        ("sea red", "The red, red sea", "", "", 2),
        ("lin", "x", "Lin Mu", "", 1),
        ("mu", "x", "", "by Mu", 1),
        ("none", "x", "y", "z", 0),
        (None, "x", None, None, 0),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, t string, a string, s string, level int")
    got = df.select("i", "level", text.match_level(F.col("q"), F.col("t"), F.col("a"), F.col("s")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.level for r in got]


def test_search_key_keeps_letters_of_all_scripts(spark):
    assert values(spark, ["全球 高考！½_a", "ÉTÉ d'été", "a b　c"], text.search_key) == [("全球高考½a",), ("étédété",), ("abc",)]


def test_clean_and_escape(spark):
    assert values(spark, ["　a  \n b\t", "<a & b>", "a, b，\tc"], text.clean, text.escape_html, text.comma_spacing)[0][0] == "a b"
    assert values(spark, ["<a & b>"], text.escape_html) == [("&lt;a &amp; b&gt;",)]
    assert values(spark, ["a, b，\tc, \nd"], text.comma_spacing) == [("a,b，c,\nd",)]
    assert values(spark, ["<p>a,</p> <p>b</p>"], text.comma_breaks) == [("<p>a,b</p>",)]
    assert values(spark, ["&amp;lt; &lt;"], text.unescape) == [("&lt; <",)]


def test_safe_names(spark):
    assert values(spark, ["a/b:c?", " .x. ", "", None, "..."], lambda x: text.safe_name(x, "book")) == [("a_b_c_",), ("x",), ("book",), ("book",), ("book",)]


def test_display(spark):
    rows = ["全球高考", "abc", "éx", "全球高考全球高考", None]
    assert values(spark, rows, text.display_width) == [(8,), (3,), (2,), (16,), (0,)]
    assert values(spark, rows[:4], lambda x: text.fit_display(x, F.lit(9))) == [("全球高考 ",), ("abc      ",), ("éx       ",), ("全球高...",)]


def test_titles(spark):
    parts = lambda x: titles.split_title(x)
    got = [tuple(v) for (v,) in values(spark, ["第1章卷一雨夜", "第1章 卷一 雨夜", "第299章外篇：河", "尾声"], parts)]
    assert got == [("第1章", "卷一 雨夜", ""), ("第1章", "卷一 雨夜", ""), ("第299章", "", "外篇：河"), ("尾声", "", "")]
    got = [tuple(v) for (v,) in values(spark, ["远山 第二卷 旧城 by 林木(短篇)", "长街 by Ann Lee", "白鹭（下）", "Baby steps"], titles.title_and_author)]
    assert got == [("远山", "林木"), ("长街", "Ann Lee"), ("白鹭", ""), ("Baby steps", "")]
    assert values(spark, ["第三卷 by the sea", "第二卷 北 (tag)", "x"], titles.page_volume) == [("第三卷",), ("第二卷 北",), ("",)]
    assert values(spark, ["第七节", "第8节", "第七节 x"], titles.section_as_chapter) == [("第七章",), ("第8章",), ("第七节 x",)]


@pytest.mark.parametrize(
    "base, href, joined",
    [
        ("https://a.example/b/c.html", "d.html", "https://a.example/b/d.html"),
        ("https://a.example/b/c.html", "/d", "https://a.example/d"),
        ("https://a.example/b/c.html", "//e.example/d", "https://e.example/d"),
        ("https://a.example", "d", "https://a.example/d"),
        ("https://a.example/b", "mailto:x", "mailto:x"),
    ],
)
def test_joined_urls(spark, base, href, joined):
    assert spark.range(1).select(urls.joined_url(F.lit(base), F.lit(href))).first()[0] == joined


def test_redirects(spark):
    cases = {
        "//find.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%20y&rut=1": "https://a.example/x y",
        "/url?q=https%3A%2F%2Fa.example%2F%3Fx%3D1+2&sa=U": "https://a.example/?x=1+2",
        "/url?sa=U": None,
        "/about": None,
        "https://a.example/p": "https://a.example/p",
    }
    assert [v for (v,) in values(spark, list(cases), urls.redirect_target)] == list(cases.values())


def test_scripts_are_those_of_the_library(spark):
    """All pairs of the rules both ways, in one text each, as the library in the JVM converts them; characters that only our fixed pairs have are left out."""
    from vellum.functions import scripts

    icu = spark._jvm.com.ibm.icu.text.Transliterator
    for name, table, fold in (("Traditional-Simplified", scripts.simplifying(), text.fold_variants), ("Simplified-Traditional", scripts.traditional(), text.unfold_variants)):
        cases = [*table.before, *table.phrases, *(f"x{p} {q}" for p, q in zip(table.phrases, table.before)), "", "plain é 𝄞", "一丁"]
        by_library = icu.getInstance(name).transliterate("\n".join(cases)).split("\n")
        got = [v for (v,) in values(spark, cases, fold)]
        assert got == [table.convert(c) for c in cases]
        fixed = set(scripts.TRADITIONAL + scripts.SIMPLIFIED)
        wrong = [(c, g, w) for c, g, w in zip(cases, got, by_library) if g != w and not set(c) & fixed]
        assert len(cases) > 3000 and wrong == []
    assert values(spark, ["愛國衛生運動與藝術"], text.search_key) == [("爱国卫生运动与艺术",)]


def test_numeric_references(spark):
    cases = {"&#8220;a&#x4E00;&#X1F600;b&#39;": "“a一😀b'", "&amp;#65; &#0;&#xD800;&#1114112;&#x110000;": "&#65; ����", "&#65 &#; &#x;": "&#65 &#; &#x;", "&#38;lt;": "&lt;", "": ""}
    assert [v for (v,) in values(spark, list(cases), text.unescape)] == list(cases.values())
