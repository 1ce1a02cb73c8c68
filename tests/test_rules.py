"""Rules in rows, and the selectors that they use."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import selectors
from vellum.operators import rules

PAGE = """<html lang=de><head><title>T &amp; t</title></head><body><nav><ul><li><a href=1>One</a><li><a href='2'>Two</a><a href=1>again</a><a href=3> </a></ul></nav>
<div class="main wide" id=m><h1></h1><div><p>a<b>b</b><p>c <span class=x>d</span></div><p class="x">e</div><footer>© Ann · 2020</footer><script>"<p class=x>no</p>"</script></body>"""


@pytest.mark.parametrize(
    "selector, texts",
    [("p", ["ab", "c d", "e"]), ("div.main div p", ["ab", "c d"]), (".x", ["d", "e"]), ("#m p.x", ["e"]), ("div.wide.main > p".replace(" > ", " "), ["ab", "c d", "e"]), ("nav a", ["One", "Two", "again", ""]), ("li", ["One", "Twoagain"]), ("section p", []), ("* span", ["d"])],
)
def test_selectors(selector, texts):
    assert [selectors.text_of(e.inside) for e in selectors.selected(selectors.elements(PAGE), selector)] == texts


def test_a_selector_that_cannot_be_read_is_an_error():
    with pytest.raises(ValueError, match="not a selector"):
        selectors.parsed("p > a[href]")


def test_rules_are_rows(spark):
    table = spark.createDataFrame(
        [
            ("a", "title", 0, "h1", None, None, 1, None, False), ("a", "title", 1, "title", None, None, 1, None, False), ("a", "links", 0, "nav a", None, None, None, "href", True),
            ("a", "owner", 0, "footer", None, "© ([^·]*)·", None, None, None), ("a", "lang", 0, "html", "lang", None, 1, None, None), (None, "text", None, "p", None, None, 2, None, None),
        ],
        rules.RULES,
    )
    pages = spark.createDataFrame([(1, "a", PAGE), (2, "b", PAGE), (3, None, PAGE), (4, "a", None), (5, "a", "")], "page_id long, source string, html string").withColumn("field_", F.lit("clash"))
    got = sorted((r.page_id, r.field, r.ord, r.value, r.beside) for r in rules.ruled(pages, table).collect())
    first = [(1, "lang", 1, "de", None), (1, "links", 1, "One", "1"), (1, "links", 2, "Two", "2"), (1, "owner", 1, "Ann", None), (1, "title", 1, "T & t", None)]
    assert got == first + [(p, "text", k, t, None) for p in (2, 3) for k, t in ((1, "ab"), (2, "c d"))]
    assert rules.ruled(pages.limit(0), table).collect() == [] and rules.ruled(pages, table.limit(0)).collect() == []


def test_references_as_in_columns(spark):
    from vellum.functions import text

    cases = ["&#8220;a&#x4E00;&#X1F600;b&#39;", "&amp;#65; &#0;&#xD800;&#1114112;", "&#65 &#; &amp", "&#38;lt;&nbsp;x&copy;&eacute;"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", text.unescape(F.col("x")).alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [selectors.unescape(c) for c in cases]
