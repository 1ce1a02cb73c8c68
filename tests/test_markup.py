"""Elements of made pages against a plain parser."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import markup

VOID = ("br", "img", "hr")
INLINE = ("a", "b")
ATTRIBUTES = ["", " class=main", ' class="x main"', " CLASS = mainly", " title='a > b' class='main y'", ' data-x="</div>"', "/"]
LISTS, CELLS = {"ul", "ol"}, {"td", "th", "table"}


def closes(stack, name):
    """How many open elements an opening tag ends: a plain loop from the top of the stack."""

    def up_to(closed, walls):
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in closed:
                return n
            if stack[n][0] in walls:
                return None
        return None

    p = up_to({"p"}, CELLS)
    rules = {"li": ({"li"}, LISTS | CELLS), "dt": ({"dt", "dd"}, {"dl"} | CELLS), "dd": ({"dt", "dd"}, {"dl"} | CELLS), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
    if name in ("tr", "td", "th"):
        found = [up_to(*rules[name])]
    elif name in rules:
        found = [up_to(*rules[name]), p]
    else:
        found = [] if name in ("span", "html", "head", "title", "body") else [p]
    found = [n for n in found if n is not None]
    return min(found) if found else len(stack)


def parsed(html):
    """(tag, inside, depth) of every element, by a stack."""
    found, stack = [], []
    tags = list(re.finditer(rf"</?({'|'.join(markup.NAMES)})(?![a-z0-9:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", html, re.I))
    for m in tags:
        name = m[1].lower()
        if m[0].startswith("</"):
            names = [n for n, _ in stack]
            to = len(names) - 1 - names[::-1].index(name) if name in names else len(stack)
        else:
            to = closes(stack, name)
        while len(stack) > to:
            found[stack.pop()[1]][2] = m.start()
        if not m[0].startswith("</"):
            stack.append((name, len(found)))
            found.append([m[0], m.end(), len(html), len(stack)])
    return [(tag, html[a:b], depth) for tag, a, b, depth in found]


def made(rng):
    out = []
    names = ["div", "div", "ul", "li", "li", "p", "p", "article", "nav", "table", "tr", "td", "dl", "dt", "dd", "span", "h1", "body", *VOID, *INLINE]
    for _ in range(rng.randint(0, 60)):
        name = rng.choice(names)
        kind = rng.random()
        if kind < 0.35:
            out.append(f"</{name}>")
        elif kind < 0.8:
            out.append("<" + name + rng.choice(ATTRIBUTES) + ">")
        else:
            out.append(rng.choice(["text", "a < b", " ", "</", "<", "日本", "<p", ">"]))
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    fixed = ["", "no tags", '<div class="main"><h1>T</h1><p>one</p><div class="note">x</div><p>two</p></div>', "<ul><li>a<ul><li>b</ul><li>c</ul>", "<div class=main><div>never <p>closed", "</div></li>", "<div>" * 300 + "deep" + "</div>" * 299]
    return fixed + [made(rng) for _ in range(1000)]


def test_elements_as_a_plain_parser_finds_them(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    p = df.select("i", markup.page(F.col("html")).alias("p"))
    p = p.select("i", F.transform("p.elements", lambda e: F.struct(markup.tag_of(F.col("p"), e).alias("tag"), markup.inside(F.col("p"), e).alias("inside"), e["depth"].alias("depth"))).alias("e"))
    got = {r.i: [tuple(x) for x in r.e] for r in p.collect()}
    for i, html in enumerate(pages):
        assert got[i] == parsed(html), html


def test_lookups_by_name_and_class(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    html = F.col("html")
    rows = df.select("i", markup.first_inside(html, markup.named("div", "main")).alias("main"), markup.every_inside(html, markup.named("li")).alias("items"), markup.first_inside(html, markup.named("nav")).alias("nav"))
    has_class = lambda tag: re.search(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag, re.I)
    for r in rows.collect():
        found = parsed(pages[r.i])
        classes = lambda tag: "".join(x or "" for x in has_class(tag).groups()).split() if has_class(tag) else []
        assert r.main == next((x for t, x, _ in found if t[:4].lower() == "<div" and "main" in classes(t)), None), pages[r.i]
        assert r["items"] == [x for t, x, _ in found if re.match("<li[ />]", t)]
        assert r.nav == next((x for t, x, _ in found if re.match("<nav[ />]", t)), None)


def test_null_is_null(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS html").select(markup.first_inside(F.col("html"), markup.named("div")).alias("x"), markup.every_inside(F.col("html"), markup.named("div")).alias("y")).first()
    assert row.x is None and not row.y


def test_long_pages_take_time_in_proportion(spark):
    """A page of 60,000 tags, every one unclosed or nested, ends in seconds."""
    html = "<div><p>x<li>y" * 15_000 + "</div>" * 15_000
    n = spark.createDataFrame([(html,)], "html string").select(F.size(markup.page(F.col("html"))["elements"])).first()[0]
    assert n == 45_000
