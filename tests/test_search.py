"""Search operators on written rows."""

from pyspark.sql import functions as F

from vellum.operators import extract, search
from vellum.sources import tables


def test_first_of_and_top(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), ("b", 3, "z"), (None, 1, "n")], "k string, o int, v string")
    got = {r.k: r.v for r in search.first_of(rows, ["k"], ["o", "v"]).collect()}
    assert got == {"a": "y", "b": None, None: "n"}
    top = search.top_of_each(rows, "k", [F.asc("o"), F.asc("v")], 1).collect()
    assert {(r.k, r.v) for r in top} == {("a", "y"), ("b", None), (None, "n")}


def test_previews(spark):
    toc = spark.createDataFrame([(1, k, t) for k, t in enumerate("abc", 1)] + [(2, 1, "z")], "b int, ord int, label string")
    got = {r.b: (r.n_items, r.first_two, r.last_two) for r in search.previews(toc, "b").collect()}
    assert got == {1: (3, "a|b", "b|c"), 2: (1, "z", "z")}


def test_contents_keep_the_first_of_each_target(spark):
    html = "<nav><a href='/1'>one</a><a href='/2'></a><a href='/1'>again</a><a href='/2'>two</a></nav>"
    rows = extract.contents(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.page_id, r.ord, r.href, r.label) for r in rows] == [(1, 1, "/1", "one"), (1, 2, "/2", "two")]


def test_routing(spark):
    hosts = ["example.com", "m.example.com", "blog.example.com", "notexample.com", "x.archive.example.org", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    first = [r[0] for r in df.orderBy("i").select(tables.routed(F.col("h"))["source"]).collect()]
    long = [r[0] for r in df.orderBy("i").select(tables.routed(F.col("h"), longest=True)["source"]).collect()]
    assert first == ["com", "com", "blog", None, "org", None] and long == ["com", "com", "blog", None, "archive", None]


def test_ranks_keep_ties_in_order(spark):
    rows = spark.createDataFrame([(0, 3, 0.0, 1), (1, 4, 0.0, 0), (2, 3, 0.0, 1), (3, 3, 1.0, 0)], "ord int, level int, raw_score double, priority int")
    assert [r.ord for r in search.ranked(rows, search.result_order(), 3).orderBy("rank").collect()] == [1, 3, 0]
