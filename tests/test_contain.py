"""Containment joins against nested loops, and author search against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import contain


def nested(left, right):
    return sorted((a, b) for a in set(left) for b in set(right) if a and b and (a in b or b in a))


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_are_those_of_a_nested_loop(spark, seed):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice("abé日本𝄞") for _ in range(rng.randint(0, most)))
    left = [word(5) for _ in range(200)] + [None, "", "aaaa", "aaa"]
    right = [word(12) for _ in range(200)] + left[:50] + ["a" * 50]
    got = contain.overlapping(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"))
    assert sorted(map(tuple, got.collect())) == nested(left, right)


def test_all_titles_against_all_titles_without_a_nested_loop(spark, sf_dir):
    from vellum.operators import extract

    titles = extract.metadata(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(text.title_key(F.col("title")).alias("a"))
    got = contain.overlapping(titles, titles.withColumnRenamed("a", "b"))
    keys = [r.a for r in titles.collect()]
    assert sorted(map(tuple, got.collect())) == nested(keys, keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_third_of_all_texts_the_same(spark):
    """A hot text is one distinct text, and a piece that most texts have isn't looked up where another is rarer."""
    left = ["the same"] * 3000 + [f"the {k}" for k in range(1000)] + ["zz"]
    right = ["the same thing"] * 3000 + [f"the {k} the" for k in range(0, 1000, 7)]
    got = contain.overlapping(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")).collect()
    assert sorted(map(tuple, got)) == nested(left, right)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a string")
    some = spark.createDataFrame([("x",)], "b string")
    assert contain.overlapping(none, some).collect() == [] and contain.overlapping(some.withColumnRenamed("b", "a"), none.withColumnRenamed("a", "b")).collect() == []


def test_author_search(spark):
    answers = [
        ("Sea", 0, 1, "Sea (Lin)", "by Mu"), ("Sea", 0, 0, "x", "作者：Zhou"), ("Sea", 1, 0, "by Lin", "(Sea)(A)(B)(C)"), ("Sea", 2, 0, "(D)", ""), ("Sky", 0, 0, "none", None), ("", 0, 0, "(E)", "e"),
    ]
    books = [("Zhou", 1, "Red Sea", "u1"), ("Zhou", 0, "《S e a》", "u2"), ("Lin", 0, "the Sea", "no"), ("Mu", 0, "Sea!", "u1"), ("Mu", 1, "S", "u3"), ("Mu", 2, "", "u4"), ("A", 0, "Sea", "u5"), ("C", 0, "Sea", "u6"), ("E", 0, "E", "u7")]
    answers = spark.createDataFrame(answers, "query string, form int, rank int, title string, description string")
    people = sorted((r.query, r.place, r.author) for r in contain.author_candidates(answers).collect())
    assert people == [("", 1, "E"), ("Sea", 1, "Zhou"), ("Sea", 2, "Lin"), ("Sea", 3, "Mu"), ("Sea", 4, "A"), ("Sea", 5, "B")]
    got = contain.author_search(answers, spark.createDataFrame(books, "author string, ord int, title string, url string"), 4).orderBy("rank").collect()
    assert [(r.query, r.rank, r.author, r.url, r.score) for r in got] == [("Sea", 1, "Zhou", "u2", 4.0), ("Sea", 2, "Zhou", "u1", 3.0), ("Sea", 3, "Lin", "no", 2.0), ("Sea", 4, "Mu", "u3", 1.0)]
