"""Joins on one text containing another, as equi-joins on the rarest piece of the shorter one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, title_key
from ..functions.titles import authors_in
from . import search

#: Characters of the pieces by which long texts find each other; shorter texts are pieces themselves.
PIECE = 3


def pieces(x: Column, size: int) -> Column:
    """The distinct pieces of a size that a text has."""
    return bound(F.length(x), lambda n: F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array().cast("array<string>")))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): the pairs of distinct texts of parts(part) and wholes(whole) of which the second contains the first.

    A part is in a whole only if all its pieces are. So each part is looked up by the one that the fewest wholes have, in an index of the wholes' pieces; what is found is
    checked. A part with a piece that no whole has is looked up nowhere. Texts of fewer characters than a piece are found as they are. Nulls and empty parts are in nothing.
    """
    parts = parts.where("part <> ''").select("part").distinct()
    wholes = wholes.where("whole <> ''").select("whole").distinct()
    short = [r[0] for r in parts.where(F.length("part") < PIECE).select(F.length("part")).distinct().collect()]  # fewer than PIECE numbers
    sizes = sorted({*short, PIECE})
    index = wholes.select("whole", F.explode(F.flatten(F.array(*(pieces(F.col("whole"), n) for n in sizes)))).alias("piece"))
    counts = index.groupBy("piece").agg(F.count("*").alias("n"))
    own = parts.select("part", F.explode(F.when(F.length("part") < PIECE, F.array("part")).otherwise(pieces(F.col("part"), PIECE))).alias("of"))
    known = own.join(counts, F.col("of") == F.col("piece"), "left")
    rarest = known.groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("of").alias("piece"))).alias("r"))
    rarest = rarest.where("r.n > 0").select("part", F.col("r.piece").alias("by"))
    return rarest.join(index, F.col("by") == F.col("piece")).where(F.contains("whole", "part")).select("part", "whole")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct texts of left(a) and right(b) of which one contains the other. Nulls and empty texts overlap with nothing."""
    into = contained(left.select(F.col("a").alias("part")), right.select(F.col("b").alias("whole"))).select(F.col("part").alias("a"), F.col("whole").alias("b"))
    over = contained(right.select(F.col("b").alias("part")), left.select(F.col("a").alias("whole"))).where("part <> whole").select(F.col("whole").alias("a"), F.col("part").alias("b"))
    return into.unionByName(over)


def author_candidates(answers: DataFrame, most: int = 5) -> DataFrame:
    """(query, place, author): the authors that answers(query, form, rank, title, description) name, in the order of forms, results and places in them, each once, and `most` for a query."""
    text = F.concat_ws(" ", "title", "description")
    named = answers.select("query", "form", "rank", F.posexplode(authors_in(text, F.col("query"))).alias("at", "author"))
    order = ["form", "rank", "at"]
    first = named.groupBy("query", "author").agg(F.min(F.struct(*order)).alias("f")).select("query", "author", "f.*")
    return search.top_of_each(first, "query", [F.asc(c) for c in order], most, "place").select("query", "place", "author")


def author_search(answers: DataFrame, books: DataFrame, limit: int = 10) -> DataFrame:
    """(query, rank, author, title, url, score): for each query the books of the authors that its answers name, whose titles contain it or are contained in it.

    books(author, ord, title, url) are the authors' own pages. Books come in the order of authors and pages, each URL once, `limit` a query; the score falls by one from the limit. Keys of titles are
    compared; a query or title whose key is empty matches none.
    """
    people = author_candidates(answers)
    found = people.join(books.select(F.col("author").alias("of"), "ord", "title", "url"), F.col("author") == F.col("of"))
    a, b = title_key(F.col("query")), title_key(F.col("title"))
    found = found.where((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))
    once = found.groupBy("query", "url").agg(F.min(F.struct("place", "ord", "author", "title")).alias("f")).select("query", "url", "f.*")
    ranked = search.top_of_each(once, "query", [F.asc("place"), F.asc("ord"), F.asc("url")], limit, "rank")
    return ranked.select("query", "rank", "author", "title", "url", (F.lit(limit + 1) - F.col("rank")).cast("double").alias("score"))
