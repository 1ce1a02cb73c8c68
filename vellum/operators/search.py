"""Search: results of several sources to one ranked list of previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_key


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in the given order, of every key. One aggregation: a key of very many rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*rows.columns)


def top_of_each(rows: DataFrame, key: str, order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of every key, numbered. Each task keeps k rows a key before the shuffle."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) <= k)


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of all, with their rank. Only k rows reach the window."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def result_order() -> list[Column]:
    """Match level, raw score and source priority, each downwards; ties stay in the order in which they came."""
    return [F.desc("level"), F.desc("raw_score"), F.desc("priority"), F.asc("ord")]


def preview_order() -> list[Column]:
    """As result_order, with the number of chapters for the score; an unknown number is the lowest."""
    return [F.desc("level"), F.desc(F.coalesce("chapter_count", F.lit(-1))), F.desc("priority"), F.asc("ord")]


def preview_of(labels: Column) -> Column:
    """struct(n_items, first_two, last_two) of a contents list's labels."""
    return F.struct(
        F.coalesce(F.size(labels), F.lit(0)).cast("long").alias("n_items"),
        F.array_join(F.slice(labels, 1, 2), "|").alias("first_two"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "|").alias("last_two"),
    )


def previews(toc: DataFrame, key: str) -> DataFrame:
    """(key, n_items, first_two, last_two) of contents lists that are tables(key, ord, label)."""
    items = toc.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("items"))
    return items.select(key, preview_of(F.transform("items", lambda i: i["label"])).alias("p")).select(key, "p.*")


def without_near_copies(rows: DataFrame) -> DataFrame:
    """One preview of each (source, title key, author key, count, first, last): of the lowest blog entry number, then URL. A URL without one counts as 0."""
    entry = F.coalesce(F.regexp_extract("url", r"blog-entry-(\d+)\.html", 1).try_cast("long"), F.lit(0))
    keyed = rows.withColumns({"_t": search_key(F.col("title")), "_a": search_key(F.col("author")), "_e": entry})
    return first_of(keyed, ["source", "_t", "_a", "chapter_count", "first_two", "last_two"], ["_e", "url", "ord"]).drop("_t", "_a", "_e")
