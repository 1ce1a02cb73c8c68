"""Books from landed pages: catalogs over several pages, chapters in volumes, entries that link to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound
from ..functions.titles import section_as_chapter, site_title
from ..functions.urls import chapter_ids, entry_key, joined_url
from . import extract, segment


def catalog(pages: DataFrame) -> DataFrame:
    """(book, ord, chapter, title, url, total) of catalogs that are pages(book, section, url, html).

    A page lists chapters by links whose path names category, book and chapter; those of other books don't count, and of one
    chapter's links the first counts. A book's pages are read in order up to the first that lists nothing, or with which
    there are as many chapters as the greatest total that a heading has declared so far; total is that, or the number of chapters.
    """
    target = lambda a: joined_url(F.col("url"), a["href"])
    links = F.transform(extract.anchors(F.col("html")), lambda a: bound(target(a), lambda url: F.struct(chapter_ids(url).alias("ids"), url.alias("url"), section_as_chapter(a["label"]).alias("title"))))
    own = F.filter(links, lambda a: (a["ids"]["chapter"] != "") & (a["ids"]["book"] == F.col("book")) & (a["title"] != ""))
    pages = pages.select("book", "section", own.alias("links"), extract.declared(extract.plain(extract.element(F.col("html"), "h1")))["total"].alias("declared"))
    place = F.struct("section", "place")
    every = pages.select("book", "section", F.posexplode("links").alias("place", "a")).select("book", F.col("a.ids.chapter").alias("chapter"), "section", "place", "a.title", "a.url")
    first = every.groupBy("book", "chapter").agg(F.min_by(F.struct("section", "place", "title", "url"), place).alias("f")).select("book", "chapter", "f.*")
    new = first.groupBy("book", "section").agg(F.count("*").alias("new"))
    order = Window.partitionBy("book").orderBy("section")
    read = pages.select("book", "section", F.size("links").alias("n"), "declared").join(new, ["book", "section"], "left")
    read = read.withColumn("so_far", F.sum(F.coalesce("new", F.lit(0))).over(order)).withColumn("most", F.max(F.coalesce("declared", F.lit(0))).over(order))
    ends = (F.col("n") == 0) | (F.col("most") > 0) & (F.col("so_far") >= F.col("most"))
    read = read.withColumn("over", F.coalesce(F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("over = 0")
    kept = first.join(read.select("book", "section", "most"), ["book", "section"])
    by_book = Window.partitionBy("book")
    kept = kept.withColumn("ord", F.row_number().over(by_book.orderBy("section", "place"))).withColumn("total", F.greatest(F.max("most").over(by_book), F.lit(0)))
    many = F.count("*").over(by_book)
    return kept.select("book", "ord", "chapter", "title", "url", F.coalesce(F.nullif("total", F.lit(0)), many).cast("long").alias("total"))


def chapters(refs: DataFrame, pages: DataFrame, container: str = "main") -> DataFrame:
    """(book, ord, vid, volume, title, texts, error): refs(book, ord, title, volume, url) with their pages(url, html).

    A chapter has its page's own title, or the reference's; its lines without a first one that only repeats the title. A new volume begins
    where the references' label changes. A page that isn't there, has no container or no lines is an error in its chapter's row.
    """
    found = refs.join(pages.select("url", extract.page_record(F.col("html"), container).alias("p")), "url", "left")
    title = segment.chosen_title(F.col("p.title"), F.col("title"))
    texts = F.coalesce(F.col("p.lines"), F.array().cast("array<string>"))
    rows = found.select("book", "ord", "volume", title.alias("title"), texts.alias("texts"), F.when(F.col("p").isNull(), "missing page").otherwise(F.col("p.error")).alias("error"))
    rows = rows.withColumn("texts", segment.without_heading(F.col("texts"), F.col("title")))
    return segment.buckets(rows, "book", "ord", "volume").select("book", "ord", F.col("bucket").alias("vid"), "volume", "title", "texts", "error")


def counted(chapters_: DataFrame) -> DataFrame:
    """(book, n_named_volumes, n_chapters, n_errors) of chapters(book, vid, volume, error)."""
    named = F.count_distinct(F.when(F.col("volume") != "", F.col("vid")))
    return chapters_.groupBy("book").agg(named.alias("n_named_volumes"), F.count("*").alias("n_chapters"), F.count("error").alias("n_errors"))


def related(starts: DataFrame, pages: DataFrame, entry: str, container: str = "main") -> DataFrame:
    """(start, ord, url, html): for every start(url) the entries that its page links to in its container, in order, and their pages.

    Entries are the same if they have the same number, or without one the same URL. A page that links to none is itself the only one;
    pages that haven't landed have a null html.
    """
    known = pages.select(entry_key(F.col("url")).alias("key"), F.col("url").alias("page_url"), "html")
    known = known.groupBy("key").agg(F.min_by("html", "page_url").alias("html"))
    own = starts.select(F.col("url").alias("start"), entry_key(F.col("url")).alias("key")).join(known, "key", "left")
    body = F.coalesce(F.nullif(extract.of_class(F.col("html"), "div", container), F.lit("")), "html", F.lit(""))
    links = F.transform(F.filter(extract.anchors(body), lambda a: a["href"].rlike(entry)), lambda a: bound(a["href"], lambda href: joined_url(F.col("start"), href)))
    links = bound(links, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array("start")))
    listed = own.select("start", F.posexplode(links).alias("place", "url")).withColumn("key", entry_key(F.col("url")))
    first = listed.groupBy("start", "key").agg(F.min("place").alias("place"), F.min_by("url", "place").alias("url"))
    first = first.withColumn("ord", F.row_number().over(Window.partitionBy("start").orderBy("place")))
    return first.join(known, "key", "left").select("start", "ord", "url", "html")


def preview_of(title: str, author: str, result_title: str, result_author: str) -> tuple[Column, Column]:
    """(title, author) of a book's preview: its own, or where it is unnamed or has none the search result's."""
    named = F.when((F.col(title) != "") & (F.col(title) != "未命名"), F.col(title)).otherwise(F.col(result_title))
    return site_title(named), F.coalesce(F.nullif(F.col(author), F.lit("")), F.col(result_author))
