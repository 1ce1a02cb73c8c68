"""Publishing: chapters to the ordered files of a package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import comma_spacing, escape_html

_HEAD = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{}</title><link rel="stylesheet" type="text/css" href="style/main.css"/></head><body>'
_TAIL = "</body></html>"


def identifier(source, book):
    """The same for the same source and book, whenever it is made."""
    return F.sha2(F.concat_ws("-", source, book.cast("string")), 256)


def manifest(chapters: DataFrame, single_volume: bool = False) -> DataFrame:
    """(book, spine, file, kind, title, content): chapters(book, vid, cid, volume, chapter, texts) as the files of a package in reading order.

    Volumes and chapters are numbered in order. A volume has a page of its own if it has a title and the book
    has other volumes, or single_volume is set. Texts become paragraphs: comma spacing
    normalised, markup escaped.
    """
    by_book = Window.partitionBy("book")
    rows = chapters.withColumn("v", F.dense_rank().over(by_book.orderBy("vid"))).withColumn("c", F.row_number().over(Window.partitionBy("book", "vid").orderBy("cid")))
    rows = rows.withColumn("many", F.max("v").over(by_book) > 1)
    covered = (F.col("c") == 1) & (F.col("volume") != "") & (F.col("many") | F.lit(single_volume))
    # Files are numbered before their contents are made: a chapter's place is its own number and that of the volume pages up to it.
    order = by_book.orderBy("vid", "cid")
    rows = rows.withColumn("covered", covered).withColumn("spine", (F.row_number().over(order) + F.sum(F.col("covered").cast("int")).over(order)).cast("int"))
    body = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("<p>"), escape_html(comma_spacing(t)), F.lit("</p>"))), "\n")
    page = lambda title, level, inner: F.concat(F.format_string(_HEAD.replace("{}", "%s"), escape_html(title)), F.lit(f"<{level}>"), escape_html(title), F.lit(f"</{level}>"), inner, F.lit(_TAIL))
    file = lambda spine, name, kind, title, content: F.struct(spine.alias("spine"), name.alias("file"), F.lit(kind).alias("kind"), title.alias("title"), content.alias("content"))
    chapter = file(F.col("spine"), F.format_string("chap_%02d_%03d.xhtml", "v", "c"), "chapter", F.col("chapter"), page(F.col("chapter"), "h2", body))
    cover = file(F.col("spine") - 1, F.format_string("vol_%02d.xhtml", "v"), "volume", F.col("volume"), page(F.col("volume"), "h1", F.lit("")))
    files = rows.select("book", F.explode(F.array_compact(F.array(F.when(F.col("covered"), cover), chapter))).alias("f"))
    return files.select("book", "f.*")
