"""What packages refer to, with the numbers in it, and books as the rows of the package sink."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import chapter_number, chapter_unit
from . import epub


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumns({"number": chapter_number(F.col("title")), "unit": chapter_unit(F.col("title"))})


def refs_of(files: DataFrame) -> DataFrame:
    """(package, source, ord, href, title, number, unit) of packages that are files(path, content); a document's numbered heading is its first."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *ref) for path, content in zip(frame["path"], frame["content"], strict=True) for ref in epub.references(io.BytesIO(content))]
            yield pd.DataFrame(rows, columns=["package", "source", "ord", "href", "title"]).astype({"ord": "int32"})

    return _numbered(files.select(F.col("path").cast("string").alias("path"), "content").mapInPandas(read, epub.REFERENCES))


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """The same of all packages of a folder, which are read where they lie; package is the file's name."""
    return _numbered(epub.read_references(spark, folder))


def package_files(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """epub.FILES: manifests(book, spine, file, kind, title, content) after a row for each of their books(book, name, title, identifier).

    books may have author, language, intro (HTML), intro_title, cover (bytes) and cover_mime, too; a null is as if it weren't there. name is the file's, without its
    extension. Books without files are packages without chapters; files of unknown books aren't written.
    """
    more = [c for c in ("identifier", "author", "language", "intro", "intro_title", "cover_mime") if c in books.columns]
    cover = F.col("cover").cast("binary") if "cover" in books.columns else F.lit(None).cast("binary")
    none = F.lit(None).cast("string")
    heads = books.select("name", F.lit(-1).alias("spine"), F.lit("book").alias("kind"), none.alias("file"), "title", F.to_json(F.struct(*more)).alias("content"), cover.alias("data"))
    rows = manifest.join(books.select(F.col("book").alias("of"), "name"), F.col("book") == F.col("of"))
    return heads.unionByName(rows.select("name", "spine", "kind", "file", "title", "content", F.lit(None).cast("binary").alias("data")))


def write_books(manifest: DataFrame, books: DataFrame, folder: str) -> None:
    """package_files written to a folder, a package a book."""
    epub.write_packages(package_files(manifest, books), folder)
