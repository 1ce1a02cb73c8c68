"""Landed tables, literal relations, and the table of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charsets import decoded
from ..functions.urls import in_domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """A relation written out as SQL rows."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API answers, one JSON object a line, by a declared schema."""
    return spark.read.schema(schema).json(path)


def landed_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Whole files of a folder, without its subfolders."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def decoded_file(content: Column, charset: str | None = "UTF-8") -> Column:
    """The text of a file's bytes; without a charset in the one that is found for it (functions/charsets.py). What doesn't fit becomes the replacement sign."""
    return decoded(content)["text"] if charset is None else F.decode(content, charset)


#: The sources: where each stands in order, its name, domain and rank among equals, and whether it can be searched.
SOURCES = (
    (0, "blog", "blog.example.com", 2, True),
    (1, "com", "example.com", 3, True),
    (2, "net", "example.net", 1, True),
    (3, "org", "example.org", 0, True),
    (4, "archive", "archive.example.org", 0, False),
)
SOURCE_COLUMNS = ("ord", "source", "domain", "priority", "searchable")
SOURCE_ROWS = ", ".join(f"({o}, '{s}', '{d}', {p}, {str(x).lower()})" for o, s, d, p, x in SOURCES)


def sources(spark: SparkSession) -> DataFrame:
    return literal(spark, ", ".join(SOURCE_COLUMNS), SOURCE_ROWS)


def routed(host: Column, longest: bool = False) -> Column:
    """struct(ord, source, domain, priority, searchable): the first source whose domain the host is in, or the one with the
    longest such domain; null for none. The table is a constant, so rows are routed where they are."""
    rows = sorted(SOURCES, key=lambda r: -len(r[2])) if longest else SOURCES
    constant = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(SOURCE_COLUMNS, r, strict=True))) for r in rows))
    return F.get(F.filter(constant, lambda r: in_domain(host, r["domain"])), F.lit(0))


def chosen(host: Column, name: Column) -> Column:
    """struct(source, error): the source of a name, whatever the host, or where the name is null the first whose domain the host is in; an
    error lists the names, or the domains, that there are."""
    names, domains = ", ".join(r[1] for r in SOURCES), ", ".join(r[2] for r in SOURCES)
    by_name = F.when(name.isin(*(r[1] for r in SOURCES)), name)
    source = F.when(name.isNotNull(), by_name).otherwise(routed(host)["source"])
    unknown = F.when(name.isNotNull(), F.concat(F.lit("unknown source "), name, F.lit(f"; choose one of: {names}"))).otherwise(F.lit(f"no source for the host; supported domains: {domains}"))
    return F.struct(source.alias("source"), F.when(source.isNull(), unknown).alias("error"))
