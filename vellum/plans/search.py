"""Queries of searching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.text import bound
from ..operators import extract, search
from ..sources.tables import SOURCE_ROWS, routed, sources, table
from .extract import _PARTS, CONTENTS_SQL, META_SQL, canonical_sql, key_sql, level_sql, wide_cases, wide_cases_sql

QUERY, PER_SOURCE, LIMIT = "the of", 5, 10


def _results(pages: DataFrame) -> DataFrame:
    """Two engines' results over the pages: (engine_ord, ord, source, url)."""
    url = F.col("url")
    one = pages.select(F.lit(0).alias("engine_ord"), F.col("page_id").alias("ord"), urls.bare_host(urls.host(url)).alias("source"), urls.canonical_url(url).alias("url"))
    two = pages.where("page_id % 3 = 0").select(F.lit(1).alias("engine_ord"), F.col("page_id").alias("ord"), urls.bare_host(urls.host(url)).alias("source"), urls.canonical_url(F.concat(url, F.lit("#again"))).alias("url"))
    return one.unionByName(two)


def results_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_of(_results(table(spark, sf_dir, "pages")), ["source", "url"], ["engine_ord", "ord"])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, source, url, title, priority, level) of the pages of searchable sources; of two domains a host is in, the longer counts. Rows stay where they are."""
    pages = table(spark, sf_dir, "pages")
    rows = extract.metadata(pages, "url").withColumn("route", routed(urls.host(F.col("url")), longest=True)).where("route.searchable")
    return rows.select(
        F.col("page_id").alias("ord"),
        "route.source",
        urls.canonical_url(F.col("url")).alias("url"),
        "title",
        "route.priority",
        text.match_level(F.lit(QUERY), F.col("title"), F.lit(""), F.col("intro")).alias("level"),
    )


def rank_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five results a source at most, scored by their place in it, then the best ten."""
    some = search.top_of_each(_scored(spark, sf_dir), "source", [F.desc("level"), F.asc("ord")], PER_SOURCE)
    scored = some.withColumn("raw_score", (PER_SOURCE - F.col("place") + 1).cast("double"))
    return search.ranked(scored, search.result_order(), LIMIT).select("rank", "source", "ord", "level", "raw_score", "priority")


def _labels(html: str = "html"):
    return F.transform(extract.contents_of(F.col(html)), lambda a: a["label"])


def preview_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's title, intro and the ends of its contents list, in one pass; a page without a list has none of its ends."""
    rows = extract.metadata(table(spark, sf_dir, "pages"), "html").select("page_id", "title", "intro", bound(_labels(), search.preview_of).alias("p"))
    some = F.col("p.n_items") > 0
    return rows.select("page_id", "title", "intro", "p.n_items", *(F.when(some, F.col(f"p.{c}")).alias(c) for c in ("first_two", "last_two")))


PREVIEW_COLUMNS = "ord, source, title, author, url, chapter_count, first_two, last_two"
PREVIEW_ROWS = """
  (0, 'com', 'Red Sea', 'Lin', 'https://a.example/1', 12, 'a|b', 'y|z'), (1, 'blog', 'red  sea', 'lin', 'http://b.example/blog-entry-20.html', 12, 'a|b', 'y|z'),
  (2, 'blog', 'Red Sea!', 'LIN', 'http://b.example/blog-entry-7.html', 12, 'a|b', 'y|z'), (3, 'net', 'Red', 'Mu', 'https://c.example/3', CAST(NULL AS INT), '', ''),
  (4, 'org', 'Sea red', '', 'https://d.example/4', 40, 'c', 'c'), (5, 'net', 'Other', 'Red Sea', 'https://c.example/5', 3, 'q', 'q'),
  (6, 'com', '', 'x', 'https://a.example/6', 1, 'q', 'q'), (7, 'blog', 'Red Sea', 'Lin', 'http://b.example/about', 12, 'a|b', 'y|z'), (8, 'org', 'None', '', 'https://d.example/8', 40, 'c', 'c')"""


PREVIEW_MADE = """CASE doc_id % 3 WHEN 0 THEN 'blog' WHEN 1 THEN 'net' ELSE 'nowhere' END, concat(CASE WHEN doc_id % 2 = 0 THEN 'RED sea! ' ELSE 'Sea of red ' END, CAST(doc_id % 5 AS {s})), CASE WHEN doc_id % 4 = 0 THEN 'Lin' ELSE 'Red-Sea' END,
  concat('http://b.example/', CASE WHEN doc_id % 7 = 0 THEN 'about' ELSE concat('blog-entry-', CAST(doc_id AS {s}), '.html') END), CAST(doc_id % 3 + 30 AS INT), 'a|b', 'y|z'"""


def preview_dedupe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.without_near_copies(wide_cases(spark, sf_dir, PREVIEW_COLUMNS, PREVIEW_ROWS, PREVIEW_MADE)).withColumn("level", text.match_level(F.lit("red sea"), F.col("title"), F.col("author"), F.lit("")))
    rows = rows.join(F.broadcast(sources(spark).select("source", "priority")), "source", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return search.ranked(rows, search.preview_order(), LIMIT).select("rank", "ord", "source", "level", "chapter_count")


def search_preview_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages routed to sources, deduped by URL, scored, the best ten previewed and ranked."""
    scored = search.first_of(_scored(spark, sf_dir), ["source", "url"], ["ord"]).withColumn("raw_score", F.lit(0.0))
    best = scored.orderBy(*search.result_order()).limit(LIMIT)
    # Ten rows are broadcast to find their pages.
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    rows = pages.join(F.broadcast(best), pages["page_id"] == best["ord"]).withColumn("p", bound(_labels(), search.preview_of)).select(*best.columns, F.col("p.n_items").alias("chapter_count"), "p.first_two", "p.last_two")
    rows = rows.withColumns({c: F.when(F.col("chapter_count") > 0, F.col(c)) for c in ("first_two", "last_two")})
    return search.ranked(rows, search.preview_order(), LIMIT).select("rank", "source", "title", "url", "level", "chapter_count", "first_two", "last_two")


QUERIES = {f.__name__: f for f in (results_dedupe, rank_topk_per_source, preview_build, preview_dedupe_rank, search_preview_rank)}

_BARE = rf"regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^(?:www|m)\.', '')"
_RESULTS = f"""
  SELECT 0 AS engine_ord, page_id AS ord, {_BARE} AS source, {canonical_sql("url")} AS url FROM pages
  UNION ALL SELECT 1, page_id, {_BARE}, {canonical_sql("(url || '#again')")} FROM pages WHERE page_id % 3 = 0"""
_SCORED = rf"""
  SELECT ord, source, url, title, priority, {level_sql(f"'{QUERY}'", "title", "''", "intro")} AS level
  FROM (SELECT p.page_id AS ord, s.source, {canonical_sql("p.url")} AS url, p.title, p.intro, s.priority, s.searchable,
               row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.domain) DESC, s.source) AS k
        FROM (SELECT *, lower(regexp_extract(url, '{_PARTS}', 2)) AS host FROM ({META_SQL})) p
        JOIN (VALUES {SOURCE_ROWS}) s(sord, source, domain, priority, searchable) ON p.host = s.domain OR suffix(p.host, '.' || s.domain))
  WHERE k = 1 AND searchable"""
_PREVIEWS = f"""
  SELECT page_id, count(*) AS n_items, array_to_string(list(label ORDER BY ord)[1:2], '|') AS first_two, array_to_string(list(label ORDER BY ord)[-2:], '|') AS last_two
  FROM ({CONTENTS_SQL}) GROUP BY page_id"""

ORACLE = {
    "results_dedupe": f"SELECT engine_ord, ord, source, url FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY engine_ord, ord) AS k FROM ({_RESULTS})) WHERE k = 1",
    "rank_topk_per_source": f"""
SELECT rank, source, ord, level, raw_score, priority FROM (
  SELECT *, row_number() OVER (ORDER BY level DESC, raw_score DESC, priority DESC, ord)::INTEGER AS rank FROM (
    SELECT *, ({PER_SOURCE} - place + 1)::DOUBLE AS raw_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC, ord) AS place FROM ({_SCORED})) WHERE place <= {PER_SOURCE}))
WHERE rank <= {LIMIT}""",
    "preview_build": f"SELECT m.page_id, m.title, m.intro, coalesce(p.n_items, 0) AS n_items, p.first_two, p.last_two FROM ({META_SQL}) m LEFT JOIN ({_PREVIEWS}) p USING (page_id)",
    "preview_dedupe_rank": rf"""
WITH t AS (SELECT * FROM {wide_cases_sql(PREVIEW_COLUMNS, PREVIEW_ROWS, PREVIEW_MADE)}),
d AS (SELECT *, row_number() OVER (PARTITION BY source, {key_sql("title")}, {key_sql("author")}, chapter_count, first_two, last_two
      ORDER BY coalesce(try_cast(regexp_extract(url, 'blog-entry-(\d+)\.html', 1) AS BIGINT), 0), url, ord) AS k FROM t),
s AS (SELECT d.ord, d.source, d.chapter_count, coalesce(s.priority, 0) AS priority, {level_sql("'red sea'", "d.title", "d.author", "''")} AS level
      FROM d LEFT JOIN (VALUES {SOURCE_ROWS}) s(sord, source, domain, priority, searchable) ON d.source = s.source WHERE d.k = 1)
SELECT * FROM (SELECT row_number() OVER (ORDER BY level DESC, coalesce(chapter_count, -1) DESC, priority DESC, ord)::INTEGER AS rank, ord, source, level, chapter_count FROM s) WHERE rank <= {LIMIT}""",
    "search_preview_rank": f"""
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY ord) AS k FROM ({_SCORED})) WHERE k = 1),
b AS (SELECT * FROM s ORDER BY level DESC, priority DESC, ord LIMIT {LIMIT})
SELECT row_number() OVER (ORDER BY b.level DESC, coalesce(p.n_items, 0) DESC, b.priority DESC, b.ord)::INTEGER AS rank, b.source, b.title, b.url, b.level,
       coalesce(p.n_items, 0) AS chapter_count, p.first_two, p.last_two
FROM b LEFT JOIN ({_PREVIEWS}) p ON p.page_id = b.ord""",
}
