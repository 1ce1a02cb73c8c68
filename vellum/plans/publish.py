"""Queries of validation and publishing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators import closure, extract, publish, segment, validate
from ..sources.tables import table
from .extract import CONTENTS_SQL, wide_cases, wide_cases_sql
from .segment import ORACLE as SEGMENTS
from .segment import paged_lines


def _numbered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as numbered references, some left out and some repeated."""
    turns = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 11 <> 0")
    copies = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.select("conv_id", "turn", F.explode(copies).alias("copy"))
    return rows.select(F.col("conv_id").alias("package"), F.lit("章").alias("unit"), (F.col("turn") * 2 + F.col("copy")).alias("ord"), (F.col("turn") + 1).alias("number"), F.concat_ws("_", F.col("turn").cast("string"), F.col("copy").cast("string")).alias("href"))


def sequence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sequence_issues(_numbered_turns(spark, sf_dir))


def _ref_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lists as nav; ncx and documents made from them with gaps, other numbers and repeats."""
    nav = extract.contents(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("package"), "ord", "href", F.col("ord").cast("long").alias("number"))
    made = F.expr("""array_compact(array(
        named_struct('source', 'nav', 'ord', ord, 'href', href, 'number', number),
        IF((ord + package) % 7 <> 0, named_struct('source', 'ncx', 'ord', ord, 'href', href, 'number', number + IF((ord + package) % 10 = 0, 1L, 0L)), NULL),
        IF(ord = 1 AND package % 5 = 0, named_struct('source', 'ncx', 'ord', ord, 'href', 'lone-' || href, 'number', number), NULL),
        IF((ord + package) % 7 <> 0 AND (ord + package) % 6 = 0, named_struct('source', 'ncx', 'ord', ord + 100, 'href', href, 'number', number + IF((ord + package) % 10 = 0, 1L, 0L)), NULL),
        IF((ord + package) % 8 <> 0, named_struct('source', 'document', 'ord', ord, 'href', href, 'number', number + IF((ord + package) % 9 = 0, 1L, 0L)), NULL)))""")
    return nav.select("package", F.explode(made).alias("r")).select("package", "r.*")


def xref_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.cross_reference_issues(_ref_sets(spark, sf_dir))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _ref_sets(spark, sf_dir)
    return validate.report(validate.cross_reference_issues(refs), refs)


def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.totals(validation_report(spark, sf_dir))


def _next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in folders of 150, each with a link to the next one; the last of every second folder leads back to its middle, others to the next folder."""
    url = lambda k: F.concat(F.lit("/"), F.expr(f"CAST(({k}) DIV 150 AS STRING)"), F.lit("/"), F.expr(f"CAST({k} AS STRING)"), F.lit(".html"))
    to = F.when(F.expr("page_id % 300 = 149"), url("page_id - 70")).otherwise(url("page_id + 1"))
    return table(spark, sf_dir, "pages").select("page_id", url("page_id").alias("from_url"), to.alias("to_url"))


def pagination_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that next-page links lead to from every fiftieth page, within its folder: chains of up to 150 pages, some of which end in a cycle."""
    links = _next_links(spark, sf_dir)
    return closure.paged(links.where("page_id % 50 = 0").select(F.col("from_url").alias("url")), closure.same_folder(links.select("from_url", "to_url")))


def publish_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.manifest(segment.volumes(paged_lines(spark, sf_dir))).select("book", "spine", "file", "kind", "title", F.sha2("content", 256).alias("content_sha256"))


NAME_ROWS = "(0, 'a/b:c?', 'Lin'), (1, ' .hidden. ', ''), (2, '', 'x|y'), (3, 'two  words', '...')"


NAME_COLUMNS = "ord, title, author"
NAME_MADE = "concat(CASE doc_id % 4 WHEN 0 THEN '..' WHEN 1 THEN 'a/b: ' ELSE '' END, CAST(doc_id AS {s}), '?  x', CASE WHEN doc_id % 3 = 0 THEN ' . ' ELSE '' END), CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '...' WHEN 2 THEN ' Ann <b>' ELSE concat('Lin ', lang) END"


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.when(F.trim("author") == "", "").otherwise(F.concat(safe_name(F.col("author"), "Unknown Author"), F.lit("/")))
    return wide_cases(spark, sf_dir, NAME_COLUMNS, NAME_ROWS, NAME_MADE).select("ord", F.concat(author, safe_name(F.col("title"), "book"), F.lit(".epub")).alias("path"))


QUERIES = {f.__name__: f for f in (sequence_issues, xref_issues, validation_report, validation_totals, pagination_closure, publish_manifest, output_paths)}

_REFS = f"""
  SELECT page_id AS package, 'nav' AS source, ord::BIGINT AS ord, href, ord::BIGINT AS number FROM ({CONTENTS_SQL})
  UNION ALL SELECT page_id, 'ncx', ord, href, ord + CASE WHEN (ord + page_id) % 10 = 0 THEN 1 ELSE 0 END FROM ({CONTENTS_SQL}) WHERE (ord + page_id) % 7 <> 0
  UNION ALL SELECT page_id, 'ncx', ord, 'lone-' || href, ord FROM ({CONTENTS_SQL}) WHERE ord = 1 AND page_id % 5 = 0
  UNION ALL SELECT page_id, 'ncx', ord + 100, href, ord + CASE WHEN (ord + page_id) % 10 = 0 THEN 1 ELSE 0 END FROM ({CONTENTS_SQL}) WHERE (ord + page_id) % 7 <> 0 AND (ord + page_id) % 6 = 0
  UNION ALL SELECT page_id, 'document', ord, href, ord + CASE WHEN (ord + page_id) % 9 = 0 THEN 1 ELSE 0 END FROM ({CONTENTS_SQL}) WHERE (ord + page_id) % 8 <> 0"""
_XREF = f"""
  WITH r AS ({_REFS}), nav AS (SELECT * FROM r WHERE source = 'nav'),
  ncx AS (SELECT package, href, arg_max(number, ord) AS ncx FROM r WHERE source = 'ncx' GROUP BY ALL),
  doc AS (SELECT package, href, arg_min(number, ord) AS document FROM r WHERE source = 'document' GROUP BY ALL),
  j AS (SELECT nav.package, nav.href, nav.number, ncx.ncx, doc.document FROM nav LEFT JOIN ncx USING (package, href) LEFT JOIN doc USING (package, href))
  SELECT package, 'missing from ncx' AS kind, href, number, NULL::BIGINT AS other FROM j WHERE ncx IS NULL
  UNION ALL SELECT package, 'ncx number', href, number, ncx FROM j WHERE ncx <> number
  UNION ALL SELECT package, 'missing document', href, number, NULL FROM j WHERE document IS NULL
  UNION ALL SELECT package, 'document number', href, number, document FROM j WHERE document <> number
  UNION ALL SELECT package, 'missing from nav', href, number, NULL FROM r WHERE source = 'ncx' AND (package, href) NOT IN (SELECT (package, href) FROM nav)"""
_TURNS = """
  SELECT conv_id AS package, '章' AS unit, turn * 2 + copy AS ord, turn + 1 AS number, turn || '_' || copy AS href
  FROM (SELECT *, unnest(CASE WHEN (conv_id + turn) % 13 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM conversations WHERE (conv_id + turn) % 11 <> 0)"""
_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _page(title: str, level: str, inner: str) -> str:
    t = _ESC.format(x=title)
    return f"""'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {t} || '</title><link rel="stylesheet" type="text/css" href="style/main.css"/></head><body><{level}>' || {t} || '</{level}>' || {inner} || '</body></html>'"""


ORACLE = {
    "sequence_issues": f"""
WITH r AS ({_TURNS})
SELECT package, unit, 'duplicate' AS kind, number, string_agg(href, '; ' ORDER BY ord) AS detail FROM r GROUP BY package, unit, number HAVING count(*) > 1
UNION ALL SELECT package, unit, 'order', number, 'after ' || before FROM (SELECT *, lag(number) OVER (PARTITION BY package, unit ORDER BY ord) AS before FROM r) WHERE number <> before AND number <> before + 1
UNION ALL SELECT package, unit, 'missing', number + 1, CASE WHEN after > number + 2 THEN 'to ' || (after - 1) ELSE '' END
  FROM (SELECT *, lead(number) OVER (PARTITION BY package, unit ORDER BY number) AS after FROM (SELECT DISTINCT package, unit, number FROM r)) WHERE after > number + 1""",
    "xref_issues": _XREF,
    "validation_report": f"""
SELECT r.package, r.n_refs, coalesce(i.n, 0) AS n_issues, coalesce(i.n, 0) > 0 AS failed
FROM (SELECT package, count(*) AS n_refs FROM ({_REFS}) GROUP BY package) r LEFT JOIN (SELECT package, count(*) AS n FROM ({_XREF}) GROUP BY package) i USING (package)""",
    "validation_totals": f"""
WITH p AS (SELECT r.n_refs, coalesce(i.n, 0) AS n FROM (SELECT package, count(*) AS n_refs FROM ({_REFS}) GROUP BY package) r LEFT JOIN (SELECT package, count(*) AS n FROM ({_XREF}) GROUP BY package) i USING (package))
SELECT count(*) AS n_packages, count(*) FILTER (WHERE n > 0) AS n_failed, coalesce(sum(n_refs), 0)::BIGINT AS n_refs, coalesce(sum(n), 0)::BIGINT AS n_issues FROM p""",
    "pagination_closure": """
WITH RECURSIVE w AS (
  SELECT page_id AS a, 0::BIGINT AS place, page_id AS p FROM pages WHERE page_id % 50 = 0
  UNION ALL SELECT a, place + 1, CASE WHEN p % 300 = 149 THEN p - 70 ELSE p + 1 END
  FROM w WHERE place < 300 AND p IN (SELECT page_id FROM pages) AND (p % 150 < 149 OR p % 300 = 149))
SELECT '/' || (a // 150) || '/' || a || '.html' AS start, min(place) AS place, '/' || (p // 150) || '/' || p || '.html' AS url FROM w GROUP BY a, p""",
    "publish_manifest": f"""
WITH s AS ({SEGMENTS["segment_volumes"]}),
r AS (SELECT *, dense_rank() OVER (PARTITION BY book ORDER BY vid) AS v, row_number() OVER (PARTITION BY book, vid ORDER BY cid) AS c FROM s),
m AS (SELECT *, max(v) OVER (PARTITION BY book) > 1 AS many FROM r),
f AS (
  SELECT book, v, c, printf('chap_%02d_%03d.xhtml', v, c) AS file, 'chapter' AS kind, chapter AS title,
         {_page("chapter", "h2", "'<p>' || replace(" + _ESC.format(x="regexp_replace(texts, '([，,])[ ' || chr(9) || ']+', '\\1', 'g')") + ", chr(10), '</p>' || chr(10) || '<p>') || '</p>'")} AS content FROM m
  UNION ALL SELECT book, v, 0, printf('vol_%02d.xhtml', v), 'volume', volume, {_page("volume", "h1", "''")} FROM m WHERE c = 1 AND volume <> '' AND many)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY v, c)::INTEGER AS spine, file, kind, title, sha256(content) AS content_sha256 FROM f""",
    "output_paths": r"""
SELECT ord, CASE WHEN trim(author, ' ') = '' THEN '' ELSE coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(author, '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'Unknown Author') || '/' END
  || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'book') || '.epub' AS path
FROM """ + wide_cases_sql(NAME_COLUMNS, NAME_ROWS, NAME_MADE),
}
