"""Queries of segmentation, with their SQL. Markers are made from line numbers, since landed documents have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound
from ..operators import extract, scan, segment
from ..sources.tables import table
from .extract import CONTENTS_SQL


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


_LINES = "SELECT doc_id AS book, (unnest(range(len(l))))::INTEGER AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_texts", F.size("texts").cast("long")).withColumn("texts", F.array_join("texts", "\n"))


_MARKED = """CASE WHEN line_no % 13 = 5 THEN '第' || {k13} || '卷 夜' WHEN line_no % 13 = 6 THEN '第' || {k13} || '卷 夜 完' WHEN line_no % 4 = 2 THEN '第' || {k4} || '章 雨'
  WHEN line_no % 17 = 3 THEN '（上）' WHEN line_no % 29 = 4 THEN 'Chapter ' || {k4} ELSE text END"""
_PAGED = """CASE WHEN line_no % 10 = 0 AND line_no % 20 = 0 THEN '第' || {k30} || '卷 页' END"""


def _divided(sql: str, spark: bool) -> str:
    return sql.format(**{f"k{n}": f"CAST(line_no {'DIV' if spark else '//'} {n} AS STRING)" for n in (4, 10, 13, 30)})


def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with made headings and marks. As in the SQL, a page whose first line is a mark to skip has no heading; the operator would take it."""
    lines = _lines(spark, sf_dir).select("book", F.expr("line_no DIV 10").alias("page"), "line_no", F.expr(_divided(_PAGED, True)).alias("heading"), F.expr(_divided(_MARKED, True)).alias("text"))
    return lines.withColumn("heading", F.when(~F.col("text").rlike(segment.SKIP), F.col("heading")))


def segment_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(segment.volumes(paged_lines(spark, sf_dir)))


def segment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN line_no % 6 = 4 THEN 'B 第' || CAST(line_no DIV 6 AS STRING) || '回  夜' WHEN line_no % 6 = 5 THEN '【第1回】' ELSE text END")
    return _flat(segment.turns(_lines(spark, sf_dir).select("book", F.concat(F.lit("B"), F.col("book").cast("string")).alias("title"), "line_no", text.alias("text"))))


_NUMBERED = "CASE WHEN line_no % 5 = 1 AND book % 7 <> 3 THEN CAST((line_no {div} 5 + book % 3) % 9 AS STRING) ELSE text END"


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("book", F.expr("line_no DIV 7").alias("c"), F.col("line_no").alias("k"), F.expr(_NUMBERED.format(div="DIV")).alias("text"))


def sections_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sections_merged(_chapters(spark, sf_dir))


def sections_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sections_first(_chapters(spark, sf_dir))


def sections_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.missing_numbers(segment.sections_first(_chapters(spark, sf_dir)))


def volume_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.buckets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return rows.groupBy("conv_id", "bucket").agg(F.min("role").alias("label"), F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"))


def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a text's pages of two paragraphs; a page of odd length goes on where the one before it ended."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return segment.runs_joined(turns, "conv_id", "turn", F.expr("turn % 2 = 0 AND length(text) % 2 = 1"))


def comma_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut after every second comma, joined again."""
    lines = _lines(spark, sf_dir).select("book", "line_no", F.expr("CASE WHEN line_no % 3 = 0 THEN text || ',' ELSE text END").alias("text")).where("trim(text) <> ''")
    return segment.comma_merged(lines, "book", "line_no")


def take_until_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document before the first that holds a row of symbols."""
    return segment.until(_lines(spark, sf_dir), "book", "line_no", F.col("text").rlike("[#*$%&]{3}"))


def toc_title_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = extract.contents(table(spark, sf_dir, "pages")).select("page_id", "ord", "label")
    return segment.titles_repaired(toc, "page_id", "ord", "label", F.col("label").rlike("[.,]$"))


def intro_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document's paragraphs come again in the next one of its source, by id. Keys and marks are made once a document, before they meet."""
    lines = F.split("text", "\n")
    keys = F.transform(segment.comparison_keys(lines), lambda k: F.xxhash64(k))  # what is compared is numbers, not paragraphs
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", keys.alias("keys"), segment.marker_hits(lines, ("the ", "and ")).alias("hits"))
    # A source of a third of all documents is walked in parts.
    pairs = scan.running(docs, ["source"], ["doc_id"], scan.fits(docs, "source"), before=scan.last(F.struct(F.col("doc_id").alias("a"), "keys"), before=True)).where("before IS NOT NULL")
    pairs = pairs.select("before.a", F.col("before.keys").alias("intro"), F.col("keys").alias("chapter"), "hits")
    found = pairs.select("a", bound(segment.shared(F.col("intro"), F.col("chapter")), lambda share: F.struct(share.alias("share"), (share >= 0.6).alias("much"))).alias("x"), "hits")
    return found.select("a", "x.share", "hits", F.coalesce((F.col("hits") >= 3) | F.col("x.much"), F.lit(False)).alias("repeats"))


# Every document is a book: its first lines are the intro, and its first chapter repeats them, alone or before others, or has other lines or marks.
_BEGIN = "slice(l, 1, CAST(1 + doc_id % 3 AS INT))"
_AFTER = "slice(l, CAST(2 + doc_id % 3 AS INT), size(l))"
_FIRST_CHAPTER = f"CASE doc_id % 4 WHEN 0 THEN {_BEGIN} WHEN 1 THEN concat({_BEGIN}, {_AFTER}) WHEN 2 THEN {_AFTER} ELSE concat(array('文案：x', '内容标签', '立意'), {_AFTER}) END"


def intro_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' chapters without first ones that only say the intro again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    chapter = lambda cid, title, texts: F.struct(F.lit(cid).alias("cid"), title.alias("chapter"), texts.alias("texts"))
    both = F.array(chapter(0, F.when(F.col("doc_id") % 5 == 0, "第1章 x").otherwise("第0章 x"), F.expr(_FIRST_CHAPTER)), chapter(1, F.lit("第2章"), F.col("l")))
    chapters = docs.select(F.col("doc_id").alias("book"), F.lit(1).alias("vid"), F.explode(both).alias("c")).select("book", "vid", "c.*").where(F.size("texts") > 0)
    kept = segment.without_repeated_intros(chapters, docs.select(F.col("doc_id").alias("book"), F.expr(_BEGIN).alias("intro")))
    return kept.select("book", "cid", F.size("texts").cast("long").alias("n_texts"), F.sha2(F.array_join("texts", "\n"), 256).alias("texts_sha256"))


def intro_prefix_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines without as many as an intro made of its first ones, and a blank one, repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    intro = F.concat(F.array(F.lit(" ")), F.slice("lines", F.lit(1), (F.col("doc_id") % 4).cast("int")))
    kept = segment.without_prefix(intro, F.col("lines"))
    return docs.select("doc_id", F.size(kept).cast("long").alias("n_left"), F.coalesce(F.get(kept, F.lit(0)), F.lit("")).alias("first_left"))


_RISING = "CASE WHEN line_no = 32 THEN 'EXTRAS' WHEN line_no % 5 = 1 THEN CAST((line_no {div} 5) * (1 + book % 3) * 4 + book % 25 AS STRING) WHEN line_no % 9 = 7 THEN concat('and NEXT ', text) ELSE text END"


def adaptive_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("book", "line_no", F.expr(_RISING.format(div="DIV")).alias("text"))
    return segment.adaptive_sections(lines, "EXTRAS", phrases=("NEXT", "NEVER THERE"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_volumes,
        segment_turns,
        sections_merge,
        sections_first,
        sections_missing,
        volume_buckets,
        continuation_join,
        comma_merge,
        take_until_marker,
        toc_title_repair,
        intro_overlap,
        intro_repeated,
        intro_prefix_trim,
        adaptive_markers,
    )
}


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_CH = f"SELECT book, line_no // 7 AS c, line_no AS k, {_NUMBERED.format(div='//')} AS text FROM ({_LINES})"
_NUM = f"""
  SELECT *, sum(CASE WHEN marker IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seg, last_value(marker IGNORE NULLS) OVER w AS n
  FROM (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN try_cast(text AS BIGINT) END AS marker FROM ({_CH}))
  WINDOW w AS (PARTITION BY book, c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_FIRST = rf"""
  SELECT book, number, string_agg(text, chr(10) ORDER BY k) AS text
  FROM (
    SELECT *, dense_rank() OVER (PARTITION BY book, number ORDER BY c, seg) AS d FROM (
      SELECT book, c, k, text, CASE WHEN sectioned THEN n ELSE c + 1 END AS number, CASE WHEN sectioned THEN seg ELSE 0 END AS seg
      FROM (SELECT *, bool_or(inside) OVER (PARTITION BY book, c) AS sectioned FROM (SELECT *, marker IS NULL AND seg > 0 AND fine AS inside FROM (SELECT *, NOT regexp_matches(text, '^-*\z') AS fine FROM ({_NUM}))))
      WHERE CASE WHEN sectioned THEN inside ELSE fine END))
  WHERE d = 1 GROUP BY book, number"""
_JOINED = """
  SELECT {key}, para, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(CASE WHEN {order} = f THEN rtrim(text, ' ') ELSE trim(text, ' ') END, '' ORDER BY {order}) END AS text
  FROM (SELECT *, min({order}) OVER (PARTITION BY {key}, para) AS f FROM (
    SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY {order})::BIGINT AS para FROM (
      SELECT *, coalesce({go}, false) AND row_number() OVER (PARTITION BY {key} ORDER BY {order}) > 1 AS go FROM ({rows}))))
  GROUP BY {key}, para"""
_PARA = r"regexp_replace({x}, '[，。！？、；：:,.!?;《》〈〉“”\"''‘’\[\]【】（）()\-—_·┃|\x09-\x0D\x1C-\x20\x85\p{{Z}}]+', '', 'g')"


def _keys(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({x}, lambda t: {_PARA.format(x='t')}), lambda t: length(t) >= 8))"


ORACLE = {
    "segment_volumes": rf"""
WITH l AS (
  SELECT book, line_no // 10 AS page, line_no, {_divided(_PAGED, False)} AS heading, {_divided(_MARKED, False)} AS text FROM ({_LINES})),
k AS (SELECT * FROM l WHERE NOT regexp_matches(text, '{_re(segment.SKIP)}')),
e AS (SELECT book, page, line_no, text, false AS head FROM k UNION ALL SELECT book, page, -1, heading, true FROM k WHERE heading IS NOT NULL),
v AS (SELECT *, CASE WHEN head OR (length(text) <= 40 AND regexp_matches(text, '{_re(segment.VOLUME)}') AND NOT regexp_matches(text, '[完終终]')) THEN trim(text, ' ') END AS named FROM e),
o AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM v),
p AS (SELECT *, named IS NOT NULL AND (NOT head OR cur IS NULL OR named <> cur) AS opens FROM o),
q AS (SELECT *, sum(opens::INT) OVER (PARTITION BY book ORDER BY page, line_no)::BIGINT AS vid, NOT opens AND length(text) <= 60 AND regexp_matches(text, '{_re(segment.CHAPTER)}') AS chap FROM p WHERE NOT head OR opens),
r AS (SELECT *, sum(chap::INT) OVER (PARTITION BY book, vid ORDER BY page, line_no)::BIGINT AS cid FROM q),
n AS (SELECT book, vid, max(named) FILTER (WHERE opens) AS volume FROM r GROUP BY book, vid)
SELECT r.book, r.vid, r.cid, coalesce(any_value(n.volume), '') AS volume, coalesce(max(trim(text, ' ')) FILTER (WHERE chap), '正文') AS chapter,
       string_agg(text, chr(10) ORDER BY page, line_no) FILTER (WHERE NOT opens AND NOT chap) AS texts, count(*) FILTER (WHERE NOT opens AND NOT chap) AS n_texts
FROM r JOIN n ON r.book = n.book AND r.vid = n.vid GROUP BY r.book, r.vid, r.cid HAVING count(*) FILTER (WHERE NOT opens AND NOT chap) > 0""",
    "segment_turns": rf"""
WITH l AS (SELECT book, line_no, CASE WHEN line_no % 6 = 4 THEN 'B 第' || (line_no // 6) || '回  夜' WHEN line_no % 6 = 5 THEN '【第1回】' ELSE text END AS text FROM ({_LINES})),
h AS (SELECT *, CASE WHEN NOT regexp_matches(text, '^[（(【]') THEN trim(regexp_replace(nullif(regexp_extract(text, '{_re(segment.TURN)}', 1), ''), '\s+', ' ', 'g'), ' ') END AS heading FROM l),
c AS (SELECT *, sum((heading IS NOT NULL)::INT) OVER (PARTITION BY book ORDER BY line_no)::BIGINT AS cid FROM h)
SELECT book, cid, coalesce(max(heading), 'B' || book) AS chapter, string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE heading IS NULL) AS texts, count(*) FILTER (WHERE heading IS NULL) AS n_texts
FROM c GROUP BY book, cid HAVING count(*) FILTER (WHERE heading IS NULL) > 0""",
    "sections_merge": f"""
WITH n AS (SELECT *, max(seg) OVER (PARTITION BY book, c) > 0 AS marked FROM ({_NUM})),
s AS (SELECT *, max((seg > 0)::INT) OVER (PARTITION BY book) > 0 AS sectioned FROM n WHERE marker IS NULL),
k AS (SELECT *, CASE WHEN NOT sectioned OR NOT marked THEN 'chapter' WHEN seg > 0 THEN 'section' ELSE 'preface' END AS kind FROM s)
SELECT book, kind, CASE kind WHEN 'chapter' THEN c WHEN 'section' THEN n ELSE 0 END::BIGINT AS number, string_agg(text, chr(10) ORDER BY c, k) AS text FROM k GROUP BY ALL""",
    "sections_first": _FIRST,
    "sections_missing": f"""
WITH f AS ({_FIRST}), g AS (SELECT book, number, lead(number) OVER (PARTITION BY book ORDER BY number) AS after FROM (SELECT DISTINCT book, number FROM f)),
r AS (SELECT book, number + 1 AS a, after - 1 AS b FROM g WHERE after > number + 1)
SELECT book, coalesce(string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a), '') AS missing FROM (SELECT DISTINCT book FROM f) LEFT JOIN r USING (book) GROUP BY book""",
    "volume_buckets": """
SELECT conv_id, bucket, min(role) AS label, count(*) AS n_turns, min(turn) AS first_turn
FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS bucket
      FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations))
GROUP BY conv_id, bucket""",
    "continuation_join": _JOINED.format(key="conv_id", order="turn", go="turn % 2 = 0 AND length(text) % 2 = 1", rows="SELECT conv_id, turn, text FROM conversations"),
    "comma_merge": _JOINED.format(
        key="book",
        order="line_no",
        go="regexp_matches(rtrim(lag(text) OVER (PARTITION BY book ORDER BY line_no), ' '), '[，,]$')",
        rows=f"SELECT * FROM (SELECT book, line_no, CASE WHEN line_no % 3 = 0 THEN text || ',' ELSE text END AS text FROM ({_LINES})) WHERE trim(text, ' ') <> ''",
    ),
    "take_until_marker": f"""
SELECT book, line_no, text FROM (SELECT *, max(regexp_matches(text, '[#*$%&]{{3}}')::INT) OVER (PARTITION BY book ORDER BY line_no) AS seen FROM ({_LINES})) WHERE seen = 0""",
    "toc_title_repair": rf"""
SELECT page_id, ord, CASE WHEN good THEN label ELSE last_value(CASE WHEN good THEN label END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '（续）' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) = 1 OR NOT regexp_matches(label, '[.,]$') AS good FROM ({CONTENTS_SQL}))""",
    "intro_overlap": f"""
WITH d AS (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT doc_id AS a, lines AS own, lead(lines) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM d),
p AS (SELECT a, {_keys("own")} AS i, {_keys("next")} AS c,
             (len(list_filter(next, lambda t: contains(t, 'the '))) + len(list_filter(next, lambda t: contains(t, 'and '))))::INTEGER AS hits
      FROM n WHERE next IS NOT NULL),
s AS (SELECT a, len(list_intersect(i, c)) / nullif(len(i), 0) AS share, hits FROM p)
SELECT a, share, hits, coalesce(hits >= 3 OR share >= 0.6, false) AS repeats FROM s""",
    "intro_repeated": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, (1 + doc_id % 3)::INTEGER AS k FROM documents),
c AS (SELECT doc_id, l, l[1:k] AS i, CASE doc_id % 4 WHEN 0 THEN l[1:k] WHEN 1 THEN l WHEN 2 THEN l[k + 1:] ELSE list_concat(['文案：x', '内容标签', '立意'], l[k + 1:]) END AS t FROM d),
x AS (SELECT *, list_transform(t, lambda t: {_PARA.format(x="t")}) AS ck, list_filter(list_transform(i, lambda t: {_PARA.format(x="t")}), lambda t: t <> '') AS ik,
             len(list_intersect({_keys("i")}, {_keys("t")})) / nullif(len({_keys("i")}), 0) AS share FROM c),
y AS (SELECT *, len(list_filter(range(1, least(len(ck), len(ik)) + 1), lambda j: ck[1:j] = ik[1:j])) AS same, doc_id % 5 > 0 AND (doc_id % 4 = 3 OR coalesce(share >= 0.6, false)) AS again FROM x),
z AS (SELECT doc_id AS book, 0 AS cid, CASE WHEN again THEN t[same + 1:] ELSE t END AS t FROM y UNION ALL SELECT doc_id, 1, l FROM d)
SELECT book, cid, len(t)::BIGINT AS n_texts, sha256(array_to_string(t, chr(10))) AS texts_sha256 FROM z WHERE len(t) > 0""",
    "intro_prefix_trim": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda t: {_PARA.format(x="t")}) AS chapter,
             list_filter(list_transform(list_concat([' '], lines[1:(doc_id % 4)::INTEGER]), lambda t: {_PARA.format(x="t")}), lambda t: t <> '') AS intro FROM d),
m AS (SELECT doc_id, lines, len(chapter) AS n, len(list_filter(range(1, least(len(chapter), len(intro)) + 1), lambda j: chapter[1:j] = intro[1:j])) AS same FROM k)
SELECT doc_id, (n - same)::BIGINT AS n_left, coalesce(lines[same + 1], '') AS first_left FROM m""",
    "adaptive_markers": rf"""
WITH RECURSIVE t AS (SELECT book, line_no, {_RISING.format(div="//")} AS text FROM ({_LINES})),
f AS (
  SELECT book, -1 AS line_no, 0 AS part, 0 AS now, false AS kept, '' AS text FROM (SELECT DISTINCT book FROM t)
  UNION ALL
  SELECT t.book, t.line_no, CASE WHEN t.text = 'EXTRAS' THEN 1 ELSE f.part END,
         CASE WHEN t.text = 'EXTRAS' THEN 0 WHEN m.ok THEN try_cast(t.text AS INTEGER) WHEN f.part = 1 AND contains(t.text, 'NEXT') THEN f.now + 1 ELSE f.now END,
         t.text <> 'EXTRAS' AND NOT m.ok, t.text
  FROM f JOIN t ON t.book = f.book AND t.line_no = f.line_no + 1,
       LATERAL (SELECT coalesce(regexp_matches(t.text, '^[0-9]{{1,4}}$') AND try_cast(t.text AS INTEGER) > f.now AND try_cast(t.text AS INTEGER) - f.now <= 20, false) AS ok) m)
SELECT book, part, now AS section, string_agg(text, chr(10) ORDER BY line_no) AS text FROM f WHERE kept GROUP BY book, part, now""",
}
