"""Queries of extraction, URLs and titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, scripts, text, titles, urls
from ..operators import contain, extract, rules
from ..sources.tables import SOURCE_COLUMNS, SOURCE_ROWS, literal, routed, table

# Parts of the SQL that several queries use.
WS = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"


def clean_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def unescape_sql(x: str) -> str:
    for a, b in text.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def plain_sql(x: str) -> str:
    return clean_sql(unescape_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def bare_sql(x: str) -> str:
    return rf"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<ins[^>]*>.*?</ins>|<iframe[^>]*>.*?</iframe>|<!--.*?-->', '', 'g')"


def element_sql(x: str, tag: str) -> str:
    return rf"regexp_extract({x}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"


def converted_sql(x: str, table: scripts.Table) -> str:
    """Text by a table of scripts: its phrases, and what stands between them character by character."""
    known = ", ".join(f"'{a}': '{b}'" for a, b in sorted(table.phrases.items()))
    hits, pieces = f"regexp_extract_all(s, '{table.pattern()}')", f"string_split_regex(s, '{table.pattern()}')"
    parts = f"array_to_string(list_transform({pieces}, lambda t, i: translate(t, '{table.before}', '{table.after}') || coalesce(MAP {{{known}}}[{hits}[i]], '')), '')"
    return f"list_transform([{x}], lambda s: CASE WHEN regexp_matches(s, '{table.pattern()}') THEN {parts} ELSE translate(s, '{table.before}', '{table.after}') END)[1]"


def key_sql(x: str) -> str:
    folded = converted_sql(f"coalesce({x}, '')", scripts.simplifying())
    return rf"regexp_replace(replace(replace(lower({folded}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_TAGS = rf"(?i)</?(?:{'|'.join(markup.NAMES)})(?:[\s/][^>]*)?>"
_NAV = ", ".join(f"'{x}'" for x in extract.NAVIGATION)
PARAGRAPHS_SQL = rf"""
  SELECT page_id, url, list_filter(list_transform(
      CASE WHEN regexp_matches(body, '(?i)<p[\s>]')
           THEN list_transform(string_split_regex(body, '(?i)<p(?:\s[^>]*)?>')[2:], lambda p: regexp_replace(p, '(?is)</p>.*$', ''))
           ELSE string_split_regex(regexp_replace(body, '(?i)<br\s*/?>', chr(10), 'g'), '\n+') END,
      lambda p: {plain_sql("p")}), lambda t: t <> '' AND t NOT IN ({_NAV})) AS texts
  FROM (SELECT page_id, url, {element_sql(bare_sql("html"), "article")} AS body FROM pages)"""
ANCHORS_SQL = rf"""
  SELECT page_id, unnest(range(len(hrefs))) AS place, unnest(hrefs) AS raw_href, unnest(labels) AS raw_label
  FROM (SELECT page_id, regexp_extract_all(nav, '(?is)<a\s[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hrefs,
               regexp_extract_all(nav, '(?is)<a\s[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS labels
        FROM (SELECT page_id, {element_sql(bare_sql("html"), "nav")} AS nav FROM pages))"""
CONTENTS_SQL = f"""
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place)::INTEGER AS ord, href, label
  FROM (SELECT page_id, href, min(place) AS place, arg_min(label, place) AS label
        FROM (SELECT page_id, place, {unescape_sql("raw_href")} AS href, {plain_sql("raw_label")} AS label FROM ({ANCHORS_SQL}))
        WHERE label <> '' GROUP BY page_id, href)"""


# Beside written cases, rows made from a table: expressions that Spark and SQL read alike.
_DIGITS_OF = "translate(CAST(doc_id % 10000 AS {s}), '0123456789', '零一二三四五六七八九')"
_MADE = {
    "numeral": ("documents", "concat(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE '' END, '第', CASE WHEN doc_id % 2 = 0 THEN " + _DIGITS_OF + " ELSE concat('两千', translate(CAST(doc_id % 9 + 1 AS {s}), '123456789', '一二三四五六七八九'), '百十', CASE WHEN doc_id % 3 = 0 THEN '五' ELSE '' END) END, CASE doc_id % 5 WHEN 0 THEN '节' WHEN 1 THEN '回 x' ELSE '章' END)",),
    "title": ("documents", "concat(CASE doc_id % 4 WHEN 0 THEN concat('第', CAST(doc_id AS {s}), '章 卷十二 ') WHEN 1 THEN '第二卷 ' ELSE '' END, split_part(text, {feed}, 1), CASE doc_id % 5 WHEN 0 THEN ' by Ann Lee (x)' WHEN 1 THEN ' (陈一) - a小说网' WHEN 2 THEN '（下）' WHEN 3 THEN '最新章节' ELSE '' END)",),
    "url": ("pages", "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('http://blog.mirror.example/?x=1&no=', CAST(page_id AS {s})) WHEN 2 THEN concat('https://read.example/book/', CAST(page_id AS {s}), '/', CAST(page_id % 9 AS {s}), '_2.html?a') WHEN 3 THEN concat('https://api.example/chapter/', CAST(page_id AS {s}), '_0af_9c.html') WHEN 4 THEN concat('//m.example.com//a/', CAST(page_id AS {s})) ELSE concat('x', url) END",),
    "link": ("pages", "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('/url?sa=U&q=https%3A%2F%2Fa.example%2F', CAST(page_id AS {s}), '%20b+c&x=1') WHEN 2 THEN concat('//find.example/l/?x=1&uddg=http%3A%2F%2Fb.example%2F', CAST(page_id AS {s})) ELSE concat('/p/', CAST(page_id AS {s})) END",),
    "variant": ("documents", "concat(text, CASE doc_id % 4 WHEN 0 THEN '靈書' WHEN 1 THEN '乾坤乾淨瞭解' WHEN 2 THEN '头发发现' ELSE '計畫與藝術' END, CAST(doc_id AS {s}))",),
}


def _made(name: str, spark: bool) -> str:
    return _MADE[name][1].format(s="STRING" if spark else "VARCHAR", feed=r"'\n'" if spark else "chr(10)")


def wide_cases(spark: SparkSession, sf_dir: str, columns: str, rows: str, made: str) -> DataFrame:
    """Written cases of several columns, the first a number, and made ones for each document: expressions in the columns' order."""
    docs = table(spark, sf_dir, "documents")
    ord_, *rest = columns.split(", ")
    made = docs.select((F.col("doc_id") + 1000).alias(ord_), F.expr(f"struct({made.format(s='STRING')})").alias("m"))
    made = made.select(ord_, *(F.col(f"m.col{k}").alias(c) for k, c in enumerate(rest, 1)))
    return literal(spark, columns, rows).withColumn(ord_, F.col(ord_).cast("long")).unionByName(made)


def wide_cases_sql(columns: str, rows: str, made: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) t({columns}) UNION ALL SELECT doc_id + 1000, {made.format(s='VARCHAR')} FROM documents) t"


def _cases(spark: SparkSession, sf_dir: str, columns: str, rows: str, name: str) -> DataFrame:
    """Written cases (ord, x), and a made one for each row of a table, numbered from 1,000."""
    source, key = _MADE[name][0], "doc_id" if _MADE[name][0] == "documents" else "page_id"
    ord_, x = columns.split(", ")
    made = table(spark, sf_dir, source).select((F.col(key) + 1000).alias(ord_), F.expr(_made(name, True)).alias(x))
    return literal(spark, columns, rows).select(F.col(ord_).cast("long").alias(ord_), x).unionByName(made)


def _cases_sql(columns: str, rows: str, name: str) -> str:
    key = "doc_id" if _MADE[name][0] == "documents" else "page_id"
    return f"(SELECT * FROM (VALUES {rows}) t({columns}) UNION ALL SELECT {key} + 1000, {_made(name, False)} FROM {_MADE[name][0]}) t"


def pages_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(extract.paragraphs(F.col("html"))).alias("para_no", "text"))


def pages_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metadata(table(spark, sf_dir, "pages"))


def pages_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.contents(table(spark, sf_dir, "pages"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.canonical_url(url).alias("canonical"),
        urls.bare_host(urls.host(url)).alias("host"),
        urls.joined_url(url, F.lit("next.html")).alias("next"),
        urls.joined_url(url, F.lit("/top")).alias("top"),
    )


URL_COLUMNS = "ord, url"
URL_ROWS = """
  (0, 'https://WWW.Example.com:8080/a//b?x=1#y'), (1, '//m.example.com/p'), (2, 'not a url'), (3, 'http://example.com'),
  (4, 'http://blog.mirror.example/?no=42'), (5, 'http://blog.mirror.example/blog-entry-17.html'), (6, 'https://read.example/book/12/'),
  (7, 'https://read.example/book/12/7_2.html'), (8, 'https://api.example/chapter/3_0af1_9c.html'), (9, 'http://example.com/a%20b+c?d'), (10, '')"""
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)"


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, mirrored, book and chapter URLs of written cases."""
    url = F.col("url")
    ids = urls.chapter_ids(url)
    return _cases(spark, sf_dir, URL_COLUMNS, URL_ROWS, "url").select(
        "ord",
        urls.canonical_url(url).alias("canonical"),
        urls.site_url(url, F.lit("www.example.com"), F.lit("/a")).alias("on_site"),
        urls.mirror_url(url, {"mirror.example": "blog.example.com"}).alias("mirrored"),
        urls.entry_id(url).alias("entry"),
        urls.book_url(url).alias("book"),
        ids["category"].alias("category"),
        ids["book"].alias("book_id"),
        ids["chapter"].alias("chapter_id"),
    )


def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source, in their order, whose domain each page's host is in."""
    host = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), F.coalesce(routed(host)["source"], F.lit("")).alias("source"), F.coalesce(routed(host)["priority"], F.lit(0)).alias("priority")
    )


NUMERAL_COLUMNS = "ord, raw"
NUMERAL_ROWS = """
  (0, '第十章 雨'), (1, '第二十回 归来'), (2, '第一百零五章'), (3, '第两千章'), (4, '第二三章'), (5, '第12章 x'), (6, ' 第 〇 章'),
  (7, '序'), (8, '第三百二十一回'), (9, '第七节'), (10, '第８节 x'), (11, '第九千九百九十九章'), (12, '')"""


def numeral_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _cases(spark, sf_dir, NUMERAL_COLUMNS, NUMERAL_ROWS, "numeral").select(
        "ord", titles.chapter_number(raw).alias("number"), titles.chapter_unit(raw).alias("unit"), titles.section_as_chapter(raw).alias("as_chapter")
    )


TITLE_COLUMNS = "ord, raw"
TITLE_ROWS = """
  (0, '第1章卷一雨夜'), (1, '第2章 卷十二 灯 火'), (2, '第30章 外篇：河'), (3, '尾声'), (4, '远山 第二卷 旧城 by 林木(短篇)'), (5, '长街 by Ann Lee'),
  (6, '白鹭（下）'), (7, '河灯 - 出版 - 出书版 2'), (8, '月光（陈一）最新章节_好书库'), (9, '《归途》 作者：周明 | 短文'), (10, '_沈石小说 (李四) by 王五'), (11, ''), (12, '第三卷 by the sea (tag)')"""
_SPLIT = titles.SPLIT_TITLE


def title_author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    parts, named, found = titles.split_title(raw), titles.title_and_author(raw), titles.result_title(raw)
    return _cases(spark, sf_dir, TITLE_COLUMNS, TITLE_ROWS, "title").select(
        "ord",
        *(parts[c].alias(c) for c in ("chapter", "volume", "name")),
        named["title"].alias("title"),
        named["author"].alias("author"),
        found["title"].alias("result_title"),
        found["author"].alias("result_author"),
        titles.base_title(raw).alias("base"),
        titles.page_volume(raw).alias("page_volume"),
    )


MATCH_COLUMNS = "qid, query"
MATCH_ROWS = "(0, 'the'), (1, 'THE of'), (2, 'ß'), (3, ''), (4, 'the, of; and'), (5, 'zzz-none')"
MATCH_STRUCTS = f"({MATCH_ROWS})"


def match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level at which each page's title and intro match each query. The queries are written out."""
    pages = extract.metadata(table(spark, sf_dir, "pages")).select("page_id", text.search_key(F.col("title")).alias("title"), text.search_key(F.col("intro")).alias("intro"))
    pairs = pages.select("*", F.expr(f"inline(array{MATCH_STRUCTS}) AS ({MATCH_COLUMNS})"))
    return pairs.select("qid", "page_id", text.level_of(F.col("query"), F.col("title"), F.lit(""), F.col("intro")).alias("level"))


def level_sql(q: str, title: str, author: str, snippet: str) -> str:
    words = rf"list_filter(list_transform(string_split_regex(coalesce({q}, ''), '[\x09-\x0D\x1C-\x20\x85\p{{Z}},，;；]+'), lambda w: {key_sql('w')}), lambda w: w <> '')"
    return f"""CASE WHEN {key_sql(q)} = '' THEN 0 WHEN {key_sql(q)} = {key_sql(title)} THEN 4
      WHEN contains({key_sql(title)}, {key_sql(q)}) OR contains({key_sql(q)}, {key_sql(title)}) THEN 3
      WHEN len({words}) > 0 AND len(list_filter({words}, lambda w: NOT contains({key_sql(title)}, w))) = 0 THEN 2
      WHEN contains({key_sql(author)}, {key_sql(q)}) OR contains({key_sql(snippet)}, {key_sql(q)}) THEN 1 ELSE 0 END"""


CASE_COLUMNS = "ord, query, title, author, snippet"
CASE_ROWS = """
  (0, '', 'a', '', ''), (1, 'abc', '', '', ''), (2, 'Straße', 'STRASSE', '', ''), (3, '書', '书', '', ''), (4, '全球，高考！', '全球高考', '', ''),
  (5, 'sea red', 'The red, red sea', '', ''), (6, 'lin', 'x', 'Lin Mu', ''), (7, 'mu', 'x', '', 'by Mu'), (8, 'none', 'x', 'y', 'z'), (9, 'red sea', 'red', '', '')"""


CASE_MADE = """concat('Book ', CAST(doc_id % 4 AS {s})), concat(CASE WHEN doc_id % 3 = 0 THEN 'The ' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'BOOK' ELSE 'of book' END, CAST(doc_id % 7 AS {s})),
  CASE WHEN doc_id % 2 = 0 THEN concat('book', CAST(doc_id % 3 AS {s})) ELSE '' END, concat(text, '')"""


def match_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_cases(spark, sf_dir, CASE_COLUMNS, CASE_ROWS, CASE_MADE).select("ord", text.match_level(*map(F.col, ("query", "title", "author", "snippet"))).alias("level"), text.titles_overlap(F.col("query"), F.col("title")).alias("overlap"))


VARIANT_COLUMNS = "ord, raw"
VARIANT_ROWS = "(0, '靈魂深處鬧革命'), (1, '書'), (2, 'plain'), (3, ''), (4, '會後來 對 x'), (5, '愛國衛生運動與藝術'), (6, '乾坤 乾淨 瞭解 計畫 畫家'), (7, '理发 头发 发现 五只 茶余饭后 周三')"


def variant_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, VARIANT_COLUMNS, VARIANT_ROWS, "variant").select("ord", text.fold_variants(F.col("raw")).alias("folded"), text.unfold_variants(F.col("raw")).alias("unfolded"), text.search_key(F.col("raw")).alias("key"))


LINK_COLUMNS = "ord, href"
LINK_ROWS = """
  (0, '//find.example/l/?uddg=https%3A%2F%2Fexample.com%2Fa%20b&rut=1'), (1, '/url?q=https%3A%2F%2Fexample.org%2F%3Fx%3D1+2&sa=U'), (2, 'https://example.net/p'),
  (3, '/about'), (4, '/url?sa=U'), (5, 'https://find.example/l/?x=1&uddg=http%3A%2F%2Fa.example')"""


def redirect_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    href, query = F.col("href"), F.concat(F.lit("red sea "), F.col("ord").cast("string"))
    return _cases(spark, sf_dir, LINK_COLUMNS, LINK_ROWS, "link").select(
        "ord",
        urls.redirect_target(href).alias("target"),
        F.url_encode(query).alias("encoded"),
        F.array_join(urls.query_variants(query, F.lit("www.example.com"), F.when(F.col("ord") % 2 == 0, "/book/").otherwise("")), "|").alias("variants"),
    )


PAYLOAD_COLUMNS = "ord, answer"
PAYLOAD_ROWS = """
  (0, '{"code": 0, "data": {"content_data": "[\\u0022one\\u0022, \\u0022two\\u0022]"}}'), (1, '{"code": 1, "data": {"content_data": "[]"}}'),
  (2, '{"code": 0, "data": {"content_data": "[]"}}')""".replace("\\u0022", "\\\\u0022")


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's JSON text."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def author_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author candidates in written results, each with the pages whose titles contain, or are contained in, its book."""
    results = literal(spark, "rid, query, description", AUTHOR_ROWS)
    people = results.select("rid", "query", F.posexplode(F.slice(titles.authors_in(F.col("description"), F.col("query")), 1, 5)).alias("place", "author"))
    pages = extract.metadata(table(spark, sf_dir, "pages")).select("page_id", text.title_key(F.col("title")).alias("b"))
    people = people.withColumn("a", text.title_key(F.col("query")))
    return people.join(contain.overlapping(people, pages), "a").join(pages, "b").select("rid", "place", "author", "page_id")


def title_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of a contents list with the titles that contain it, or that it contains: how many, and of which pages."""
    pages = table(spark, sf_dir, "pages")
    labels = extract.contents(pages).select(text.title_key(F.col("label")).alias("a")).distinct()
    named = extract.metadata(pages).select("page_id", text.title_key(F.col("title")).alias("b"))
    found = contain.overlapping(labels, named).join(named, "b")
    return found.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.sum("page_id").alias("sum_pages"))


# Answers that name authors, in three forms of each query, and the authors' pages: made from pages, five or ten of which answer one query.
_NAMES_AUTHORS = """CASE page_id % 5 WHEN 0 THEN concat('作者：A', CAST(page_id % 7 AS {s}), ' x') WHEN 1 THEN concat('by A', CAST(page_id % 7 AS {s}), ', (B', CAST(page_id % 3 AS {s}), ')') WHEN 2 THEN '(最新章节)' WHEN 3 THEN concat('_A', CAST(page_id % 4 AS {s}), '小说') ELSE 'none' END"""


def author_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books found by the authors that landed answers name."""
    pages = table(spark, sf_dir, "pages")
    meta = extract.metadata(pages, "url")
    label = F.get(F.transform(extract.contents_of(F.col("html")), lambda a: a["label"]), F.lit(0))
    queries = pages.where("page_id % 10 = 0").select((F.col("page_id") / 10).cast("long").alias("g"), F.coalesce(label, F.lit("")).alias("query"))
    answers = meta.select(F.expr("page_id DIV 10").alias("g"), (F.col("page_id") % 3).alias("form"), F.expr("page_id DIV 3").alias("rank"), "title", F.expr(_NAMES_AUTHORS.format(s="STRING")).alias("description"))
    answers = answers.join(queries, "g").select("query", "form", "rank", F.lit("T").alias("title"), "description")
    books = meta.select(F.concat(F.lit("A"), (F.col("page_id") % 7).cast("string")).alias("author"), F.col("page_id").alias("ord"), "title", "url")
    return contain.author_search(answers, books, 7)


AUTHOR_ROWS = """
  (0, 'the', 'A story (Lin Mu) by Ann'), (1, 'ion', 'by Zhou, again by Zhou'), (2, 'zzzz', '(Nobody)'), (3, 'of', '作者：周明 《河》 李四')"""

def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every page: its place among the page's, name, depth, and the text between its tag and its own end."""
    bare = extract.without_noise(F.coalesce("html", F.lit("")))
    pages = table(spark, sf_dir, "pages").select("page_id", markup.page(bare).alias("p"))
    own = F.transform("p.elements", lambda e: F.struct(markup.tag_of(F.col("p"), e).alias("tag"), e["depth"].alias("depth"), markup.inside(F.col("p"), e).alias("inside")))
    rows = pages.select("page_id", F.posexplode(own).alias("ord", "e")).select("page_id", "ord", "e.depth", F.lower(F.regexp_extract("e.tag", "^<([A-Za-z0-9]+)", 1)).alias("name"), extract.plain(F.col("e.inside")).alias("text"))
    return rows.select("page_id", "ord", "name", "depth", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


# A page's links as a search page lists them: nested in a column, each in a block with a heading and blocks of its own.
_RESULT_ITEM = """concat('<div class="result hit"><div class="body"><h2><a class="t" href="', replace(href, '&', '&amp;'), '">', replace(replace(label, '&', '&amp;'), '<', '&lt;'), '</a></h2><div class="meta">', CAST(ord AS {s}), '</div><p>Found on ', CAST(page_id AS {s}), '.</p></div></div>')"""


def search_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page's contents list, written as a page of results, read as such."""
    links = extract.contents(table(spark, sf_dir, "pages")).select("page_id", F.struct("ord", F.expr(_RESULT_ITEM.format(s="STRING")).alias("item")).alias("i"))
    answers = links.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]), "<div>no result</div>").alias("items"))
    html = F.concat(F.lit('<body><div class="results"><div class="result"><p>No link</p></div>'), "items", F.lit("</div></body>"))
    blocks = answers.select("page_id", F.posexplode(extract.result_blocks(html)).alias("place", "r"))
    return blocks.select("page_id", "place", "r.title", "r.href", "r.description", F.contains("r.href", F.lit("on")).alias("on_domain"))


# The rules of the sources: those of one find the same by other ways, and a null stands for the rest.
RULE_ROWS = ", ".join(
    f"({source}, 'title', 0, 'head title', NULL, NULL, 1, NULL, false), ({source}, 'title', 1, 'h1', NULL, NULL, 1, NULL, false), ({source}, 'heading', 0, '{heading}', NULL, NULL, 1, NULL, false), "
    f"({source}, 'lang', 0, 'html', 'lang', NULL, 1, NULL, false), ({source}, 'owner', 0, 'body footer', NULL, '© ([^·]*)·', 1, NULL, false), ({source}, 'intro', 0, '{intro}', NULL, '{words}', 2, NULL, false), "
    f"({source}, 'contents', 0, '{links}', NULL, NULL, NULL, 'href', true)"
    for source, heading, intro, links, words in (("'com'", "article h1", "body article p", "nav ul li a", "(.*)"), ("NULL", "h1", "article p", "nav a", "^(?!(?:0|上一页|下一页|上一章|下一章|目录|返回目录|加入书签)$)(.*)$"))
)


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", routed(urls.host(F.col("url")))["source"].alias("source"), "html")
    names = ", ".join(c.split()[0] for c in rules.RULES.split(", "))
    return rules.ruled(pages, literal(spark, names, RULE_ROWS))


def ruled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' metadata by rows of rules, no code for it."""
    found = _ruled(spark, sf_dir).where("field <> 'contents'")
    own = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("field", "ord", "value"))).alias("f"))
    value = lambda name: F.array_join(F.transform(F.filter("f", lambda x: x["field"] == name), lambda x: x["value"]), "\n")
    every = table(spark, sf_dir, "pages").select("page_id").join(own, "page_id", "left")
    return every.select("page_id", *(F.coalesce(value(c), F.lit("")).alias(c) for c in ("title", "heading", "lang", "owner", "intro")))


def ruled_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' contents lists by rows of rules."""
    return _ruled(spark, sf_dir).where("field = 'contents'").select("page_id", "ord", F.col("beside").alias("href"), F.col("value").alias("label"))


def comma_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.comma_spacing(F.col("text")).alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines: cleaned, numbered as they stood, without blank and dash-only ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.text_lines(F.col("text"))).alias("l")).select("doc_id", F.col("l.place").alias("line_no"), "l.text")


def display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu row for each page: its title's width, and the title cut and filled to 24 columns."""
    pages = extract.metadata(table(spark, sf_dir, "pages")).select("page_id", "title")
    return pages.select("page_id", text.display_width("title").alias("width"), F.concat(F.format_string("%4d  ", F.col("page_id")), text.fit_display(F.col("title"), F.lit(24))).alias("row"))


BOOK_COLUMNS = "ord, page_title, lines, intro, heading, body, mime"
BOOK_ROWS = """
  (0, '远山(林木)/短篇/完结', '作者：林木|状态: 连载', 'x BY 陈一，y', '《远山》共12节', '　　第一段|下一页|第二段', 'image/png'),
  (1, '长街', '类别：都市', '文 by 南山 z', '目录', 'goes on|本章未完，点击下一页继续阅读|　　new', 'image/jpeg'),
  (2, '', '', '小说简介：first|second|作品简评：|third', '', '', ''),
  (3, 'T (A B) / C', '作者: |作者：late', 'one|编辑评价a.gif|two', '《a》共x节', '（本章完）|目录', 'image/webp')"""


BOOK_MADE = """concat('T', CAST(doc_id AS {s}), CASE WHEN doc_id % 3 = 0 THEN concat('(A', CAST(doc_id % 5 AS {s}), ')') ELSE '' END, '/x/', CASE WHEN doc_id % 2 = 0 THEN '完结' ELSE '' END),
  concat('类别：x|', CASE WHEN doc_id % 4 = 0 THEN '作者： 南山' ELSE '状态:y' END), concat('one|', CASE WHEN doc_id % 3 = 1 THEN 'BY 南山 z|' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN '作品简评：|' ELSE '' END, 'two'),
  concat('《T', CAST(doc_id AS {s}), '》共', CAST(doc_id % 90 AS {s}), CASE WHEN doc_id % 8 = 0 THEN '章' ELSE '节' END), concat(CASE WHEN doc_id % 2 = 0 THEN '　　' ELSE '' END, 'p', CAST(doc_id AS {s}), '|下一页|（本章完）|q'),
  CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' ELSE 'x' END"""


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values, titles, authors, declared totals, bodies and intros of written pages."""
    rows = wide_cases(spark, sf_dir, BOOK_COLUMNS, BOOK_ROWS, BOOK_MADE)
    lines = lambda c: F.replace(c, F.lit("|"), F.lit("\n"))
    title, total, body = extract.title_parts(F.col("page_title")), extract.declared(F.col("heading")), extract.body_lines(lines("body"))
    return rows.select(
        "ord",
        extract.labelled(F.split(lines("lines"), "\n"), "作者").alias("labelled_author"),
        title["title"].alias("title"),
        title["author"].alias("author"),
        title["status"].alias("status"),
        extract.author_of(F.col("page_title"), F.col("intro"), {"南山": "南山客"}).alias("page_author"),
        total["title"].alias("declared_title"),
        F.coalesce(total["total"], F.lit(0)).alias("n_chapters"),
        F.array_join(body["lines"], "|").alias("body_text"),
        body["continues"].alias("continues"),
        F.array_join(extract.intro_paragraphs(lines("intro")), "|").alias("intro_text"),
        extract.cover_extension(F.col("mime")).alias("cover"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        book_pages,
        pages_paragraphs,
        pages_metadata,
        pages_toc,
        url_canonical,
        url_cases,
        source_routing,
        numeral_parse,
        title_author_split,
        match_levels,
        match_cases,
        variant_fold,
        redirect_unwrap,
        json_payload,
        author_theta_join,
        title_containment,
        author_search,
        search_block_extract,
        page_elements,
        ruled_metadata,
        ruled_contents,
        comma_normalize,
        document_lines,
        display_format,
    )
}


def _decoded(x: str) -> str:
    return f"url_decode({x})"


def canonical_sql(x: str) -> str:
    u = _decoded(unescape_sql(x))
    return rf"""CASE WHEN regexp_replace(lower(regexp_extract({u}, '{_PARTS}', 2)), '^(?:www|m)\.', '') <> '' THEN
      coalesce(nullif(regexp_extract({u}, '{_PARTS}', 1), ''), 'https') || '://www.' || regexp_replace(lower(regexp_extract({u}, '{_PARTS}', 2)), '^(?:www|m)\.', '')
      || regexp_replace(regexp_extract({u}, '{_PARTS}', 3), '/{{2,}}', '/', 'g') END"""


META_SQL = rf"""
  SELECT m.page_id, m.url, coalesce(nullif({plain_sql(element_sql("bare", "title"))}, ''), {plain_sql(element_sql("bare", "h1"))}) AS title,
         {plain_sql(element_sql("bare", "h1"))} AS heading,
         regexp_extract(bare, '(?i)<html[^>]*\slang=["'']([^"'']*)["'']', 1) AS lang,
         {clean_sql(f"regexp_extract({plain_sql(element_sql('bare', 'footer'))}, '© ([^·]*)·', 1)")} AS owner,
         array_to_string(p.texts[1:2], chr(10)) AS intro
  FROM (SELECT page_id, url, {bare_sql("coalesce(html, '')")} AS bare FROM pages) m JOIN ({PARAGRAPHS_SQL}) p USING (page_id)"""

_N = "".join(titles.NUMERAL)
_ARABIC = " ".join(f"WHEN '{k}' THEN {v}" for k, v in titles.DIGITS.items())
_UNIT = " ".join(f"WHEN '{k}' THEN {v}" for k, v in titles.UNITS.items())

_KEPT = rf"list_filter(string_split(body, '|'), lambda x: {clean_sql('x')} <> '' AND NOT regexp_matches({clean_sql('x')}, '{extract._NAV_LINE}') AND NOT regexp_matches({clean_sql('x')}, '{extract._ADVERT}'))"
_REVIEW = r"""(regexp_matches(regexp_replace(x, '\s+', '', 'g'), '(?i)^(?:[^，。！？；\n]{0,40})?(?:(?:作品)?简评|编辑评价|强推奖章)(?:\s*[:：】）)]?|[^\s，。！？；\n]*\.(?:gif|jpe?g|png|webp))?$')
  AND (regexp_matches(x, '作品简评|编辑评价|强推奖章|^简评') OR regexp_matches(lower(x), '\.(?:gif|jpg|png)')))"""
_INTRO = rf"list_filter(list_transform(string_split(regexp_replace(intro, '^\s*小说简介\s*[:：]?\s*', ''), '|'), lambda x: {clean_sql('x')}), lambda x: x <> '')"

_TITLE_KEY = "regexp_replace({}, '[" + text.TITLE_MARKS.replace("'", "''") + "\\x09-\\x0D\\x1C-\\x20\\x85\\p{{Z}}]+', '', 'g')"


def _authors_sql(keys: str, rows: str) -> str:
    """Relations n, c and f: the names in the descriptions of rows, cleaned, and the first place k of each for the keys, which begin with a row's own and have its query."""
    return rf"""n AS (SELECT {keys}, unnest(range(len(names))) AS k, unnest(names) AS name FROM (
  SELECT {keys}, list_concat(regexp_extract_all(description, '[（(]([^()（）]{{1,20}})[)）]', 1), regexp_extract_all(description, '作者\s*[:：]\s*([^\s,，。|｜_《》()（）-]{{1,20}})', 1),
    regexp_extract_all(description, '(?i)\bby\s*([^\s,，。|｜_《》()（）-]{{1,20}})', 1), regexp_extract_all(description, '_([^_\s]{{1,20}})小说', 1), regexp_extract_all(description, '《[^》]+》\s*([^_\s|｜-]{{1,20}})', 1)) AS names FROM {rows})),
c AS (SELECT {keys}, k, regexp_replace(regexp_replace({unescape_sql("name")}, '{WS}+', '', 'g'), '^[_\-：:|｜]+|[_\-：:|｜]+$', '', 'g') AS author FROM n),
f AS (SELECT {keys}, author, min(k) AS k FROM c WHERE author <> '' AND author <> query AND length(author) <= 12 AND NOT regexp_matches(author, '最新章节|全文阅读|免费阅读|小说|在线阅读') GROUP BY ALL)"""


ORACLE = {
    "book_pages": rf"""
SELECT ord, coalesce(regexp_extract(list_filter(string_split(lines, '|'), lambda x: regexp_matches(x, '^作者\s*[:：]\s*(.*)$'))[1], '^作者\s*[:：]\s*(.*)$', 1), '') AS labelled_author,
       {clean_sql("regexp_extract(page_title, '^([^(（/]*)', 1)")} AS title, {clean_sql("regexp_extract(page_title, '[(（]([^()（）]+)[)）]', 1)")} AS author,
       {clean_sql("regexp_extract(page_title, '/([^/]*)$', 1)")} AS status,
       replace(CASE WHEN regexp_extract(page_title, '\(([^()]+)\)', 1) <> '' THEN {clean_sql(r"regexp_extract(page_title, '\(([^()]+)\)', 1)")} ELSE regexp_extract(intro, '(?i)\bby\s*([^\s，,。；;、]+)', 1) END, '南山', '南山客') AS page_author,
       {clean_sql("regexp_extract(heading, '《(.+?)》共([0-9]+)节', 1)")} AS declared_title, coalesce(try_cast(regexp_extract(heading, '《(.+?)》共([0-9]+)节', 2) AS BIGINT), 0) AS n_chapters,
       array_to_string(list_transform({_KEPT}, lambda x: {clean_sql("x")}), '|') AS body_text,
       coalesce(NOT regexp_matches({_KEPT}[1], '^[\x{{00a0}}\x{{3000}}]{{2,}}'), false) AS continues,
       array_to_string(CASE WHEN len(list_filter({_INTRO}, lambda x: {_REVIEW})) > 0 THEN {_INTRO}[1:list_position({_INTRO}, list_filter({_INTRO}, lambda x: {_REVIEW})[1]) - 1] ELSE {_INTRO} END, '|') AS intro_text,
       CASE mime WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END AS cover
FROM {wide_cases_sql(BOOK_COLUMNS, BOOK_ROWS, BOOK_MADE)}""",
    "pages_paragraphs": f"SELECT page_id, (unnest(range(len(texts))))::INTEGER AS para_no, unnest(texts) AS text FROM ({PARAGRAPHS_SQL})",
    "pages_metadata": f"SELECT page_id, title, heading, lang, owner, intro FROM ({META_SQL})",
    "pages_toc": CONTENTS_SQL,
    "url_canonical": rf"""
SELECT page_id, {canonical_sql("url")} AS canonical, regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^(?:www|m)\.', '') AS host,
       regexp_extract(url, '{_PARTS}', 1) || '://' || regexp_extract(url, '{_PARTS}', 2) || coalesce(nullif(regexp_replace(regexp_extract(url, '{_PARTS}', 3), '[^/]*$', ''), ''), '/') || 'next.html' AS next,
       regexp_extract(url, '{_PARTS}', 1) || '://' || regexp_extract(url, '{_PARTS}', 2) || '/top' AS top
FROM pages""",
    "url_cases": rf"""
SELECT ord, {canonical_sql("url")} AS canonical,
       CASE WHEN regexp_extract({canonical_sql("url")}, '{_PARTS}', 2) = 'www.example.com' AND starts_with(regexp_extract({canonical_sql("url")}, '{_PARTS}', 3), '/a') THEN {canonical_sql("url")} END AS on_site,
       'http://' || CASE WHEN lower(regexp_extract(url, '{_PARTS}', 2)) LIKE '%mirror.example' THEN 'blog.example.com' ELSE lower(regexp_extract(url, '{_PARTS}', 2)) END
         || CASE WHEN regexp_extract(url, '[?&]no=(\d+)', 1) <> '' THEN '/blog-entry-' || regexp_extract(url, '[?&]no=(\d+)', 1) || '.html'
                 ELSE coalesce(nullif(regexp_extract(url, '{_PARTS}', 3), ''), '/') END AS mirrored,
       coalesce(nullif(regexp_extract(url, 'blog-entry-(\d+)\.html', 1), ''), regexp_extract(url, '[?&]no=(\d+)', 1)) AS entry,
       regexp_extract(url, '{_PARTS}', 1) || '://' || lower(regexp_extract(url, '{_PARTS}', 2)) || '/book/' || nullif(regexp_extract(url, '/book/(\d+)/(?:\d+(?:_\d+)?\.html)?(?:[?#].*)?$', 1), '') || '/' AS book,
       regexp_extract(url, '/chapter/(\d+)_([0-9a-f]+)_([0-9a-f]+)\.html$', 1) AS category, regexp_extract(url, '/chapter/(\d+)_([0-9a-f]+)_([0-9a-f]+)\.html$', 2) AS book_id,
       regexp_extract(url, '/chapter/(\d+)_([0-9a-f]+)_([0-9a-f]+)\.html$', 3) AS chapter_id
FROM {_cases_sql(URL_COLUMNS, URL_ROWS, 'url')}""",
    "source_routing": rf"""
SELECT p.page_id, p.host, coalesce(arg_min(s.source, s.ord), '') AS source, coalesce(arg_min(s.priority, s.ord), 0) AS priority
FROM (SELECT page_id, lower(regexp_extract(url, '{_PARTS}', 2)) AS host FROM pages) p
LEFT JOIN (VALUES {SOURCE_ROWS}) s({', '.join(SOURCE_COLUMNS)}) ON p.host = s.domain OR suffix(p.host, '.' || s.domain)
GROUP BY p.page_id, p.host""",
    "numeral_parse": rf"""
WITH RECURSIVE t AS (
  SELECT ord, raw, regexp_extract(raw, '^{WS}*第{WS}*([0-9]+|[零〇一二两三四五六七八九十百千]+){WS}*([章回])', 1) AS n,
         regexp_extract(raw, '^{WS}*第{WS}*([0-9]+|[零〇一二两三四五六七八九十百千]+){WS}*([章回])', 2) AS unit
  FROM {_cases_sql(NUMERAL_COLUMNS, NUMERAL_ROWS, 'numeral')}),
f AS (
  SELECT ord, n AS rest, 0::BIGINT AS total, 0::BIGINT AS now FROM t WHERE regexp_matches(n, '^[^0-9]+$')
  UNION ALL
  SELECT ord, rest[2:], CASE WHEN u IS NULL THEN total ELSE total + CASE WHEN now = 0 THEN 1 ELSE now END * u END, coalesce(d, 0)
  FROM (SELECT *, CASE rest[1:1] {_ARABIC} END AS d, CASE rest[1:1] {_UNIT} END AS u FROM f WHERE rest <> ''))
SELECT t.ord, CASE WHEN regexp_matches(n, '^[0-9]+$') THEN try_cast(n AS BIGINT) ELSE total + now END AS number, nullif(unit, '') AS unit,
       regexp_replace({clean_sql("raw")}, '^第([0-9０-９一二三四五六七八九十百千两]+)节$', '第\1章') AS as_chapter
FROM t LEFT JOIN (SELECT * FROM f WHERE rest = '') f USING (ord)""",
    "title_author_split": rf"""
WITH t AS (SELECT ord, raw, regexp_matches(raw, '{_SPLIT}') AS fits, regexp_extract(raw, '{_SPLIT}', 2) AS num FROM {_cases_sql(TITLE_COLUMNS, TITLE_ROWS, 'title')}),
a AS (SELECT *, {clean_sql(f"regexp_replace({clean_sql('raw')}, '[（(][^()（）]*[)）] ?$', '')")} AS named FROM t),
b AS (SELECT *, regexp_extract(named, '(?i)\bby +([^()（）]+)$', 1) AS who FROM a),
c AS (SELECT *, CASE WHEN who <> '' THEN {clean_sql(r"regexp_replace(named, '(?i)\bby +[^()（）]+$', '')")} ELSE named END AS t1 FROM b),
d AS (SELECT *, {clean_sql("regexp_replace(t1, '第[一二三四五六七八九十百零0-9]+卷[^()（）]*$', '')")} AS t2 FROM c),
e AS (SELECT *, {clean_sql("regexp_replace(t2, '- ?出[書书]版.*$', '')")} AS t3 FROM d),
f AS (SELECT *, {clean_sql("regexp_replace(t3, '[（(]?[上中下][)）]? ?$', '')")} AS t4,
             {clean_sql(f"regexp_replace({clean_sql(f'''regexp_replace({clean_sql(unescape_sql('raw'))}, ' ?[-_] ?[^-_ ]+(?:小说网|书库|site)$', '')''')}, '(?:最新章节|全文阅读|免费全文阅读).*$', '')")} AS r1 FROM e),
g AS (SELECT *, {clean_sql("regexp_extract(r1, '[（(]([^()（）]+)[)）]', 1)")} AS rwho FROM f)
SELECT ord, CASE WHEN fits THEN {clean_sql(f"regexp_extract(raw, '{_SPLIT}', 1)")} ELSE raw END AS chapter,
       CASE WHEN fits AND num <> '' THEN '卷' || num || regexp_replace(' ' || {clean_sql(f"regexp_extract(raw, '{_SPLIT}', 3)")}, '^ $', '') ELSE '' END AS volume,
       CASE WHEN fits AND num = '' THEN {clean_sql(f"regexp_extract(raw, '{_SPLIT}', 4)")} ELSE '' END AS name,
       coalesce(nullif(t4, ''), {clean_sql("raw")}) AS title, {clean_sql("who")} AS author,
       coalesce(nullif(regexp_replace(CASE WHEN rwho <> '' THEN regexp_replace(r1, '^([^（(]*)[（(][^()（）]+[)）]', '\1') ELSE r1 END, '^[ _\-：:]+|[ _\-：:]+$', '', 'g'), ''), '未命名') AS result_title,
       rwho AS result_author, {clean_sql("regexp_replace(raw, '[（(]?[上中下][)）]?$', '')")} AS base,
       {clean_sql(rf"regexp_replace(regexp_extract(raw, '(第{WS}*[{_N}0-9]+{WS}*卷[^()（）]*)', 1), '(?i)(?:^|\s)by\s.*$', '')")} AS page_volume
FROM g""",
    "match_levels": f"SELECT q.qid, p.page_id, {level_sql('q.query', 'p.title', chr(39) * 2, 'p.intro')} AS level FROM ({META_SQL}) p CROSS JOIN (VALUES {MATCH_ROWS}) q({MATCH_COLUMNS})",
    "match_cases": rf"""
SELECT ord, {level_sql("query", "title", "author", "snippet")} AS level, contains(a, b) OR contains(b, a) AS overlap
FROM (SELECT *, regexp_replace(query, '[{text.TITLE_MARKS.replace("'", "''")}\x09-\x0D\x1C-\x20\x85\p{{Z}}]+', '', 'g') AS a, regexp_replace(title, '[{text.TITLE_MARKS.replace("'", "''")}\x09-\x0D\x1C-\x20\x85\p{{Z}}]+', '', 'g') AS b
      FROM {wide_cases_sql(CASE_COLUMNS, CASE_ROWS, CASE_MADE)})""",
    "variant_fold": f"SELECT ord, {converted_sql("raw", scripts.simplifying())} AS folded, {converted_sql("raw", scripts.traditional())} AS unfolded, {key_sql('raw')} AS key FROM {_cases_sql(VARIANT_COLUMNS, VARIANT_ROWS, 'variant')}",
    "redirect_unwrap": rf"""
SELECT ord, CASE WHEN starts_with(u, '/url?') THEN url_decode(nullif(regexp_extract(u, '^/url\?(?:[^#]*&)?q=([^&#]*)', 1), ''))
                 WHEN regexp_extract(u, '^[^?#]*/l/\?(?:[^#]*&)?uddg=([^&#]*)', 1) <> '' THEN url_decode(regexp_extract(u, '^[^?#]*/l/\?(?:[^#]*&)?uddg=([^&#]*)', 1))
                 WHEN starts_with(u, 'http') THEN u END AS target,
       replace('red sea ' || ord, ' ', '+') AS encoded,
       'red sea ' || ord || ' example.com|' || CASE WHEN ord % 2 = 0 THEN 'red sea ' || ord || ' example.com/book/|' ELSE '' END
         || 'site:www.example.com' || CASE WHEN ord % 2 = 0 THEN '/book/' ELSE '' END || ' red sea ' || ord AS variants
FROM (SELECT ord, CASE WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END AS u FROM {_cases_sql(LINK_COLUMNS, LINK_ROWS, 'link')})""",
    "json_payload": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "author_theta_join": rf"""
WITH r AS (SELECT * FROM (VALUES {AUTHOR_ROWS}) t(rid, query, description)),
{_authors_sql("rid, query", "r")},
a AS (SELECT *, (row_number() OVER (PARTITION BY rid ORDER BY k) - 1)::INTEGER AS place FROM f)
SELECT a.rid, a.place, a.author, p.page_id
FROM a JOIN (SELECT page_id, {_TITLE_KEY.format("title")} AS t FROM ({META_SQL})) p
  ON contains(p.t, a.query) OR contains(a.query, p.t)
WHERE a.place < 5""",
    "title_containment": f"""
WITH l AS (SELECT DISTINCT {_TITLE_KEY.format("label")} AS a FROM ({CONTENTS_SQL})), t AS (SELECT page_id, {_TITLE_KEY.format("title")} AS b FROM ({META_SQL}))
SELECT a AS label, count(*) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page, sum(page_id)::BIGINT AS sum_pages
FROM l JOIN t ON a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) GROUP BY a""",
    "author_search": f"""
WITH q AS (SELECT page_id // 10 AS g, label AS query FROM ({CONTENTS_SQL}) WHERE ord = 1 AND page_id % 10 = 0),
r AS (SELECT query, page_id % 3 AS form, page_id // 3 AS rank, {_NAMES_AUTHORS.format(s="VARCHAR")} AS description FROM pages JOIN q ON q.g = page_id // 10),
{_authors_sql("query, form, rank", "r")},
a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY form, rank, k) AS place FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query, author ORDER BY form, rank, k) = 1) QUALIFY place <= 5),
b AS (SELECT a.query, a.place, a.author, m.page_id, m.title, p.url FROM a JOIN ({META_SQL}) m ON a.author = 'A' || (m.page_id % 7) JOIN pages p ON p.page_id = m.page_id
      WHERE {_TITLE_KEY.format("query")} <> '' AND {_TITLE_KEY.format("m.title")} <> '' AND (contains({_TITLE_KEY.format("query")}, {_TITLE_KEY.format("m.title")}) OR contains({_TITLE_KEY.format("m.title")}, {_TITLE_KEY.format("query")}))),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY place, page_id) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY place, page_id, url)::INTEGER AS rank, author, title, url, (8 - row_number() OVER (PARTITION BY query ORDER BY place, page_id, url))::DOUBLE AS score
FROM o QUALIFY rank <= 7""",
    "search_block_extract": f"""
SELECT page_id, ord::INTEGER - 1 AS place, label AS title, href, 'Found on ' || page_id || '.' AS description, contains(href, 'on') AS on_domain FROM ({CONTENTS_SQL})""",
    # Depths are running sums over all tags but those of paragraphs, which end at the next tag.
    "page_elements": rf"""
WITH b AS (SELECT page_id, {bare_sql("coalesce(html, '')")} AS bare FROM pages),
l AS (SELECT page_id, regexp_extract_all(bare, '{_TAGS}') AS tags, string_split_regex(bare, '{_TAGS}') AS pieces FROM b),
t AS (SELECT page_id, k, tag, starts_with(tag, '</') AS ends, lower(regexp_extract(tag, '[A-Za-z0-9]+')) AS name FROM (SELECT page_id, unnest(range(len(tags))) AS k, unnest(tags) AS tag FROM l)),
d AS (SELECT *, sum(CASE WHEN name = 'p' THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) + CASE WHEN name = 'p' THEN 1 ELSE 0 END AS depth FROM t),
e AS (
  SELECT o.page_id, o.k, o.name, o.depth, coalesce(min(c.k), any_value(len(l.tags))) AS until
  FROM d o JOIN l ON l.page_id = o.page_id LEFT JOIN d c ON c.page_id = o.page_id AND c.k > o.k AND (o.name = 'p' OR c.ends AND c.name <> 'p' AND c.depth < o.depth)
  WHERE NOT o.ends GROUP BY o.page_id, o.k, o.name, o.depth),
x AS (SELECT e.*, {plain_sql("array_to_string(list_transform(range(k + 1, until + 1), lambda i: pieces[i + 1] || CASE WHEN i < until THEN tags[i + 1] ELSE '' END), '')")} AS text FROM e JOIN l USING (page_id))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS ord, name, depth::INTEGER AS depth, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha256 FROM x""",
    "ruled_metadata": f"SELECT page_id, title, heading, lang, owner, intro FROM ({META_SQL})",
    "ruled_contents": CONTENTS_SQL,
    "comma_normalize": "SELECT doc_id, regexp_replace(text, '([，,])[\t ]+', '\\1', 'g') AS text FROM documents",
    "document_lines": f"""
SELECT doc_id, line_no, text FROM (
  SELECT doc_id, line_no, {clean_sql("raw")} AS text
  FROM (SELECT doc_id, (unnest(range(len(l))))::INTEGER AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE text <> '' AND NOT regexp_matches(text, '^-+$')""",
    "display_format": """
SELECT page_id, length(title)::INTEGER AS width,
       printf('%4d  ', page_id) || CASE WHEN length(title) > 24 THEN title[1:21] || '...' ELSE rpad(title, 24, ' ') END AS row
FROM (""" + META_SQL + ")",
}
