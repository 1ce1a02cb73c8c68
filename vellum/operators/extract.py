"""Extraction: landed HTML and JSON to metadata, contents lists, paragraphs and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import bound, clean, escape_html, fold_variants, search_key, unescape
from ..functions.urls import chapter_ids, joined_url

_NOISE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<ins[^>]*>.*?</ins>|<iframe[^>]*>.*?</iframe>|<!--.*?-->"
_ANCHOR = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"

# What stands in a body and isn't text of it.
NAVIGATION = ("0", "上一页", "下一页", "上一章", "下一章", "目录", "返回目录", "加入书签")


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, _NOISE, "")


def plain(fragment: Column) -> Column:
    """A fragment's text: tags out, entities decoded, white space collapsed."""
    return clean(unescape(F.regexp_replace(fragment, "<[^>]*>", "")))


def whole_element(html: Column, tag: str) -> Column:
    """What stands in the first element of a name up to its own end, whatever elements it holds; empty without one."""
    return F.coalesce(markup.first_inside(html, markup.named(tag), markup.CONTAINERS), F.lit(""))


def element(html: Column, tag: str) -> Column:
    """What stands in the first element of a name that holds no element of its kind, as titles and headings."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def paragraphs(html: Column) -> Column:
    """The article's paragraphs in order: an array of texts.

    Paragraphs begin at their tag, closed or not. Blank ones and navigation words go. A body
    without paragraph tags is split at line breaks.
    """
    return paragraphs_in(whole_element(without_noise(html), "article"))


def paragraphs_in(body: Column) -> Column:
    """The paragraphs of an article's body without noise."""

    def found(body: Column) -> Column:
        parts = F.split(body, r"(?i)<p(?:\s[^>]*)?>")
        parts = bound(parts, lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.regexp_replace(x, "(?is)</p>.*$", "")))
        lines = F.split(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), "\n+")
        texts = F.transform(F.when(body.rlike(r"(?i)<p[\s>]"), parts).otherwise(lines), plain)
        return F.filter(texts, lambda t: (t != "") & ~t.isin(*NAVIGATION))

    return bound(body, found)


def page_lines(html: Column) -> Column:
    """The lines of a fragment without scripts and comments: broken at breaks, paragraphs and divisions, trimmed, none blank."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>|</?(?:p|div|li|h[1-6])(?:\s[^>]*)?>", "\n")
    return F.filter(F.transform(F.split(broken, "\n+"), plain), lambda t: t != "")


def text_lines(text: Column) -> Column:
    """array<struct(place, text)>: a text's lines, cleaned, with the places they had, without blank ones and those of dashes only."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), clean(x).alias("text")))
    # Bound, so that the filter doesn't clean each line again.
    return bound(lines, lambda rows: F.filter(rows, lambda r: (r["text"] != "") & ~r["text"].rlike("^-+$")))


def split_at_more(html: Column) -> Column:
    """struct(intro, body): what stands before and after a post's "more" anchor; all is body without one."""
    parts = F.split(html, r"(?i)<a[^>]*name=[\"']more[\"'][^>]*>(?:</a>)?", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("intro"), parts[1].alias("body"))).otherwise(F.struct(F.lit("").alias("intro"), html.alias("body")))


def metadata(pages: DataFrame, *more: str) -> DataFrame:
    """(page_id, title, heading, lang, owner, intro), and more of the pages' columns: the title falls back to the heading, both are empty if absent."""
    # A step for what several columns are cut from, so that it is made once.
    rows = pages.select("page_id", *more, without_noise(F.coalesce("html", F.lit(""))).alias("_bare"))
    bare = F.col("_bare")
    rows = rows.select("page_id", *more, "_bare", plain(element(bare, "h1")).alias("_heading"), F.slice(paragraphs_in(whole_element(bare, "article")), 1, 2).alias("_texts"))
    return rows.select(
        "page_id",
        F.coalesce(F.nullif(plain(element(bare, "title")), F.lit("")), F.col("_heading")).alias("title"),
        F.col("_heading").alias("heading"),
        F.regexp_extract(bare, r"(?i)<html[^>]*\slang=[\"']([^\"']*)[\"']", 1).alias("lang"),
        clean(F.regexp_extract(plain(element(bare, "footer")), "© ([^·]*)·", 1)).alias("owner"),
        F.coalesce(F.array_join("_texts", "\n"), F.lit("")).alias("intro"),
        *more,
    )


def anchors(html: Column) -> Column:
    """array<struct(href, label)> of a fragment's links in order."""
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(2)).alias("label"))
    return F.transform(links, lambda a: F.struct(unescape(a["href"]).alias("href"), plain(a["label"]).alias("label")))


def contents_of(html: Column, inside: str = "nav") -> Column:
    """array<struct(href, label)>: the links of a page's contents list, the first of each target, no blank labels."""
    return bound(whole_element(without_noise(html), inside), lambda part: first_of_each(F.filter(anchors(part), lambda a: a["label"] != "")))


def first_of_each(links: Column) -> Column:
    """Of links(href, label) the first of each target, in order: sorted by target to find them, then by place again."""
    placed = F.array_sort(F.transform(links, lambda a, i: F.struct(a["href"].alias("href"), i.alias("i"), a["label"].alias("label"))))
    firsts = bound(placed, lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["href"] != x["href"])))
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["href"].alias("href"), x["label"].alias("label"))))
    return F.transform(ordered, lambda x: F.struct(x["href"].alias("href"), x["label"].alias("label")))


def contents(pages: DataFrame, inside: str = "nav") -> DataFrame:
    """(page_id, ord, href, label): the contents lists of all pages, each numbered anew. Rows stay where they are."""
    links = pages.select("page_id", F.posexplode(contents_of(F.col("html"), inside)).alias("at", "a"))
    return links.select("page_id", (F.col("at") + 1).alias("ord"), "a.href", "a.label")


def payload_lines(answer: Column) -> Column:
    """The lines in an API answer whose data is a JSON list inside a string; null unless its code is 0."""
    outer = F.from_json(answer, "code int, data struct<content_data: string>")
    return F.when(outer["code"] == 0, F.from_json(outer["data"]["content_data"], "array<string>"))


_RESULT = "struct<title:string,href:string,description:string>"


def _first_anchor(html: Column) -> Column:
    """struct(href, label) of a fragment's first link; null without one."""
    found = bound(F.regexp_extract(html, _ANCHOR, 0), lambda a: F.when(a != "", F.struct(unescape(F.regexp_extract(a, _ANCHOR, 1)).alias("href"), plain(F.regexp_extract(a, _ANCHOR, 2)).alias("label"))))
    return bound(found, lambda a: a)


def _blocks(html: Column, of_block, description) -> Column:
    """array<struct(title, href, description)>: one for each element that is a block and has a link; its title is its heading's text or the link's."""

    def row(b: Column) -> Column:
        heading = plain(F.regexp_extract(b, r"(?is)<h[23][^>]*>(.*?)</h[23]>", 1))
        return bound(
            _first_anchor(b),
            lambda a: F.struct(F.coalesce(F.nullif(heading, F.lit("")), a["label"], F.lit("")).alias("title"), F.coalesce(a["href"], F.lit("")).alias("href"), plain(description(b)).alias("description")),
        )

    return F.filter(F.transform(markup.every_inside(html, of_block), row), lambda r: (r["title"] != "") & (r["href"] != ""))


def _paragraph(b: Column) -> Column:
    return F.regexp_extract(b, r"(?is)<p[^>]*>(.*?)</p>", 1)


def result_blocks(html: Column) -> Column:
    """Results of a page that has a block of class result for each."""
    return _blocks(html, markup.named("div", "result"), _paragraph)


def listed_results(html: Column) -> Column:
    """Results of a page that lists them as items of class b_algo."""
    return _blocks(html, markup.named("li", "b_algo"), _paragraph)


def grouped_results(html: Column) -> Column:
    """Results of a page that has a block of class g or MjjYud for each; of a page without one, all links but those that lead nowhere else."""
    either = lambda *names: lambda tag: markup.named("div", names[0])(tag) | markup.named("div", names[1])(tag)
    described = lambda b: F.coalesce(markup.first_inside(b, either("VwiC3b", "IsZvec")), F.lit(""))
    found = _blocks(html, either("g", "MjjYud"), described)
    every = F.transform(anchors(html), lambda a: F.struct(a["label"].alias("title"), a["href"].alias("href"), F.lit("").alias("description")))
    leads = lambda r: F.startswith(r["href"], F.lit("/url?")) | r["href"].rlike("^https?://")
    return bound(F.filter(found, leads), lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(every, leads)))


def feed_items(xml: Column) -> Column:
    """array<struct(title, href, description)> of an RSS feed: one for each item, whatever it lacks. Read as text, so a feed that is cut off gives the items it has."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1))
    return F.transform(items, lambda i: F.struct(*(plain(element(i, tag)).alias(c) for c, tag in (("title", "title"), ("href", "link"), ("description", "description")))))


#: The search engines, and what reads their answers.
ENGINES = {"duckduckgo": result_blocks, "bing": listed_results, "bing_feed": feed_items, "google": grouped_results}


def results_of(engine: Column, answer: Column) -> Column:
    """struct(items, error): an engine's answer read by its form; an unknown engine has no items and an error."""
    items = F.array().cast(f"array<{_RESULT}>")
    for name, read in ENGINES.items():
        items = F.when(engine == name, read(answer)).otherwise(items)
    known = F.coalesce(engine.isin(*ENGINES), F.lit(False))
    return _once(items.alias("items"), F.when(~known, F.concat(F.lit("unknown search engine: "), F.coalesce(engine, F.lit("null")))).alias("error"))


def _once(*fields: Column) -> Column:
    """A struct that is made once, though several columns are read from it."""
    return bound(F.struct(*fields), lambda s: s)


def native_results(html: Column, entry: str) -> Column:
    """array<struct(title, href, snippet)> of a site's own results page: of each list item that links to an entry, the first such link; the snippet is the item's whole text.

    An item that holds a list has the text and links of that list's items, too, which are items of their own.
    """
    spaced = lambda x: clean(unescape(F.regexp_replace(x, "<[^>]*>", " ")))

    def row(item: Column) -> Column:
        heading = plain(F.regexp_extract(item, r"(?is)<h[23][^>]*>(.*?)</h[23]>", 1))
        link = F.get(F.filter(anchors(item), lambda a: a["href"].rlike(entry)), F.lit(0))
        return bound(link, lambda a: F.struct(F.coalesce(F.nullif(a["label"], F.lit("")), heading).alias("title"), a["href"].alias("href"), spaced(item).alias("snippet")))

    return F.filter(F.transform(markup.every_inside(html, markup.named("li")), row), lambda r: r["href"].isNotNull() & (r["title"] != ""))


# How the title of a post that lists others begins.
CATALOG_TITLE = r"(?i)^(?:目錄|目录)(?:\b|[-（(]|$)"


def is_catalog(title: Column, snippet: Column) -> Column:
    """Whether a result is a post that lists others: by its title's beginning, or by the word in title or snippet."""
    named = title.rlike(CATALOG_TITLE) | F.startswith(F.lower(F.trim(title)), F.lit("updated to"))
    for word in ("目錄", "目录"):
        named = named | F.contains(title, F.lit(word)) | F.contains(snippet, F.lit(word))
    return named


def is_relevant(query: Column, title: Column, author: Column) -> Column:
    """Whether the query's key is in the title's or the author's; an empty query is in any."""
    q = search_key(query)
    return (q == "") | F.contains(search_key(title), q) | F.contains(search_key(author), q)


def attribute(html: Column, name: str) -> Column:
    """The value of a data attribute, where it stands first; empty without one."""
    return unescape(F.regexp_extract(html, rf"(?i)\bdata-{name}=[\"']([^\"']*)[\"']", 1))


def of_class(html: Column, tag: str, name: str) -> Column:
    """What stands in the first element of a tag and class, up to its own end; null without one."""
    return markup.first_inside(html, markup.named(tag, name), markup.CONTAINERS if tag in markup.CONTAINERS else markup.NAMES)


def tags_of_class(html: Column, class_name: str, tag: str = "[a-z][a-z0-9]*") -> Column:
    """The opening tags that have a class, in order."""
    return F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\s[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>"), F.lit(0)), markup.named(tag, class_name))


def data_of(html: Column, class_name: str, *names: str) -> Column:
    """struct of the data attributes, by their names, of the first element of a class; null without one."""
    first = F.get(tags_of_class(html, class_name), F.lit(0))
    return bound(first, lambda tag: F.when(tag.isNotNull(), F.struct(*(clean(attribute(tag, n)).alias(n) for n in names))))


# The classes of a detail page's parts.
DETAIL, DETAIL_AUTHOR, DETAIL_START, CHAPTER_DATA = "page-novel", "auth", "js_chapter_history", "js_page_novel_chapter"


def detail_page(html: Column, url: Column) -> Column:
    """struct(title, author, category, start) of a book's detail page: its heading up to a chapter's number or an underscore, else the page's title up to an underscore or dash; the author;
    where reading starts, as a URL, and the category that this names. What is absent is empty."""
    bare = without_noise(F.coalesce(html, F.lit("")))
    block = F.coalesce(markup.first_inside(bare, markup.named("[a-z][a-z0-9]*", DETAIL)), F.lit(""))

    def read(block: Column) -> Column:
        heading = F.regexp_extract(plain(element(block, "h1")), r"^(.*?)(?:_第[0-9]+章|_|$)", 1)
        named = F.coalesce(F.nullif(heading, F.lit("")), F.regexp_extract(plain(element(bare, "title")), "^([^_-]*)", 1))
        author = F.coalesce(plain(markup.first_inside(block, markup.named("[a-z][a-z0-9]*", DETAIL_AUTHOR))), F.lit(""))
        hrefs = F.transform(tags_of_class(block, DETAIL_START, "a"), lambda t: unescape(F.regexp_extract(t, r"(?i)\shref=[\"']([^\"']*)[\"']", 1)))
        start = F.get(F.filter(hrefs, lambda h: h != ""), F.lit(0))
        return bound(
            F.when(start.isNotNull(), joined_url(url, start)).otherwise(""),
            lambda at: F.struct(clean(named).alias("title"), author.alias("author"), chapter_ids(at)["category"].alias("category"), at.alias("start")),
        )

    return bound(block, read)


def next_page(html: Column, inside: str = "") -> Column:
    """The target of the first link called 下一页 whose target contains `inside`; null without one."""
    link = F.get(F.filter(anchors(html), lambda a: F.contains(a["label"], F.lit("下一页")) & F.contains(a["href"], F.lit(inside))), F.lit(0))
    return link["href"]


# Lines of a body that are the site's; the first and last alternative are bound to the line's ends, the others are found anywhere.
BOILERPLATE = r"^霹雳书屋|本站所有小说|所有内容版权|最新网址|手机用户请到|加入书签|推荐本书|返回目录$"


def without_boilerplate(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(BOILERPLATE))


def intro_html(html: Column) -> Column:
    """An intro as simplified paragraphs: parted at blank lines, with the breaks inside kept."""
    text = unescape(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), "<[^>]*>", ""))
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), fold_variants(F.replace(escape_html(p), F.lit("\n"), F.lit("<br/>"))), F.lit("</p>"))), "\n")


def category_page(html: Column) -> Column:
    """struct(title, intro, posts) of a category's page: its title, its first paragraphs, and the posts its contents list names."""
    bare = without_noise(F.coalesce(html, F.lit("")))
    title = bound(bare, lambda b: F.coalesce(F.nullif(plain(element(b, "h1")), F.lit("")), plain(element(b, "title"))))
    return F.struct(title.alias("title"), F.slice(paragraphs(html), 1, 2).alias("intro"), contents_of(html).alias("posts"))


def page_record(html: Column, container: str = "main") -> Column:
    """struct(title, lines, error) of a chapter's page: its heading, and the lines after it in the container. A page without the container, and one
    without lines, has an error; a null page is missing."""
    body = of_class(without_noise(F.coalesce(html, F.lit(""))), "div", container)

    def read(body: Column) -> Column:
        return bound(
            F.split(F.coalesce(body, F.lit("")), r"(?i)</h1>", 2),
            lambda parts: F.struct(F.when(F.size(parts) == 2, plain(parts[0])).otherwise("").alias("title"), page_lines(F.element_at(parts, -1)).alias("lines"), body.isNotNull().alias("there")),
        )

    error = lambda r: F.when(html.isNull(), "missing page").when(~r["there"], "no container").when(F.size(r["lines"]) == 0, "empty body")
    return bound(bound(body, read), lambda r: F.struct(r["title"].alias("title"), r["lines"].alias("lines"), error(r).alias("error")))


def mentioning(links: Column, domain: Column) -> Column:
    """The links whose target or label names a domain."""
    return F.filter(links, lambda a: F.contains(a["href"], domain) | F.contains(a["label"], domain))


def labelled(lines: Column, label: str) -> Column:
    """The value that stands after a label and a colon in the first line that has it; empty if none does."""
    pattern = rf"^{label}\s*[:：]\s*(.*)$"
    return F.coalesce(F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0)), pattern, 1), F.lit(""))


def title_parts(page_title: Column) -> Column:
    """struct(title, author, status) of a page's "title(author)/.../status"; what is absent is empty."""
    return F.struct(
        clean(F.regexp_extract(page_title, r"^([^(（/]*)", 1)).alias("title"),
        clean(F.regexp_extract(page_title, r"[(（]([^()（）]+)[)）]", 1)).alias("author"),
        clean(F.regexp_extract(page_title, r"/([^/]*)$", 1)).alias("status"),
    )


def author_of(page_title: Column, intro: Column, aliases: dict[str, str]) -> Column:
    """The author in the title's bracket, else after BY in the intro; a short form becomes the full one."""
    bracket = clean(F.regexp_extract(page_title, r"\(([^()]+)\)", 1))
    name = F.when(bracket != "", bracket).otherwise(F.regexp_extract(intro, r"(?i)\bby\s*([^\s，,。；;、]+)", 1))
    for short, full in aliases.items():
        name = F.when(name == short, full).otherwise(name)
    return name


def declared(heading: Column) -> Column:
    """struct(title, total) of a catalog's 《title》共N节; null total without one."""
    pattern = r"《(.+?)》共([0-9]+)节"
    return F.struct(clean(F.regexp_extract(heading, pattern, 1)).alias("title"), F.regexp_extract(heading, pattern, 2).try_cast("long").alias("total"))


# Navigation and advertising lines of paginated bodies; the first is for whole lines.
_NAV_LINE = r"^(?:上[0-9一二三四五六七八九十]?一?章|下[0-9一二三四五六七八九十]?一?页|目录|加书签)$"
_ADVERT = r"本章未完[，,].{0,30}(?:下一页|继续阅读)|请?点击下一页继续阅读|^[（(]?本章完[)）]?$|为您提供.{0,30}的小说|继续阅读请点击下一?页"


def body_lines(text: Column) -> Column:
    """struct(lines, continues) of a body that marks paragraphs by indentation: its lines without navigation
    and adverts, and whether the first goes on from the page before, which it does if it isn't indented."""
    raw = F.split(text, "\n+")
    fine = F.filter(raw, lambda x: (clean(x) != "") & ~clean(x).rlike(_NAV_LINE) & ~clean(x).rlike(_ADVERT))
    return F.struct(F.transform(fine, clean).alias("lines"), F.coalesce(~F.get(fine, F.lit(0)).rlike("^[\u00a0\u3000]{2,}"), F.lit(False)).alias("continues"))


# The form of a line that heads a review, and the words of which it has one.
_REVIEW_FORM = r"(?i)^(?:[^，。！？；\n]{0,40})?(?:(?:作品)?简评|编辑评价|强推奖章)(?:\s*[:：】）)]?|[^\s，。！？；\n]*\.(?:gif|jpe?g|png|webp))?$"
_REVIEW_WORDS, _REVIEW_IMAGE = "作品简评|编辑评价|强推奖章|^简评", r"\.(?:gif|jpg|png)"


def is_review_heading(line: Column) -> Column:
    """Whether a line of an intro heads a review, after which nothing is intro: of the form, and with one of its words."""
    x = F.regexp_replace(line, r"\s+", "")
    return x.rlike(_REVIEW_FORM) & (x.rlike(_REVIEW_WORDS) | F.lower(x).rlike(_REVIEW_IMAGE))


def intro_paragraphs(text: Column) -> Column:
    """An intro's paragraphs up to a review's heading."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"^\s*小说简介\s*[:：]?\s*", ""), "\n+"), clean), lambda x: x != "")
    stop = F.array_position(F.transform(parts, is_review_heading), True).cast("int")
    return F.when(stop > 0, F.slice(parts, F.lit(1), stop - 1)).otherwise(parts)


def cover_extension(mime: Column) -> Column:
    return F.coalesce(F.when(mime == "image/png", ".png").when(mime == "image/gif", ".gif").when(mime == "image/webp", ".webp"), F.lit(".jpg"))


def cover_mime(name: Column) -> Column:
    """The kind of a cover by its file's name; jpeg for other names."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.when(kind.isin("png", "gif", "webp"), F.concat(F.lit("image/"), kind)), F.lit("image/jpeg"))
