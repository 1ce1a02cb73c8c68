"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charsets import encoded

from .text import unescape

#: scheme, host with port, path
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)"


def decoded(x: Column) -> Column:
    """Percent escapes undone; + stays; a broken escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def bare_host(x: Column) -> Column:
    """A host without www. or m. before it."""
    return F.regexp_replace(x, r"^(?:www|m)\.", "")


def in_domain(x: Column, domain: Column) -> Column:
    """Whether a host is the domain or under it."""
    return (x == domain) | F.endswith(x, F.concat(F.lit("."), domain))


def canonical_url(url: Column) -> Column:
    """Decoded, lower-case host with www., no doubled slashes, query or fragment; null for what has no host."""
    url = decoded(unescape(url))
    name = bare_host(host(url))
    scheme = F.coalesce(F.nullif(F.regexp_extract(url, PARTS, 1), F.lit("")), F.lit("https"))
    return F.when(name != "", F.concat(scheme, F.lit("://www."), name, F.regexp_replace(path(url), "/{2,}", "/")))


def site_url(url: Column, site: Column, prefix: Column) -> Column:
    """canonical_url for one site, null outside it or its path prefix."""
    full = canonical_url(url)
    wanted = F.regexp_replace(F.lower(site), r"^www\.", "")
    return F.when((F.regexp_extract(full, PARTS, 2) == F.concat(F.lit("www."), wanted)) & F.startswith(path(full), prefix), full)


def entry_id(url: Column) -> Column:
    """The number of a blog entry, from its path or its query; empty if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"blog-entry-(\d+)\.html", 1), F.lit("")), F.regexp_extract(url, r"[?&]no=(\d+)", 1))


def mirror_url(url: Column, mirrors: dict[str, str]) -> Column:
    """The URL on the host that its mirror stands for; an entry number in the query moves into the path."""
    name = host(url)
    for mirror, real in mirrors.items():
        name = F.when(F.endswith(name, F.lit(mirror)), real).otherwise(name)
    number = F.regexp_extract(url, r"[?&]no=(\d+)", 1)
    return F.concat(F.lit("http://"), name, F.when(number != "", F.concat(F.lit("/blog-entry-"), number, F.lit(".html"))).otherwise(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))))


def book_url(url: Column) -> Column:
    """The book's URL from its own or one of its chapters'; null for others."""
    origin = F.concat(F.regexp_extract(url, PARTS, 1), F.lit("://"), host(url))
    number = F.coalesce(F.nullif(F.regexp_extract(url, r"/book/(\d+)/?(?:[?#].*)?$", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/book/(\d+)/\d+(?:_\d+)?\.html(?:[?#].*)?$", 1), F.lit("")))
    return F.concat(origin, F.lit("/book/"), number, F.lit("/"))


def chapter_ids(url: Column) -> Column:
    """struct(category, book, chapter) from a chapter's URL; empty strings for others."""
    pattern = r"/chapter/(\d+)_([0-9a-f]+)_([0-9a-f]+)\.html$"
    return F.struct(*(F.regexp_extract(path(url), pattern, k).alias(n) for k, n in enumerate(("category", "book", "chapter"), 1)))


def redirect_target(href: Column) -> Column:
    """Where a search engine's link leads: the uddg value under /l/, the q value under /url?, else the link itself if it is absolute."""
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    uddg = F.regexp_extract(full, r"^[^?#]*/l/\?(?:[^#]*&)?uddg=([^&#]*)", 1)
    q = F.regexp_extract(full, r"^/url\?(?:[^#]*&)?q=([^&#]*)", 1)
    return F.when(F.startswith(full, F.lit("/url?")), decoded(F.nullif(q, F.lit("")))).when(uddg != "", decoded(uddg)).when(F.startswith(full, F.lit("http")), full)


def joined_url(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, from the scheme, from the host, or from the folder."""
    scheme = F.regexp_extract(base, PARTS, 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, PARTS, 2))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(origin, F.coalesce(F.nullif(F.regexp_replace(path(base), "[^/]*$", ""), F.lit("")), F.lit("/")), href))
    )


def charset_encoded(x: Column, charset: str = "GBK") -> Column:
    """Percent escapes of a text's bytes in a charset; letters, digits and _.-~ stay. Null for a text that the charset can't hold."""
    pairs = F.regexp_replace(F.hex(encoded(x, charset)), "(..)", "%$1")
    kept = r"%(?:2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])"
    parts = F.regexp_extract_all(pairs, F.lit("%.."), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(kept), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))).otherwise(p)), "")


def entry_key(url: Column) -> Column:
    """What a blog entry is known by: its number, or its URL if it has none."""
    return F.coalesce(F.nullif(entry_id(url), F.lit("")), url)


def site_query(query: Column, site: Column, prefix: Column) -> Column:
    """The query limited to a site, and to a path on it."""
    folder = F.when(prefix == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(prefix, "^/+|/+$", ""), F.lit("/")))
    return F.concat(F.lit("site:"), F.regexp_replace(site, "/+$", ""), folder, F.lit(" "), query)


def query_variants(query: Column, site: Column, prefix: Column) -> Column:
    """The forms in which a query is tried, in order, each once."""
    hint = F.regexp_replace(site, r"^www\.", "")
    with_path = F.when(prefix != "", F.concat(query, F.lit(" "), hint, prefix))
    return F.array_distinct(F.array_compact(F.array(F.concat(query, F.lit(" "), hint), with_path, site_query(query, site, prefix))))
