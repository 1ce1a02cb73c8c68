"""Landed files, feeds and streams."""

import random

from pyspark.sql import functions as F

from vellum.functions import charsets
from vellum.operators import closure, publish
from vellum.sources import tables
from vellum.streaming import pages


def test_identifier_is_stable(spark):
    row = spark.range(1).select(publish.identifier(F.lit("com"), F.lit(7)).alias("a"), publish.identifier(F.lit("com"), F.lit(7)).alias("b"), publish.identifier(F.lit("net"), F.lit(7)).alias("c")).first()
    assert row.a == row.b != row.c


def test_landed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code": 0, "data": {"content_data": "[\\"one\\", \\"two\\"]"}}\n{"code": 1}\n')
    from vellum.operators.extract import payload_lines

    rows = tables.landed_json(spark, f"file://{tmp_path}", "code int, data struct<content_data: string>").select(payload_lines(F.to_json(F.struct("code", "data"))).alias("lines"))
    assert sorted((r.lines for r in rows.collect()), key=str) == [None, ["one", "two"]]


def test_charsets_of_files(spark, tmp_path):
    text = "第一章 远山，长街。"
    for name, raw in {"gbk": text.encode("gbk"), "utf8": text.encode(), "mark": text.encode("utf-16"), "big5": "第一章 遠山，長街。".encode("big5"), "cut": text.encode("gbk")[:-1]}.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
    files = tables.landed_files(spark, f"file://{tmp_path}", "*.txt").select(F.regexp_extract("path", r"(\w+)\.txt", 1), tables.decoded_file(F.col("content"), None))
    assert dict(map(tuple, files.collect())) == {"gbk": text, "utf8": text, "mark": text, "big5": "第一章 遠山，長街。", "cut": text[:-1] + "\ufffd"}


def test_share_of_right_charsets():
    """Made texts of 12 to 200 characters in six charsets: all but a few in a hundred are found by their bytes alone."""
    rng = random.Random(12)
    hanzi = {c: sorted(x for x in charsets.common(c) if "\u4e00" <= x <= "\u9fff") for c in ("gb18030", "big5", "shift_jis")}
    kana = [chr(c) for c in range(0x3041, 0x3094)]
    letters = {"windows-1251": [chr(c) for c in range(0x430, 0x450)], "windows-1252": list("aeiou" * 6 + "éèàçüñö")}

    def made(charset):
        n = rng.randint(12, 200)
        if charset == "shift_jis":
            return "".join(rng.choice(kana if rng.random() < 0.6 else hanzi[charset]) for _ in range(n))
        if charset in letters:
            return " ".join("".join(rng.choice("bcdfg" if charset == "windows-1252" and k % 2 else letters[charset]) for k in range(rng.randint(2, 9))) for _ in range(n // 4)) + (" é" if charset == "windows-1252" else "")
        source = hanzi["gb18030" if charset == "utf-8" else charset]
        return "".join(rng.choice(source) if rng.random() < 0.9 else rng.choice("，。 a1") for _ in range(n)) + source[0]

    for charset in ("utf-8", "gb18030", "big5", "shift_jis", "windows-1251", "windows-1252"):
        texts = [made(charset) for _ in range(300)]
        right = sum(charsets.charset_of(t.encode(charset)) == (charset, "bytes") for t in texts)
        assert right >= 0.98 * len(texts), (charset, right)
        assert sum(charsets.decode(t.encode(charset))[2] == t for t in texts) >= 0.98 * len(texts)


def test_letters_with_accents_are_no_byte_pairs():
    """Bytes that could be half-width kana or a rare Chinese letter: among Latin letters, or alone, they are capitals, ß and the like; in runs they are kana."""
    for text in ("Der einßenlich die, enlich dem und.", "ENAU! FÜRSCHÜKEITZU! ALS! DER! FÜR!", "ertzlich, ertzlich, ß, ß, ß, ß, ß, ", "GRÖßE und anderes", "der. Öäver die", "be.\nÄber ieung", "osci. Ñíco."):
        assert charsets.decode(text.encode("windows-1252")) == ("windows-1252", "bytes", text)
    for text in ("ﾆﾎﾝｺﾞ ﾃｷｽﾄ", "<p>ﾆﾎﾝｺﾞ</p> <b>ｱｲｳ</b>"):
        assert charsets.decode(text.encode("shift_jis")) == ("shift_jis", "bytes", text)
    for text in ("A股 上涨，T恤 一件", "<b>第一章</b> 远山"):
        assert charsets.decode(text.encode("gbk")) == ("gb18030", "bytes", text)


def test_few_different_words_are_found():
    """A few words again and again, single letters, a last byte that is none and the sign for such bytes are no other charset's; elements of one letter and escapes in scripts are still text."""
    found = [("windows-1252", t) for t in ("éèen " * 50, "ññas " * 60, "éé " * 70, "ÉTÉ", "enréoi ÊÇ!! " * 20, "Größ", "enlich " * 30 + "zuö")] + [("gb18030", "要时 " * 80), ("gb18030", "时为 " * 60), ("utf-8", "a\ufffdb"), ("utf-8", "到 " * 100)]
    found += [(c, "<li>春</li><li>夏</li><li>秋</li><li>冬</li>") for c in ("gb18030", "big5")] + [("windows-1251", "var s='Текст\\nТекст\\nна русском';"), ("windows-1251", "<b>Глава 1</b> Дом"), ("windows-1251", "США и СССР в XX веке"), ("utf-8", "һәм үз абруйлары һәм"), ("utf-8", "The word ˈfəʊnətɪk")]
    assert [(t, charsets.decode(t.encode(c))) for c, t in found] == [(t, (c, "bytes", t)) for c, t in found]
    for text in ("è " * 110, "到 " * 100):
        assert charsets.decode(text.encode() + b"\xff") == ("utf-8", "bytes", text + "\ufffd")
    assert charsets.decode("<meta charset=utf-8>a\ufffdb é".encode())[:2] == ("utf-8", "declared")


def test_charsets_take_few_texts_at_a_time(spark):
    """Whole texts go to Python by the hundred, not by Arrow's ten thousand, even where the session prefers Arrow; each row may be written in a charset of its own."""
    texts = [("é", "windows-1252"), ("é", "utf-8"), ("章", "big5"), ("章", "windows-1252"), ("章", None), (None, "utf-8")]
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        raw = spark.createDataFrame(texts, "x string, c string").coalesce(1).select(charsets.encoded(F.col("x"), F.col("c")).alias("raw"))
        found = raw.select("raw", charsets.decoded(F.col("raw")).alias("d"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        assert [r[0] and bytes(r[0]) for r in spark.createDataFrame([("é章&",), (None,)], "x string").select(charsets.encoded(F.col("x"), "windows-1252", references=True)).collect()] == [b"\xe9&#31456;&", None]
        assert [r.raw and bytes(r.raw) for r in found.collect()] == [b"\xe9", "é".encode(), "章".encode("big5"), None, None, None]
        assert [r.d.charset if r.d else None for r in found.collect()][3:] == [None] * 3
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")


def test_declared_charsets_count_if_they_read_the_text():
    raw = "<meta charset='GB2312'>第一章".encode("gbk")
    assert charsets.charset_of(raw) == ("gb18030", "declared")
    assert charsets.charset_of(b'<?xml version="1.0" encoding="Shift_JIS"?>\x82\xa0') == ("shift_jis", "declared")
    assert charsets.charset_of("<meta charset=utf-8>第一章远山长街".encode("gbk")) == ("gb18030", "bytes")
    assert charsets.charset_of(b"<meta charset=nothing-known>plain") == ("utf-8", "bytes")


def test_feed_and_blocks(spark):
    from vellum.operators.extract import anchors, feed_items, mentioning, page_lines, split_at_more

    feed = "<rss><channel><item><title>A  b</title><link>https://a.example/1</link><description>d</description></item><item><title>C</title><link>https://a.example/2</link><description>e</description></item></channel></rss>"
    items = spark.range(1).select(feed_items(F.lit(feed)).alias("i")).first().i
    assert [(x.title, x.href, x.description) for x in items] == [("A b", "https://a.example/1", "d"), ("C", "https://a.example/2", "e")]
    html = '<div><a href="https://a.example/x">One</a><br>two<a href="/y">a.example</a><a href="/z">no</a></div>'
    links = spark.range(1).select(mentioning(anchors(F.lit(html)), F.lit("a.example")).alias("l")).first().l
    assert [x.href for x in links] == ["https://a.example/x", "/y"]
    assert spark.range(1).select(page_lines(F.lit("<p>a</p><p> </p>b<br/>c &amp; d<div>e</div>")).alias("l")).first().l == ["a", "b", "c & d", "e"]
    more = spark.range(1).select(split_at_more(F.lit('in<a name="more"></a>body')).alias("m"), split_at_more(F.lit("all")).alias("n")).first()
    assert tuple(more.m) == ("in", "body") and tuple(more.n) == ("", "all")


def test_stream_of_pages(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "https://www.a.example/x", "<title>A</title>", 0), (2, "https://a.example/x?y", "<title>A</title>", 60), (3, "https://b.example/", "<title>B</title>", 120)], "page_id long, url string, html string, s long"
    ).select("page_id", "url", "html", F.timestamp_seconds("s").alias("landed"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = pages.landed_pages(spark, f"file://{tmp_path}/in")
    for name, df, mode in (("fresh", pages.fresh_pages(stream), "append"), ("counts", pages.landing_counts(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert sorted(r.title for r in spark.table("fresh").collect()) == ["A", "B"]
    assert {r.host: r.n for r in spark.table("counts").collect()} == {"a.example": 2, "b.example": 1}


def test_chains_of_any_length(spark):
    links = spark.createDataFrame([(f"/{k}", f"/{k + 1}") for k in range(149)] + [("/149", "/0")], "from_url string, to_url string")
    got = closure.chains(spark.createDataFrame([("/0",)], "url string"), links).collect()
    assert sorted((r.start, r.place, r.url) for r in got) == sorted(("/0", k, f"/{k}") for k in range(150))


def test_paged_chains_are_walked_by_doubling(spark):
    """A chain of 10,000 pages, one that ends in a cycle, and a page that links to itself."""
    links = [(f"/{k}", f"/{k + 1}") for k in range(9999)] + [(f"c{k}", f"c{(k + 1) if k < 9 else 4}") for k in range(10)] + [("s", "s"), ("n", None)]
    got = closure.paged(spark.createDataFrame([("/0",), ("c0",), ("s",), ("n",)], "url string"), spark.createDataFrame(links, "from_url string, to_url string")).collect()
    want = [("/0", k, f"/{k}") for k in range(10_000)] + [("c0", k, f"c{k}") for k in range(10)] + [("s", 0, "s"), ("n", 0, "n")]
    assert sorted((r.start, r.place, r.url) for r in got) == sorted(want)


def test_charset_encoding(spark):
    from vellum.functions.urls import charset_encoded

    rows = spark.createDataFrame([("林a_1 木",), ("😀",), (None,), ("",)], "x string").select(charset_encoded(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["%C1%D6a_1%20%C4%BE", None, None, ""]


def test_broken_feeds_and_unknown_engines(spark):
    from vellum.operators.extract import attribute, next_page, page_record, results_of

    row = spark.range(1).select(
        results_of(F.lit("bing_feed"), F.lit("<rss><item><title>A</title><link>u?a&b</link></item><item><title>cut")).alias("feed"),
        results_of(F.lit("other"), F.lit("x")).alias("other"),
        attribute(F.lit('<i data-id="1" data-name="N &amp; m">'), "name").alias("name"),
        next_page(F.lit('<a href="/x">下一页</a><a href="/menu/2">下一页</a>'), "/menu/").alias("next"),
        page_record(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert [(x.title, x.href) for x in row.feed["items"]] == [("A", "u?a&b")] and row.feed.error is None
    assert row.other["items"] == [] and row.other.error == "unknown search engine: other"
    assert (row.name, row.next, row.none.error) == ("N & m", "/menu/2", "missing page")


def test_landing_goes_on_where_it_was(spark, tmp_path):
    """Passes over a folder that fills: what comes again is passed over, late rows go, a pass without news adds nothing, and after all the table is as one batch would make it."""
    at = lambda name: f"file://{tmp_path}/{name}"
    minute = lambda m: 600_000_000 + 60 * m

    def arrive(*rows):
        df = spark.createDataFrame([(k, f"https://m.a.example/{u}", f"<title>{t}</title>", minute(m)) for k, (u, t, m) in enumerate(rows)], "page_id long, url string, html string, s long")
        df.select("page_id", "url", "html", F.timestamp_seconds("s").alias("landed")).write.mode("append").parquet(at("in"))

    def landed():
        pages.land(spark, at("in"), at("out"), at("passes"), partitions=2)
        return sorted((r.url.rsplit("/", 1)[-1], r.title) for r in spark.read.parquet(at("out")).collect())

    arrive(("x", "X", 0), ("x?again", "X", 0), ("y", "Y", 10))
    assert landed() == [("x", "X"), ("y", "Y")]
    assert landed() == [("x", "X"), ("y", "Y")]
    arrive(("x", "new", 20), ("z", "Z", 90))
    assert landed() == [("x", "X"), ("y", "Y"), ("z", "Z")]
    arrive(("late", "L", 5), ("w", "W", 95))
    assert landed() == [("w", "W"), ("x", "X"), ("y", "Y"), ("z", "Z")]
    arrive(("v", "V", 500))
    landed()
    arrive(("x", "X2", 501))
    assert landed() == [("v", "V"), ("w", "W"), ("x", "X"), ("x", "X2"), ("y", "Y"), ("z", "Z")]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
