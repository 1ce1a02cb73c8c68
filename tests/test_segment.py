"""Window forms against plain folds, on random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import scan, segment, validate


def lines_of(spark, books):
    rows = [(b, k, t) for b, texts in enumerate(books) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book long, line_no int, text string")


def test_comma_merge_equals_fold(spark):
    rng = random.Random(1)
    books = [[rng.choice(["a", "b,", " c， ", "d ,", "e"]) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    expected = []
    for b, texts in enumerate(books):
        out = []
        for t in texts:
            if out and out[-1].rstrip(" ").endswith((",", "，")):
                out[-1] = out[-1].rstrip(" ") + t.lstrip(" ")
            else:
                out.append(t)
        expected += [(b, k + 1, t.strip(" ")) for k, t in enumerate(out)]
    got = segment.comma_merged(lines_of(spark, books), "book", "line_no").collect()
    assert sorted((r.book, r.para, r.text.strip(" ")) for r in got) == sorted(expected)


def test_volumes_equal_fold(spark):
    rng = random.Random(2)
    pool = ["第一卷 东", "第二卷 西", "第一章 a", "Chapter 2", "（上）", "本卷完", "text", "more"]
    books = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    heads = [{p: rng.choice([None, None, "第一卷 东", "第九卷"]) for p in range(4)} for _ in books]
    rows, expected = [], []
    for b, texts in enumerate(books):
        vid, cid, volume, chapter, opened = 0, 0, "", "正文", None
        groups = {}
        for k, t in enumerate(texts):
            head = heads[b][k // 4] if k % 4 == 0 else None
            rows.append((b, k // 4, k, head, t))
            if t in ("（上）", "本卷完"):
                continue
            if head and head != opened:
                vid, cid, volume, chapter, opened = vid + 1, 0, head, "正文", head
            if t.startswith("第") and "卷" in t:
                vid, cid, volume, chapter, opened = vid + 1, 0, t, "正文", t
            elif t.startswith(("第", "Chapter")):
                cid, chapter = cid + 1, t
            else:
                groups.setdefault((vid, cid), (volume, chapter, []))[2].append(t)
        expected += [(b, v, c, vol, chap, tuple(x)) for (v, c), (vol, chap, x) in groups.items()]
    # A page whose first line is a mark to skip gives its heading with the line, so such pages have none here.
    rows = [(b, p, k, None if t in ("（上）", "本卷完") else h, t) for b, p, k, h, t in rows]
    if any(h and t in ("（上）", "本卷完") for _, _, _, h, t in rows):
        pytest.fail("no heading on skipped lines")
    got = segment.volumes(spark.createDataFrame(rows, "book long, page int, line_no int, heading string, text string")).collect()
    assert sorted((r.book, r.vid, r.cid, r.volume, r.chapter, tuple(r.texts)) for r in got) == sorted(expected)


def test_a_heading_on_a_skipped_line_opens_its_volume(spark):
    rows = [(0, 0, 0, "第一卷 东", "a"), (0, 1, 1, "第二卷 西", "（上）"), (0, 1, 2, None, "b"), (0, 2, 3, "第二卷 西", "本卷完"), (0, 2, 4, None, "c")]
    got = segment.volumes(spark.createDataFrame(rows, "book long, page int, line_no int, heading string, text string")).collect()
    assert sorted((r.vid, r.volume, tuple(r.texts)) for r in got) == [(1, "第一卷 东", ("a",)), (2, "第二卷 西", ("b", "c"))]


def test_sections(spark):
    rows = [(0, 0, k, t) for k, t in enumerate(["front", "2", "b1", "1", "a1"])] + [(0, 1, k, t) for k, t in enumerate(["mid", "2", "b2", "5"])] + [(0, 2, 0, "plain"), (1, 0, 0, "only")]
    lines = spark.createDataFrame(rows, "book long, c long, k int, text string")
    merged = {(r.book, r.kind, r.number): r.text for r in segment.sections_merged(lines).collect()}
    assert merged == {(0, "preface", 0): "front\nmid", (0, "section", 1): "a1", (0, "section", 2): "b1\nb2", (0, "chapter", 2): "plain", (1, "chapter", 0): "only"}
    first = segment.sections_first(lines)
    assert {(r.book, r.number): r.text for r in first.collect()} == {(0, 1): "a1", (0, 2): "b1", (0, 3): "plain", (1, 1): "only"}
    assert segment.missing_numbers(spark.createDataFrame([(0, 1), (0, 4), (1, 7)], "book long, number long")).orderBy("book").collect()[0].missing == "2-3"
    far = spark.createDataFrame([(0, 1), (0, 3), (0, 10**12), (0, None), (1, 5)], "book long, number long")
    assert {r.book: r.missing for r in segment.missing_numbers(far).collect()} == {0: "2,4-999999999999", 1: ""}


def test_posts_without_marks_are_sections(spark):
    posts = ["front\n2\nx\n---\ny", "Title\na-b\n--\n-\nplain", "7", "Title\n---", "5\n--\n6", "--\n9\nz"]
    rows = [(0, c, k, t, "Title") for c, post in enumerate(posts) for k, t in enumerate(post.split("\n"))]
    got = segment.sections_first(spark.createDataFrame(rows, "book long, c long, k int, text string, title string"))
    # The second post's own number is taken, as is what a post of marks only is; the fourth has nothing left.
    assert {r.number: r.text for r in got.collect()} == {2: "x\ny", 3: "7", 5: "5\n6", 9: "z"}


def fold_of(machine):
    """Every machine over lines, as a function of lines and whether books are whole."""
    text = F.col("text")
    return {
        "volumes": lambda d, w: segment.volumes(d.withColumn("page", F.expr("line_no DIV 4")).withColumn("heading", F.expr("CASE WHEN line_no % 4 = 0 AND line_no % 3 = 0 THEN '第九卷' END")), w),
        "turns": lambda d, w: segment.turns(d.withColumn("title", F.lit("T")), w),
        "sections_merged": lambda d, w: segment.sections_merged(d.select("book", F.expr("line_no DIV 9").alias("c"), F.col("line_no").alias("k"), "text"), w),
        "sections_first": lambda d, w: segment.sections_first(d.select("book", F.expr("line_no DIV 9").alias("c"), F.col("line_no").alias("k"), "text"), w),
        "labelled": lambda d, w: segment.labelled(d.withColumnRenamed("text", "volume").where("line_no % 3 > 0"), d.where("line_no % 2 = 0"), order="line_no", whole=w),
        "buckets": lambda d, w: segment.buckets(d.withColumn("text", F.nullif(text, F.lit("more"))), "book", "line_no", "text", w),
        "comma_merged": lambda d, w: segment.comma_merged(d.withColumn("text", F.regexp_replace("text", "text", "a,")), "book", "line_no", w),
        "until": lambda d, w: segment.until(d, "book", "line_no", text == "（上）", w),
        "titles_repaired": lambda d, w: segment.titles_repaired(d, "book", "line_no", "text", text.rlike("t$"), w),
        "adaptive": lambda d, w: segment.adaptive_sections(d, "END", phrases=("xx",), whole=w),
        "sequence_issues": lambda d, w: validate.sequence_issues(d.select(F.col("book").alias("package"), F.lit("u").alias("unit"), F.col("line_no").alias("ord"), F.col("text").try_cast("long").alias("number"), F.col("text").alias("href")), w),
    }[machine]


@pytest.mark.parametrize("machine", "volumes turns sections_merged sections_first labelled buckets comma_merged until titles_repaired adaptive sequence_issues".split())
def test_books_in_parts_are_as_whole_ones(spark, monkeypatch, machine):
    """A book with a third of all lines, cut into parts of a few, gives the rows that windows by book give."""
    monkeypatch.setattr(scan, "PART", 7)
    rng = random.Random(machine)
    pool = ["第一卷 东", "第二卷 西", "第一章 a", "Chapter 2", "（上）", "本卷完", "text", "more", "END", "xx", "第3回 b", "--", *map(str, (1, 2, 3, 5, 20, 21, 22, 40))]
    sizes = [90, 1, 7, 8, 60, 14]
    rows = [(b if b else None, k, rng.choice(pool)) for b, n in enumerate(sizes) for k in range(n)]
    lines = spark.createDataFrame(rows, "book long, line_no int, text string")
    run = fold_of(machine)
    if machine in ("labelled", "adaptive"):
        lines = lines.where("book IS NOT NULL")
    whole, parts = (sorted(map(repr, map(tuple, run(lines, w).collect()))) for w in (True, False))
    assert whole and parts == whole


def test_one_long_book_is_dealt_over_tasks(spark, monkeypatch):
    """The operators find out by themselves that a book is too long for a task, and its rows then lie in many."""
    monkeypatch.setattr(scan, "WHOLE", 1000)
    monkeypatch.setattr(scan, "PART", 500)
    lines = spark.range(20_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END").alias("book"), F.col("id").cast("int").alias("line_no"), F.expr("CASE WHEN id % 50 = 0 THEN CAST(id DIV 50 % 100 AS STRING) ELSE 't' END").alias("text"))
    assert not scan.fits(lines, "book")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = scan.running(lines, ["book"], ["line_no"], False, n=scan.number()).where("book = 0").withColumn("task", F.spark_partition_id())
        assert sorted(r.n for r in rows.collect()) == list(range(1, 6668)) and rows.select("task").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, segment.adaptive_sections(lines, "END").collect())) == sorted(map(repr, segment.adaptive_sections(lines, "END", whole=True).collect()))


def test_a_part_as_a_table_of_states():
    """From every state that a part can begin with, its table leads where the lines lead."""
    rng = random.Random(8)
    for _ in range(30):
        events = [(rng.choice([None, rng.randint(0, 60), rng.randint(0, 9999)]), rng.random() < 0.02, rng.random() < 0.2) for _ in range(rng.randint(1, 200))]
        table, stages = scan.passage(events, 20)
        for state in [(s, n) for s in (0, 1) for n in (0, 1, 17, 40, 5000, 9998, 9999, 10_000, 123_456)]:
            stage, now = state
            for n, opens, splits in events:
                if opens:
                    stage, now = 1, 0
                elif splits and stage == 1:
                    now += 1
                elif n is not None and 0 < n - now <= 20:
                    now = n
            assert scan.passed(state, table, stages) == (stage, now)


def test_adaptive_sections_equal_fold(spark):
    rng = random.Random(3)
    books = [[rng.choice(["x", "END", *map(str, (1, 2, 3, 20, 21, 22, 40, 99999))]) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    expected = {}
    for b, texts in enumerate(books):
        part = now = 0
        for t in texts:
            if t == "END":
                part, now = 1, 0
            elif t.isdigit() and len(t) <= 4 and 0 < int(t) - now <= 20:
                now = int(t)
            else:
                expected.setdefault((b, part, now), []).append(t)
    got = segment.adaptive_sections(lines_of(spark, books), "END").collect()
    assert {(r.book, r.part, r.section): r.text for r in got} == {k: "\n".join(v) for k, v in expected.items()}


def test_prefix_and_overlap(spark):
    df = spark.createDataFrame([(["a b", " ", "c"], ["ab", "c", "d"]), (["x"], ["y"]), ([], ["y"]), (["a", "b"], ["a"])], "i array<string>, c array<string>")
    got = [r[0] for r in df.select(segment.without_prefix(F.col("i"), F.col("c"))).collect()]
    assert got == [["d"], ["y"], ["y"], []]
    df = spark.createDataFrame([(["long enough, one", "short"], ["long enough one"]), (["tiny"], ["tiny"])], "i array<string>, c array<string>")
    assert [r[0] for r in df.select(segment.overlap(F.col("i"), F.col("c"))).collect()] == [1.0, None]


def test_titles_repaired(spark):
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate(["bad.", "good", "worse.", "bad.", "fine"])], "b int, k int, t string")
    got = segment.titles_repaired(df, "b", "k", "t", F.col("t").rlike("[.]$")).orderBy("k").collect()
    assert [r.t for r in got] == ["bad.", "good", "good（续）", "good（续）", "fine"]


def test_sequence_issues(spark):
    numbers = [3, 4, 4, 6, 5, 4]
    refs = spark.createDataFrame([("p", "章", k, n, f"h{k}") for k, n in enumerate(numbers)], "package string, unit string, ord int, number long, href string")
    got = sorted((r.kind, r.number, r.detail) for r in validate.sequence_issues(refs).collect())
    assert got == [("duplicate", 4, "h1; h2; h5"), ("order", 4, "after 5"), ("order", 5, "after 6"), ("order", 6, "after 4")]


def test_sequence_issues_of_far_and_repeated_numbers(spark):
    refs = spark.createDataFrame([("p", "章", 0, 1, "a"), ("p", "章", 1, 10**12, "b"), ("p", "章", 2, None, "c")], "package string, unit string, ord int, number long, href string")
    got = sorted((r.kind, r.number, r.detail) for r in validate.sequence_issues(refs).collect())
    assert got == [("missing", 2, "to 999999999999"), ("order", 10**12, "after 1")]
    same = spark.range(100_000).select(F.lit("p").alias("package"), F.lit("章").alias("unit"), F.col("id").cast("int").alias("ord"), F.lit(7).cast("long").alias("number"), F.lit("h").alias("href"))
    assert [(r.kind, r.number, r.detail.count(";")) for r in validate.sequence_issues(same).collect()] == [("duplicate", 7, 99_999)]


def test_labels_by_place(spark):
    refs = spark.createDataFrame([(0, 1, "v"), (0, 5, "w"), (1, 0, "x")], "book long, ord long, volume string")
    chapters = spark.createDataFrame([(0, 2, "a"), (0, 3, "b"), (1, 0, "c"), (1, 1, "d")], "book long, ord long, title string")
    got = sorted((r.book, r.ord, r.title, str(r.volume), r.asserted) for r in segment.labelled(refs, chapters).collect())
    assert got == [(0, 2, "a", "v", True), (0, 3, "b", "w", True), (1, 0, "c", "x", False), (1, 1, "d", "None", False)]


def test_headings(spark):
    df = spark.createDataFrame([(["第一章 a", "x"], "第一章：A".lower()), (["x"], "y"), ([], "y"), (["y"], "y")], "t array<string>, h string")
    assert [r[0] for r in df.select(segment.without_heading(F.col("t"), F.col("h"))).collect()] == [["x"], ["x"], [], []]
    df = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "b")], "p string, t string")
    assert [r[0] for r in df.select(segment.chosen_title(F.col("p"), F.col("t"))).collect()] == ["a", "b", "b"]


def test_chapters_that_repeat_the_intro(spark):
    intro = ["A first paragraph of it.", " ", "And a second paragraph."]
    rows = [
        (1, 1, 1, "第0章", intro + ["then the story"]), (1, 1, 2, "第0章", intro), (2, 1, 1, "第零章", intro), (3, 1, 1, "第1章", intro), (4, 2, 1, "第 0 章 x", ["文案 内容标签", "立意", "A first paragraph of it!"]),
        (5, 1, 1, "第0章", ["A first paragraph of it.", "something else, long enough"]), (6, 1, 1, "第0章", intro), (None, 1, 1, "第0章", intro),
    ]
    chapters = spark.createDataFrame(rows, "book long, vid long, cid long, chapter string, texts array<string>")
    intros = spark.createDataFrame([(b, intro) for b in (1, 2, 3, 4, 5)], "book long, intro array<string>")
    got = {(r.book, r.cid): r.texts for r in segment.without_repeated_intros(chapters, intros).collect()}
    # Blank paragraphs of the intro don't count, but one of the chapter ends what it repeats.
    assert got == {(1, 1): [" ", "And a second paragraph.", "then the story"], (1, 2): intro, (2, 1): [" ", "And a second paragraph."], (3, 1): intro, (4, 1): rows[4][4], (5, 1): rows[5][4], (6, 1): intro, (None, 1): intro}
