"""Segmentation: ordered lines to volumes, chapters and sections.

Each machine over ordered lines is a flag for what opens a group, a running sum of the flags, and
a grouping by it. What runs are windows by book, or where a book has more lines than a task should walk, parts of it that go on from each other (scan.py): each operator
finds that out by counting, unless `whole` says it. Places of lines are numbers that rise within a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import scanned
from ..functions.text import bound, paragraph_key
from ..functions.titles import NUMERAL
from ..sources.landing import landed
from . import scan

# Patterns of volume, chapter and turn headings, and of lines to skip.
_N = f"[{NUMERAL}0-9]+"
VOLUME = rf"^\s*第\s*{_N}\s*卷"
CHAPTER = rf"^\s*(?:第\s*{_N}\s*章|(?i:chapter)\s*[0-9]+)"
TURN = rf"^\s*(?:.+?\s+)?(第\s*{_N}\s*回(?:\s+.*)?)\s*$"
SKIP = rf"^\s*(?:[（(]?[上中下][)）]?|第{_N}卷[^\n]{{0,20}}[完終终]|卷[{NUMERAL}0-9]*[結结][束尾]|本卷[終终完])\s*$"


def is_volume(x: Column) -> Column:
    """A volume's heading: up to 40 characters, and not the mark of its end."""
    return (F.length(x) <= 40) & x.rlike(VOLUME) & ~x.rlike("[完終终]")


def is_chapter(x: Column) -> Column:
    return (F.length(x) <= 60) & x.rlike(CHAPTER)


def volumes(lines: DataFrame, whole: bool | None = None) -> DataFrame:
    """(book, vid, cid, volume, chapter, texts): lines(book, page, line_no, heading, text) by volumes and chapters.

    line_no runs on from page to page. heading is the volume that a page's heading names, on the page's first line, or null. It opens
    a volume if it differs from the open one; a volume line always does. Lines before the first
    chapter of a volume are its body; chapters without lines, and marks to skip, go.
    """
    whole = scan.fits(lines, "book") if whole is None else whole
    # The heading is an event of its own, before its line; it stays where that line is a mark to skip.
    event = lambda text, head: F.struct(text.alias("text"), F.lit(head).alias("head"))
    events = F.array_compact(F.array(F.when(F.col("heading").isNotNull(), event(F.col("heading"), True)), F.when(~F.col("text").rlike(SKIP), event(F.col("text"), False))))
    rows = lines.select("book", "line_no", F.explode(events).alias("e")).select("book", "line_no", "e.*", (~F.col("e.head")).alias("line"))
    order = ["line_no", "line"]
    named = F.when(F.col("head") | is_volume(F.col("text")), F.trim("text"))
    rows = scan.running(rows.withColumn("named", named), ["book"], order, whole, open_name=scan.last(F.col("named"), before=True))
    opens = F.col("named").isNotNull() & (~F.col("head") | F.col("open_name").isNull() | (F.col("named") != F.col("open_name")))
    rows = rows.withColumn("opens", opens).where("NOT head OR opens").withColumn("chap", ~F.col("opens") & is_chapter(F.col("text")))
    rows = scan.running(rows, ["book"], order, whole, vid=scan.total(F.col("opens").cast("long")), volume=scan.last(F.when(F.col("opens"), F.col("named"))))
    rows = scan.running(rows, ["book", "vid"], order, whole, cid=scan.total(F.col("chap").cast("long")))
    line = F.when(~F.col("opens") & ~F.col("chap"), F.struct("line_no", "text"))
    # All windows and this grouping are by book or finer, so the lines are shuffled once.
    parts = rows.groupBy("book", "vid", "cid").agg(F.max("volume").alias("volume"), F.max(F.when(F.col("chap"), F.trim("text"))).alias("chapter"), F.sort_array(F.collect_list(line)).alias("items"))
    parts = parts.where(F.size("items") > 0)
    return parts.select("book", "vid", "cid", F.coalesce("volume", F.lit("")).alias("volume"), F.coalesce("chapter", F.lit("正文")).alias("chapter"), F.transform("items", lambda i: i["text"]).alias("texts"))


def turns(lines: DataFrame, whole: bool | None = None) -> DataFrame:
    """(book, cid, chapter, texts): lines(book, title, line_no, text) by headings of one form, which may begin with the book's title.
    Lines that begin with a bracket are never headings; what stands before the first heading is a chapter named as the book."""
    heading = F.when(~F.col("text").rlike(r"^[（(【]"), F.nullif(F.regexp_extract("text", TURN, 1), F.lit("")))
    rows = lines.withColumn("heading", F.trim(F.regexp_replace(heading, r"\s+", " ")))
    rows = scan.running(rows, ["book"], ["line_no"], scan.fits(lines, "book") if whole is None else whole, cid=scan.total(F.col("heading").isNotNull().cast("long")))
    line = F.when(F.col("heading").isNull(), F.struct("line_no", "text"))
    parts = rows.groupBy("book", "cid").agg(F.coalesce(F.max("heading"), F.max("title")).alias("chapter"), F.sort_array(F.collect_list(line)).alias("items"))
    return parts.where(F.size("items") > 0).select("book", "cid", "chapter", F.transform("items", lambda i: i["text"]).alias("texts"))


def numbered(lines: DataFrame, whole: bool) -> DataFrame:
    """lines(book, c, k, text) with seg, the number of markers so far in the chapter, and n, the last one's number. A marker is a line that is only a number."""
    marker = F.when(F.col("text").rlike("^[0-9]+$"), F.col("text").try_cast("long"))
    # By book, which serves the windows by chapter and all that follows.
    rows = lines.repartition("book") if whole else lines
    return scan.running(rows.withColumn("marker", marker), ["book", "c"], ["k"], whole, seg=scan.total(F.col("marker").isNotNull().cast("long")), n=scan.last(F.col("marker")))


def _joined(items: str) -> Column:
    return F.array_join(F.transform(F.sort_array(items), lambda i: i["text"]), "\n")


def sections_merged(lines: DataFrame, whole: bool | None = None) -> DataFrame:
    """(book, kind, number, text): numbered sections, those of equal number merged in order; text before a chapter's first
    marker is the preface; chapters without a marker pass through under their own number. A book without any section keeps its chapters."""
    whole = scan.fits(lines, "book") if whole is None else whole
    rows = scan.over_all(numbered(lines, whole), ["book", "c"], whole, marked=F.max("seg")).where("marker IS NULL")
    rows = scan.over_all(rows, ["book"], whole, sectioned=F.max(F.col("seg") > 0))
    # Without sections the chapters come back with their marker-free lines.
    kind = F.when(~F.col("sectioned") | (F.col("marked") == 0), "chapter").when(F.col("seg") > 0, "section").otherwise("preface")
    number = F.when(kind == "chapter", F.col("c")).when(kind == "section", F.col("n")).otherwise(F.lit(0)).cast("long")
    return rows.groupBy("book", kind.alias("kind"), number.alias("number")).agg(F.collect_list(F.struct("c", "k", "text")).alias("items")).select("book", "kind", "number", _joined("items").alias("text"))


def sections_first(lines: DataFrame, whole: bool | None = None) -> DataFrame:
    """(book, number, text): numbered sections, of those of equal number the first; text before the first marker goes, and lines of dashes only.

    lines(book, c, k, text), and title if posts have one. A post c in which no section has a line is a section of its own: all its lines, its marks too, but those that
    are its title or dashes; its number is its place c plus one. If nothing is left, it isn't there.
    """
    whole = scan.fits(lines, "book") if whole is None else whole
    title = F.col("title") if "title" in lines.columns else F.lit(None).cast("string")
    fine = ~F.col("text").rlike(r"^-*\z")
    rows = numbered(lines.withColumn("own", fine & ~F.coalesce(F.col("text") == title, F.lit(False))).withColumn("fine", fine), whole)
    rows = rows.withColumn("inside", F.col("marker").isNull() & (F.col("seg") > 0) & F.col("fine"))
    rows = scan.over_all(rows, ["book", "c"], whole, sectioned=F.max("inside"))
    number, seg = (F.when(F.col("sectioned"), F.col(x)).otherwise(y) for x, y in (("n", (F.col("c") + 1).cast("long")), ("seg", F.lit(0).cast("long"))))
    kept = F.when(F.col("sectioned"), F.col("inside")).otherwise(F.col("own"))
    parts = rows.where(kept).groupBy("book", number.alias("n"), "c", seg.alias("seg")).agg(F.collect_list(F.struct("k", "text")).alias("items"))
    first = parts.groupBy("book", "n").agg(F.min_by("items", F.struct("c", "seg")).alias("items"))
    return first.select("book", F.col("n").alias("number"), _joined("items").alias("text"))


def gaps(numbers: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """(keys, first, last): the runs of numbers between the least and the greatest of each key that it lacks. A run is one row, however long; nulls don't count."""
    rows = numbers.where(F.col(number).isNotNull()).select(*keys, F.col(number).alias("n")).distinct()
    after = F.lead("n").over(Window.partitionBy(*keys).orderBy("n"))
    return rows.withColumn("after", after).where("after > n + 1").select(*keys, (F.col("n") + 1).alias("first"), (F.col("after") - 1).alias("last"))


def missing_numbers(sections: DataFrame) -> DataFrame:
    """(book, missing): the numbers between a book's least and greatest that it lacks, comma-joined; a run of several is first-last."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
    runs = gaps(sections, ["book"]).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("first", text.alias("text")))).alias("runs"))
    books = sections.select("book").distinct()
    return books.join(runs, "book", "left").select("book", F.coalesce(F.array_join(F.transform("runs", lambda r: r["text"]), ","), F.lit("")).alias("missing"))


def labelled(refs: DataFrame, chapters: DataFrame, key: str = "book", order: str = "ord", whole: bool | None = None) -> DataFrame:
    """chapters with what refs say of the one in their place, and `asserted`, whether the book has as many of both.
    Places are counted in order on each side, so numbers may have gaps."""
    whole = scan.fits(refs, key) and scan.fits(chapters, key) if whole is None else whole
    place = lambda df: scan.over_all(scan.running(df, [key], [order], whole, place=scan.number()).withColumn("place", F.col("place").cast("int")), [key], whole, many=F.count("*"))
    left = place(refs).withColumnRenamed("many", "n_refs").drop(order)
    return place(chapters).withColumnRenamed("many", "n_chapters").join(left, [key, "place"], "left").withColumn("asserted", F.coalesce(F.col("n_refs") == F.col("n_chapters"), F.lit(False))).drop("n_refs", "n_chapters")


def buckets(rows: DataFrame, key: str, order: str, label: str, whole: bool | None = None) -> DataFrame:
    """rows with `bucket`: a new one whenever the label changes from one row to the next; a label may come again."""
    whole = scan.fits(rows, key) if whole is None else whole
    rows = scan.running(rows, [key], [order], whole, _before=scan.previous(F.col(label)))
    changed = F.col("_before").isNull() | ~F.col(label).eqNullSafe(F.col("_before.x"))
    return scan.running(rows.withColumn("_new", changed.cast("long")).drop("_before"), [key], [order], whole, bucket=scan.total(F.col("_new"))).drop("_new")


def runs_joined(rows: DataFrame, key: str, order: str, continues, glue: str = "", whole: bool | None = None) -> DataFrame:
    """(key, para, text): each row that continues its predecessor joined to it, others in a row of their own. continues is a column, or a function of the text before."""
    whole = scan.fits(rows, key) if whole is None else whole
    rows = scan.running(rows, [key], [order], whole, _before=scan.previous(F.col("text")))
    goes = continues(F.col("_before.x")) if callable(continues) else continues
    rows = rows.withColumn("_new", (F.col("_before").isNull() | ~F.coalesce(goes, F.lit(False))).cast("long")).drop("_before")
    rows = scan.running(rows, [key], [order], whole, para=scan.total(F.col("_new")))
    items = rows.groupBy(key, "para").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("items"))
    trimmed = lambda i, n: F.when(n == 0, F.rtrim(i["text"])).otherwise(F.trim(i["text"]))
    text = F.when(F.size("items") == 1, F.get("items", F.lit(0))["text"]).otherwise(F.array_join(F.transform("items", trimmed), glue))
    return items.select(key, "para", text.alias("text"))


def comma_merged(lines: DataFrame, key: str, order: str, whole: bool | None = None) -> DataFrame:
    """Paragraphs whose predecessor ends in a comma joined to it; blank ones are to be left out before."""
    return runs_joined(lines, key, order, lambda before: F.rtrim(before).rlike("[，,]$"), whole=whole)


def until(rows: DataFrame, key: str, order: str, stop: Column, whole: bool | None = None) -> DataFrame:
    """The rows before the first that stops."""
    rows = rows.withColumn("_stop", F.coalesce(stop, F.lit(False)))
    return scan.running(rows, [key], [order], scan.fits(rows, key) if whole is None else whole, _seen=scan.most(F.col("_stop"))).where("NOT _seen").drop("_seen", "_stop")


def titles_repaired(rows: DataFrame, key: str, order: str, title: str, bad: Column, whole: bool | None = None) -> DataFrame:
    """rows with bad titles replaced by the last good one and a mark that it goes on. The first title counts as good."""
    whole = scan.fits(rows, key) if whole is None else whole
    rows = scan.running(rows.withColumn("_bad", F.coalesce(bad, F.lit(False))), [key], [order], whole, _nth=scan.number())
    rows = rows.withColumn("_good", (F.col("_nth") == 1) | ~F.col("_bad"))
    rows = scan.running(rows, [key], [order], whole, _last=scan.last(F.when(F.col("_good"), F.col(title)), before=True))
    return rows.withColumn(title, F.when(F.col("_good"), F.col(title)).otherwise(F.concat("_last", F.lit("（续）")))).drop("_good", "_last", "_bad", "_nth")


def comparison_keys(texts: Column, least: int = 8) -> Column:
    """The distinct keys of paragraphs, those of `least` characters or more."""
    return F.array_distinct(F.filter(F.transform(texts, paragraph_key), lambda t: F.length(t) >= least))


def shared(intro_keys: Column, chapter_keys: Column) -> Column:
    """The share of the intro's keys that the chapter has too; null without any."""
    return F.size(F.array_intersect(intro_keys, chapter_keys)) / F.nullif(F.size(intro_keys), F.lit(0))


def overlap(intro: Column, chapter: Column, least: int = 8) -> Column:
    """The share of the intro's paragraphs, of `least` characters or more as keys, that the chapter has too; null without any."""
    return bound(comparison_keys(intro, least), lambda a: shared(a, comparison_keys(chapter, least)))


def marker_hits(texts: Column, markers: tuple[str, ...]) -> Column:
    """How many times a marker is in a paragraph, over all of both."""
    hit = lambda t: sum((F.contains(t, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return F.aggregate(texts, F.lit(0), lambda acc, t: acc + hit(t))


def without_prefix(intro: Column, chapter: Column) -> Column:
    """The chapter's paragraphs after those that repeat the intro from its beginning; blank ones of the intro don't count."""
    wanted = F.filter(F.transform(intro, paragraph_key), lambda t: t != "")
    equal = F.zip_with(F.transform(chapter, paragraph_key), wanted, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    start = F.when(first > 0, first).otherwise(F.size(equal) + 1).cast("int")
    return F.slice(chapter, start, F.greatest(F.size(chapter) - start + 1, F.lit(0)))


# The title of the chapter that may repeat an intro, and the words by which such a chapter is known.
ZERO_CHAPTER = r"^\s*第\s*[0零〇]\s*章"
INTRO_MARKERS = ("文案", "内容标签", "搜索关键字", "一句话简介", "立意")


def repeats_intro(title: Column, texts: Column, intro: Column) -> Column:
    """Whether a chapter only says the book's intro again: it is called chapter nought, and three times or more has a marker's word, or has three fifths of the intro's paragraphs."""
    return title.rlike(ZERO_CHAPTER) & ((marker_hits(texts, INTRO_MARKERS) >= 3) | F.coalesce(overlap(intro, texts) >= 0.6, F.lit(False)))


def without_repeated_intros(chapters: DataFrame, intros: DataFrame) -> DataFrame:
    """chapters(book, vid, cid, chapter, texts, ...) where a book's first chapter, if it repeats the book's intro, goes on after what it repeats from its beginning; it goes if that is all.

    intros(book, intro), an array of paragraphs a book; books without one keep their chapters. What a chapter repeats is known only when it does in all: by `repeats_intro`.
    """
    order = F.struct("vid", "cid")
    first = chapters.groupBy(F.col("book").alias("of")).agg(F.min(order).alias("first"))
    known = first.join(intros.select(F.col("book").alias("whose"), "intro"), F.col("of") == F.col("whose")).select("of", "first", "intro")
    rows = chapters.join(known, F.col("book").eqNullSafe(F.col("of")) & (order == F.col("first")), "left")
    again = F.col("intro").isNotNull() & repeats_intro(F.col("chapter"), F.col("texts"), F.col("intro"))
    rows = rows.withColumn("texts", F.when(F.coalesce(again, F.lit(False)), without_prefix(F.col("intro"), F.col("texts"))).otherwise(F.col("texts")))
    return rows.where(F.size("texts") > 0).select(*chapters.columns)


def without_heading(texts: Column, title: Column) -> Column:
    """A page's paragraphs without a first one that only repeats the chapter's title."""
    same = F.coalesce(paragraph_key(F.get(texts, F.lit(0))) == paragraph_key(title), F.lit(False))
    return F.when(same, F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts)


def chosen_title(page_title: Column, toc_title: Column) -> Column:
    """The page's own title, or what the contents list calls it."""
    return F.coalesce(F.nullif(F.trim(page_title), F.lit("")), toc_title)


def adaptive_sections(lines: DataFrame, sentinel: str, reach: int = 20, phrases: tuple[str, ...] = (), whole: bool | None = None) -> DataFrame:
    """(book, part, section, text): sections of lines(book, line_no, text) by numbers that rise.

    A line that is only a number of up to four digits is a marker if it is greater than the current number by at most `reach`;
    else it is text. The sentinel line opens the second part, where numbers begin anew, and a line with one of the phrases
    opens the next section, which it belongs to. Whether a number counts depends on the last one that did, so a book is
    one fold over its lines; of a longer book each part is a fold that begins with the state that the parts before it lead to (scan.entering).
    """
    whole = scan.fits(lines, "book") if whole is None else whole

    def candidate(text: Column) -> Column:
        return F.when(text.rlike("^[0-9]{1,4}$"), text.try_cast("int"))

    def marks(now: Column, text: Column) -> Column:
        n = candidate(text)
        return F.when((n > now) & (n - now <= reach), n)

    def phrased(text: Column) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(text, F.lit(phrase))
        return found

    def splits(state: Column, text: Column) -> Column:
        return ((state["part"] == 1) & phrased(text)).cast("int")

    def step(state: Column, i: Column) -> Column:
        opens = i["text"] == sentinel
        now = F.when(opens, 0).when(splits(state, i["text"]) == 1, state["now"] + 1).otherwise(F.coalesce(marks(state["now"], i["text"]), state["now"]))
        return F.struct(F.when(opens, 1).otherwise(state["part"]).cast("int").alias("part"), now.cast("int").alias("now"))

    def line(state: Column, i: Column) -> Column:
        kept = (i["text"] != sentinel) & marks(state["now"], i["text"]).isNull()
        return F.when(kept, F.struct(state["part"].alias("part"), (state["now"] + splits(state, i["text"])).alias("section"), i["line_no"].cast("int").alias("line_no"), i["text"].alias("text")))

    start = lambda part, now: F.struct(part.cast("int").alias("part"), now.cast("int").alias("now"))
    items = F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("items")
    if whole:
        books = lines.groupBy("book").agg(items).withColumn("start", start(F.lit(0), F.lit(0)))
    else:
        lines = landed(lines.select("book", "line_no", "text", scan.part_of("line_no").alias("of")), "lines")
        events = lines.select("book", F.col("of").alias("part"), F.col("line_no").alias("place"), candidate(F.col("text")).alias("number"), (F.col("text") == sentinel).alias("opens"), phrased(F.col("text")).alias("splits"))
        after = scan.entering(events.where("number IS NOT NULL OR opens OR splits"), reach)
        # A part begins with the state after the last one before it that changes any.
        states = lines.select("book", F.col("of").alias("at")).distinct().join(after, (F.col("book") == F.col("of")) & (F.col("at") == F.col("of_part")), "left")
        before = Window.partitionBy("book").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        states = states.select(F.col("book").alias("whose"), "at", F.last("stage", True).over(before).alias("stage"), F.last("now", True).over(before).alias("now"))
        books = lines.groupBy("book", "of").agg(items).join(states, (F.col("book") == F.col("whose")) & (F.col("of") == F.col("at")))
        books = books.withColumn("start", start(F.coalesce("stage", F.lit(0)), F.coalesce("now", F.lit(0))))
    found = scanned(F.col("items"), F.col("start"), step, line, "struct<part:int,section:int,line_no:int,text:string>")
    found = books.select("book", F.explode(F.array_compact(found)).alias("r")).select("book", "r.part", "r.section", "r.line_no", "r.text")
    out = found.groupBy("book", "part", "section").agg(F.collect_list(F.struct("line_no", "text")).alias("items"))
    return out.select("book", "part", "section", _joined("items").alias("text"))
