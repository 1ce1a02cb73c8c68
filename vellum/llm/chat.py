"""Chat formatting from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import scanned
from ..functions.text import bound
from .common import lined_up, stored

#: Turns that are rendered at once, at most. Longer dialogues are put together from such pieces.
PIECE = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _guarded(text: Column) -> Column:
    """A text in which no marker stands: it is broken up, so it can't begin or end a turn."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _named(role: Column) -> Column:
    """A role as a name of one line: no markers, no line ends or other control characters. Null is the name unknown, a role spelled so is "unknown" in quotes."""
    name = F.regexp_replace(_guarded(role), "[\\x00-\\x1F\\x7F\\x{85}\\x{2028}\\x{2029}]+", " ")
    return F.when(role.isNull(), "unknown").when(name == "unknown", '"unknown"').otherwise(name)


def _segment(kind: Column, text: Column) -> tuple[Column, Column]:
    """One turn as the speaker sees it: its text before the trained span, and that span."""
    return F.concat(F.lit(OPEN), kind, F.lit("\n")), F.concat(text, F.lit(CLOSE))


def _pieces(rows: DataFrame, piece: int, whole: bool) -> DataFrame:
    """(conv_id, part, turns): the turns in order, a dialogue a row, or where that isn't said to fit `piece` of them a row, dealt by their places however long a dialogue is."""
    order = ["turn", "name", "digest"]
    rows = rows.withColumn("digest", F.sha2("text", 256))
    if whole:
        turns = F.array_sort(F.collect_list(F.struct(*order, "system", "text")))
        return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.lit(0).cast("long").alias("part"), "turns")
    rows = lined_up(rows, "conv_id", *order)
    first = rows.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("place", F.col("at") - F.col("first"))
    parts = rows.groupBy("conv_id", F.floor(F.col("place") / piece).cast("long").alias("part"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("place", "name", "system", "text"))).alias("turns"))


def _rendered(pieces: DataFrame, speakers: DataFrame) -> DataFrame:
    """(conv_id, speaker, part, text, spans, n_turns, n_trained): every piece as each speaker of its dialogue sees it; spans are within the piece."""
    seen = pieces.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    own = lambda t: ~t["system"] & (t["name"] == F.col("speaker"))
    kind = lambda t: F.when(t["system"], "system").when(own(t), "assistant").otherwise(F.concat(F.lit("user name="), t["name"]))
    said = F.transform("turns", lambda t: F.struct(*(x.alias(n) for n, x in zip(("head", "body"), _segment(kind(t), t["text"]), strict=True)), own(t).alias("own")))

    def trained(at, s):
        begin = at + F.length(s["head"])
        return F.when(s["own"], F.struct(begin.cast("long").alias("a"), (begin + F.length(s["body"])).cast("long").alias("b")))

    step = lambda at, s: (at + F.length(s["head"]) + F.length(s["body"]) + 1).cast("long")
    spans = F.array_compact(scanned(F.col("said"), F.lit(0).cast("long"), step, trained, "struct<a:bigint,b:bigint>"))
    return seen.withColumn("said", bound(said, lambda s: s)).select(
        "conv_id",
        "speaker",
        "part",
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        bound(spans, lambda s: s).alias("spans"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def _listed(spans: Column, shift: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat((s["a"] + shift).cast("string"), F.lit(":"), (s["b"] + shift).cast("string"))), ",")


def _covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def perspectives(turns: DataFrame, part: int | None = None, piece: int = PIECE) -> DataFrame:
    """(conv_id, speaker, text, mask, n_turns, n_trained): turns(conv_id, turn, role, text)
    rendered once for every participant.

    The participant's turns are the assistant's; the other speakers are users under their names;
    system turns stay system turns in every rendering. mask lists the spans to train on as
    start:end in code points of the row's text, end exclusive, comma-joined: what the speaker says,
    with the marker that ends it.

    Turns are in the order of turn, then name, then the text's SHA-256; a null turn comes first; a null role is
    the speaker "unknown", and a speaker of that name is another, in quotes; a null text is empty. Repeated rows are repeated
    turns. A marker that stands in a text or a role is broken up, and a role is one line, so neither can begin or end a turn. A dialogue
    of system turns only has no participant and no rows; an empty table gives none. Other columns are not read.

    A row holds a whole dialogue. One of more than `piece` turns is rendered in pieces, in as many tasks, which are then put together. With `part` there is a row for
    each so many turns instead, numbered in a column part from 0, with masks of its own text: for dialogues whose text is more than a value can hold (2 GB). Their texts, one after the other, are the whole one.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        _named(F.col("role")).alias("name"),
        F.coalesce(F.col("role") == "system", F.lit(False)).alias("system"),
        _guarded(F.coalesce("text", F.lit(""))).alias("text"),
    )
    longest = turns.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    whole = longest <= (part or piece)
    speakers = rows.where("NOT system").select(F.col("conv_id").alias("of"), F.col("name").alias("speaker")).distinct()
    seen = _rendered(_pieces(rows, part or piece, whole), speakers)
    zero = F.lit(0).cast("long")
    if whole or part:
        columns = ["conv_id", "speaker", *(["part"] if part else []), "text", _listed(F.col("spans"), zero).alias("mask"), "n_turns", _covered(F.col("spans")).alias("n_trained")]
        return seen.select(*columns)
    seen = stored(seen, "pieces")
    places = seen.select(F.col("conv_id").alias("whose"), F.col("speaker").alias("seer"), F.col("part").alias("nth"), F.length("text").cast("long").alias("n"))
    before = Window.partitionBy("whose", "seer").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("shift", F.coalesce(F.sum("n").over(before), zero))
    same = F.col("conv_id").eqNullSafe(F.col("whose")) & (F.col("speaker") == F.col("seer")) & (F.col("part") == F.col("nth"))
    shifted = seen.join(places, same).select("conv_id", "speaker", F.struct("part", "text", _listed(F.col("spans"), F.col("shift")).alias("mask")).alias("p"), "n_turns", _covered(F.col("spans")).alias("n"))
    joined = shifted.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("n_turns").alias("n_turns"), F.sum("n").alias("n_trained"))
    masks = F.filter(F.transform("ps", lambda p: p["mask"]), lambda m: m != "")
    return joined.select("conv_id", "speaker", F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("text"), F.array_join(masks, ",").alias("mask"), "n_turns", "n_trained")
