"""Near-duplicate texts by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, mixed, numbered, stored, unused
from .words import passes, sequence_keys, shingles, word_hashes

#: 20 bands of 4 registers: a pair of similarity 0.8 shares no band once in 37,000 times.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
_KEYS = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
#: Longs of the bitmaps that say how a document differs from a reference.
WORDS = 8


def weighted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with the times it occurs; of a shingle's hash 48 bits are kept. At most 65,536 texts."""
    packed = np.sort(text.astype(np.uint64) << np.uint64(48) | key >> np.uint64(16))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), times


def prob_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures, texts x registers: the element that arrives first in each register.

    An element is a Poisson process whose rate is its weight: arrivals are sums of exponential
    draws divided by the weight, each falls into a random register, and draws depend only on the
    element and the arrival's number. The chance that two texts have the same element first in
    a register is their probability Jaccard. A process ends as soon as its next arrival is later
    than the last arrival of any of the text's registers, since it can win none any more.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    time = np.zeros(len(text))
    number = 0
    while len(text):
        number += 1
        draw = mixed(element * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([number], dtype=np.uint64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        slot = text * registers + (mixed(draw + np.uint64(0x632BE59BD9B4E019)) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[slot])
        np.minimum.at(first, slot[early], time[early])
        won = early[time[early] == first[slot[early]]]
        winner[slot[won]] = element[won]
        alive = time < first.reshape(texts, registers).max(axis=1)[text]
        text, element, weight, time = text[alive], element[alive], weight[alive], time[alive]
    return winner.reshape(texts, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of shingles."""
    shared = len(np.intersect1d(a, b, True))
    return shared / max(1, len(a) + len(b) - shared)


def _banded(signature: np.ndarray) -> np.ndarray:
    """The keys of a signature's bands, texts x BANDS."""
    banded = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        banded = mixed(banded * np.uint64(0xFF51AFD7ED558CCD) + signature[:, r::ROWS])
    return mixed(banded + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, column in passes(batch.column("text")):
            for a in range(0, len(column), 1 << 16):
                part = column.slice(a, 1 << 16)
                hashes, counts = word_hashes(part)
                first = np.cumsum(counts) - counts
                keys = [sequence_keys(hashes, first, counts, k).view(np.int64) for k in _KEYS]
                text, element, times = weighted(*shingles(hashes, counts))
                # The logarithm keeps a line that is repeated many times from drowning the rest.
                signature = prob_min_hash(text, element, 1 + np.log(times), len(part))
                # Links don't count how often a shingle occurs, so a text that repeats one has bands of unit weights too.
                twice = np.zeros(len(part), dtype=bool)
                twice[text[times > 1]] = True
                own = twice[text]
                plain = prob_min_hash((np.cumsum(twice) - 1)[text[own]], element[own], np.ones(own.sum()), int(twice.sum()))
                banded = np.zeros((len(part), 2 * BANDS), dtype=np.uint64)
                banded[:, :BANDS] = _banded(signature)
                banded[twice, BANDS:] = _banded(plain)
                # A text without words has no bands.
                spots = np.where(counts > 0, np.where(twice, 2 * BANDS, BANDS), 0)
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(spots)]).astype(np.int32), pa.array(banded[np.arange(2 * BANDS) < spots[:, None]].view(np.int64)))
                kept = batch.slice(begin + a, len(part)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(counts, pa.int64()), *map(pa.array, keys), bands],
                    names=[*kept.schema.names, "n_words", "key1", "key2", "bands"],
                )


def signed(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(rid, doc_id, text_key, n_words, key1, key2, bands) of every row: keys of its sequence of words, and the bands of its ProbMinHash.
    rid is docs' own row id if one is named."""
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    return rows.select("rid", "doc_id", "text_key", "text").mapInArrow(_sign, "rid long, doc_id long, text_key long, n_words long, key1 long, key2 long, bands array<long>")


def _bits(elements: np.ndarray) -> list[int]:
    """A bitmap of WORDS longs in which each element sets a bit."""
    out = np.zeros(64 * WORDS, dtype=np.uint8)
    out[(mixed(elements) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64).tolist()


def _compared(x: np.ndarray, y: np.ndarray) -> dict:
    """The similarity of x and y, and how x differs from y: a bitmap of what it adds and of what it lacks."""
    more, less = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
    added = _bits(more)
    return {
        "similarity": similarity(x, y),
        "size": len(x),
        "base": len(y),
        "added": added,
        "extra": len(more) - sum((v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in added),
        "lacking": _bits(less),
    }


_VERDICT = "a long, b long, similarity double, size int, base int, added array<long>, extra int, lacking array<long>"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _VERDICT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
    for batch in batches:
        done: list[dict] = []
        for begin, column in passes(batch.column("text_a"), 1 << 21):
            for a in range(0, len(column), 1 << 14):
                left, right = (batch.column(c).slice(begin + a, min(1 << 14, len(column) - a)) for c in ("text_a", "text_b"))
                pair = []
                for part in (left, right):
                    text, element, _ = weighted(*shingles(*word_hashes(part)))
                    ends = np.searchsorted(text, np.arange(len(part) + 1))
                    pair.append([element[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                done += [_compared(x, y) for x, y in zip(*pair, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([d[n] for d in done], t) for n, t in zip(names[2:], types[2:], strict=True))], names=names)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the similarity of their whole texts, and how a differs from b."""
    left, right = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify, _VERDICT)


def _possible(least: float):
    """Whether documents a and b, both compared with the same reference, can be as similar as asked for.

    Shingles they share are shared with the reference or not. Of the former there are at most the
    reference's less those that a or b lacks, and the bitmaps' union counts some of these; of the latter
    at most the common bits, and what bits hide where several shingles set one. Sets of sizes m and n
    are that similar if they share least / (1 + least) * (m + n).
    """
    need = F.lit(least / (1 + least) - 1e-9) * (F.col("sizea") + F.col("sizeb"))
    lacking, added = F.lit(0), F.lit(0)
    for k in range(WORDS):
        lacking = lacking + F.bit_count(F.col(f"lacking{k}a").bitwiseOR(F.col(f"lacking{k}b")))
        added = added + F.bit_count(F.col(f"added{k}a").bitwiseAND(F.col(f"added{k}b")))
    return (F.least("sizea", "sizeb") >= need) & (F.col("basea") - lacking + added + F.least("extraa", "extrab") >= need)


def classes(docs: DataFrame, least: float = 0.8, row: str | None = None) -> DataFrame:
    """(rid, doc_id, text_key, class_id, kept) for every row of docs(doc_id, text).

    Two documents are linked if the similarity of their shingles of five words is `least` or
    more; a class is what links reach, class_id its smallest doc_id, and one row of it is kept.
    Candidates share a band of the weighted signatures or of those of unit weights, which estimate the similarity that links.
    Texts with the same sequence of words become one first. In each bucket of a band every
    member is verified against a pivot, the member that shares most buckets. Where members then lie in
    different classes, all are compared with one reference, and pairs across classes are verified too,
    but for those that their differences from it rule out: no candidate is
    left out, and pairs inside a class, which can add nothing, are not made.

    A null or empty text, and one without words, is a class of its own; one with fewer than five words
    is one shingle. Rows that repeat an id are documents of their own; a null id is a class's id only if
    all its ids are null. An empty table gives no rows. Other columns are not read.
    """
    rows = stored(signed(docs, row), "signatures")
    worded = rows.where("n_words > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "text_key"))
    reps = worded.groupBy("key1", "key2").agg(first.alias("f"), F.min_by("bands", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("bands"))
    reps = stored(reps.select("key1", "key2", F.col("f.rid").alias("rid"), F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key"), "bands"), "texts")
    banded = reps.select("rid", F.explode(F.array_distinct("bands")).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(sizes, "bucket"), "buckets")
    # The member that shares most buckets with others is the likeliest original of the copies in a bucket.
    central = members.groupBy("rid").agg(F.sum("n").alias("near"))
    pivots = members.join(central, "rid").groupBy("bucket").agg(F.max_by("rid", F.struct("near", "rid")).alias("pivot"))
    wanted = reps.join(central.select("rid"), "rid", "left_semi").select("rid", F.col("doc_id").alias("of"), F.col("text_key").alias("key"))
    source = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    texts = source.join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("rid", "text")
    texts = stored(texts, "candidates")
    if not rows.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["rid"])  # rows that repeat an id and its text
    star = members.join(pivots, "bucket").where("rid <> pivot").select(F.col("rid").alias("a"), F.col("pivot").alias("b")).distinct()
    compared = stored(_verified(star, texts), "compared")
    # Each bucket gets a reference: the most central document that any of its members was compared with.
    near = F.struct("near", "rid")
    hubs = compared.select("a", F.col("b").alias("rid")).join(central, "rid").groupBy("a").agg(F.max(near).alias("hub"))
    known = central.join(hubs, central["rid"] == hubs["a"], "left").select("rid", F.greatest(near, F.coalesce("hub", near)).alias("hub"))
    referred = members.join(known, "rid").groupBy("bucket").agg(F.max("hub").alias("hub")).select("bucket", F.col("hub.rid").alias("ref"))
    referred = stored(members.select("bucket", "rid").join(referred, "bucket"), "referred")
    rest = referred.where("rid <> ref").select(F.col("rid").alias("a"), F.col("ref").alias("b")).distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
    compared = compared.unionByName(stored(_verified(rest, texts), "compared"))
    links = compared.where(F.col("similarity") >= least).select("a", "b")
    tree = cut(connected(links))
    placed = referred.join(tree.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "ref", "rid", F.coalesce("component", "rid").alias("component"))
    placed = stored(placed, "placed")
    # Of the classes in a bucket the one with most members is its main one.
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = shares.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("bucket", "main")
    # What was compared with the reference needs no other comparison with it.
    differences = compared.select(F.col("a").alias("rid"), F.col("b").alias("ref"), "size", "base", "extra", *(F.get(c, F.lit(k)).alias(f"{c}{k}") for c in ("added", "lacking") for k in range(WORDS)))
    open_ = stored(placed.where("rid <> ref").join(several, "bucket").join(differences, ["rid", "ref"]), "open")
    left, right = (open_.select(F.col("bucket").alias(f"bucket{c}"), F.col("rid").alias(c), *(F.col(x).alias(x + c) for x in open_.columns if x not in ("rid", "bucket", "ref"))) for c in "ab")
    # The main class's members are only held against the others, so a bucket costs its size times what lies outside its main class.
    once = (F.col("componentb") == F.col("mainb")) | (F.col("a") < F.col("b"))
    across = left.where("componenta <> maina").join(right, (F.col("bucketa") == F.col("bucketb")) & (F.col("componenta") != F.col("componentb")) & once & _possible(least))
    across = stored(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    more = stored(_verified(across, texts), "compared").where(F.col("similarity") >= least).select("a", "b")
    tree = connected(links.union(more)).withColumnRenamed("node", "rep")
    named = reps.select("key1", "key2", F.col("rid").alias("rep")).join(tree, "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    member = stored(worded.join(named, ["key1", "key2"]).select("rid", "doc_id", "text_key", "component"), "members")
    heads = member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("head"))
    out = member.join(heads, "component").select("rid", "doc_id", "text_key", F.col("head.doc_id").alias("class_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))
    return out.unionByName(rows.where("n_words = 0").select("rid", "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def apply_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with one row of each class, in docs' columns.

    Rows are numbered once, and verdicts go back by that number, so rows that repeat an id or have none are told apart.
    """
    row = unused(docs, "row_number")
    rows = numbered(docs, row)
    kept = classes(rows.select(row, "doc_id", "text"), least, row).where("kept").select(F.col("rid").alias(row))
    return rows.join(kept, row).select(*docs.columns)
