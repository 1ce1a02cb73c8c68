"""Quality rules: base counts per document, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, numbered, stored, unused
from .words import _CODE, _GAP, passes, sequence_keys, text_bytes, word_hashes

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = f"rid long, doc_id long, host string, {', '.join(f'{c} long' for c in _COUNTS)}, line_keys array<long>, line_words array<long>"
_LINE = np.uint64(0xC2B2AE3D27D4EB4F)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
#: Every byte as normalised lines have it: white space as a space, digits as 0.
_EVEN = np.where(_GAP, 0x20, np.where(_DIGIT, 0x30, np.arange(256))).astype(np.uint8)


def lines_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of every line of texts that lie one after the other, in order; a text has one line more than line feeds."""
    feeds = np.flatnonzero(raw == 0x0A)
    text = np.concatenate([np.arange(len(ends) - 1), np.searchsorted(ends, feeds, side="right") - 1])
    start = np.concatenate([ends[:-1], feeds + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    stop = np.append(start[1:] - 1, 0)
    last = np.append(text[1:] != text[:-1], True)
    stop[last] = ends[text[last] + 1]
    return text, start, stop


def normal_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, words, worded) of every line: a hash of the line normalised (lower case, runs of white space as one
    space, runs of digits as one 0, trimmed), how many words it has, and whether it has any."""
    raw, ends = text_bytes(pc.utf8_lower(column))
    text, start, stop = lines_of(raw, ends)
    gap, digit = _GAP[raw], _DIGIT[raw]
    kept = np.ones(len(raw), dtype=bool)
    kept[1:] = ~(gap[1:] & gap[:-1] | digit[1:] & digit[:-1])
    begins = ends[:-1][ends[:-1] < len(raw)]
    kept[begins] = True  # a text's first byte doesn't go on from the text before
    solid = np.flatnonzero(~gap)
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, stop)
    worded = last > first
    solid = np.append(solid, 0)
    place = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(kept)])
    begin, end = place[solid[np.where(worded, first, -1)]], place[solid[np.where(worded, last - 1, -1)] + worded]
    key = sequence_keys(_CODE[_EVEN[raw[kept]]], begin, np.where(worded, end - begin, 0), _LINE)
    opens = ~gap
    opens[1:] &= gap[:-1]
    opens[begins] = ~gap[begins]
    opens = np.flatnonzero(opens)
    return text, key, np.searchsorted(opens, stop) - np.searchsorted(opens, start), worded


def _repeats(text: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """For each text, how many of its keys are equal to another before."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    again = np.zeros(len(t), dtype=bool)
    again[1:] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    return np.bincount(t[again], minlength=texts)


def _within(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in the mask."""
    return np.diff(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(mask)])[ends])


def repeated_words(code: np.ndarray, counts: np.ndarray, width: int = 8) -> np.ndarray:
    """For each document, how many of its words lie in a window of `width` words found twice in it.
    code has a hash for every word of all documents, counts how many words each has."""
    out = np.zeros(len(counts), dtype=np.int64)
    total = len(code)
    if total < width:
        return out
    n = total - width + 1
    hashed = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        hashed = hashed * np.uint64(0xD1342543DE82EF95) + code[j : j + n]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    key = mixed(hashed[at] + mixed(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(total + 1, dtype=np.int32)
    change[at[twice]] += 1
    np.subtract.at(change, at[twice] + width, 1)
    covered = np.cumsum(change[:-1]) > 0
    return out + np.bincount(doc[covered], minlength=len(counts))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.drop_columns(["text"])
        for begin, texts in passes(batch.column("text"), 1 << 20):
            raw, ends = text_bytes(texts)
            hashes, words = word_hashes(texts)
            line_text, key, line_words, worded = normal_lines(texts)
            same_text, start, stop = lines_of(raw, ends)
            whole = sequence_keys(_CODE[raw], start, stop - start, _LINE)
            counts = (
                words,
                _within(~_GAP[raw] & (raw & 0xC0 != 0x80), ends),
                _within(_SYMBOL[raw], ends),
                _repeats(same_text[worded], whole[worded], len(texts)),
                repeated_words(hashes, words),
            )
            at = np.searchsorted(line_text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.array(key.view(np.int64), mask=~worded)), pa.ListArray.from_arrays(at, pa.array(line_words))
            part = kept.slice(begin, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in counts), *lists], names=[*part.schema.names, *_COUNTS, "line_keys", "line_words"])


def measure(docs: DataFrame, host: str = "source", row: str | None = None) -> DataFrame:
    """One row per document: base counts, and for each of its lines the key (null without a word) and the words. rid is docs' own row id if one is named."""
    rid = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(_measure, _SCHEMA)


def _by_host(measured: DataFrame, *columns) -> DataFrame:
    """Columns of measured beside the host, which is null where no_host is set."""
    return measured.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), *columns)


def frequent_lines(measured: DataFrame, share: float = 0.1, least: int = 10) -> DataFrame:
    """(host, no_host, key) of the lines found in more than max(least, share of the host's documents).

    Distinct documents are counted: those whose normalised lines are the same set are one document.
    """
    of = F.xxhash64(F.array_sort(F.array_distinct(F.array_compact("line_keys")))).alias("document")
    documents = measured.withColumn("own", F.array_distinct(F.array_compact("line_keys"))).where(F.size("own") > 0)
    sizes = _by_host(documents, of).distinct().groupBy("host", "no_host").agg(F.count("*").alias("documents"))
    lines = _by_host(documents, of, F.explode("own").alias("key")).distinct()
    counts = lines.groupBy("host", "no_host", "key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return counts.join(sizes, ["host", "no_host"]).where(F.col("n") > F.col("documents") * share).select("host", "no_host", "key")


def judge(docs: DataFrame, host: str = "source", share: float = 0.1, least: int = 10, min_words: int = 20, words_left: int = 10, share_left: float = 0.2, row: str | None = None) -> DataFrame:
    """Base counts and verdict for every row of docs, and which of its lines to remove, by number from 0; with docs' own row id if one is named.

    A document is depleted when the words outside removed lines are fewer than words_left, or
    than share_left of its words. Null texts have no words and fail the base rules; a null host is a
    host of its own; repeated rows are judged each, and count as one document; an empty table
    gives no rows; other columns are not read. Lines are compared whole, however long.
    """
    measured = stored(measure(docs, host, row), "quality")
    frequent = frequent_lines(measured, share, least)
    lines = _by_host(measured, "rid", F.posexplode(F.arrays_zip("line_keys", "line_words")).alias("line", "x"))
    lines = lines.select("host", "no_host", "rid", "line", F.col("x.line_keys").alias("key"), F.col("x.line_words").alias("words")).where("key IS NOT NULL")
    removed = lines.join(frequent, ["host", "no_host", "key"]).groupBy("rid").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rest = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    fine = ~base & (rest >= words_left) & (rest >= share_left * F.col("n_words"))
    out = measured.select("rid", "doc_id", *_COUNTS).join(removed, "rid", "left")
    return out.select(*([F.col("rid").alias(row)] if row else []), "doc_id", *_COUNTS, base.alias("base_failed"), fine.alias("kept"), "removed_lines")


def apply_rules(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected documents, and without the removed lines in the others.

    Every row has its own verdict, whatever its id: rows are numbered once, and verdicts go back by that number. Other rules are judge's.
    """
    row, gone = unused(docs, "row_number"), unused(docs, "removed_lines")
    rows = numbered(docs, row)
    verdict = judge(rows, row=row, **options).where("kept").select(row, F.col("removed_lines").alias(gone))
    kept = rows.join(verdict, row)
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.size(gone) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text"))
    out = kept.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)
