"""Removal of repeated byte strings by bucket-pointer refinement over all documents' suffixes.

As in sorting suffixes by bucket pointers, suffixes begin in the buckets of their first Q bytes, and a
bucket of depth d is refined by the bucket identifiers that its suffixes' later offsets have
already: 20 bytes give 35, 35 give 50. An identifier is a hash of what it was made from, so
that tasks agree on it without one having seen the other's suffixes, and each refinement
reuses the identifiers of the one before. Three things keep the work small:

* Only sampled suffixes start a bucket: in every string of DEPTH bytes the q-gram of least hash. What
  two documents share, they sample at the same places. A bucket of one document is settled.
* A sampled suffix is refined with its surroundings at once, 30 bytes before and 50 after. Where
  they all occur in an earlier document, so do the up to 31 strings of 50 bytes in them.
* Single strings are only compared at the edges of a match: where an earlier document can still
  share less than the surroundings but more than their left or right part.

Documents are packed into blocks, the unit of a task. A block sends identifiers once each, whatever
the number of suffixes that have them, to ranges of identifiers, and gets back what it needs to
know about each: whether other blocks have it, from how many suffixes, and whether from a
smaller document. So one string in a third of all documents is one entry a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixed, stored
from .words import _CODE, _size, inverse, powers, text_bytes

#: Bytes of the initial buckets, of a refinement's step, and of the strings that count.
Q, STEP, DEPTH = 20, 15, 50
SPREAD = DEPTH - Q  # a string of DEPTH bytes that has a sampled q-gram begins at most so far before it
#: Bytes of a block's documents, about, and their number, at most.
BLOCK, BLOCK_DOCS = 2 << 20, 1 << 15
#: Bytes of all documents for each range of identifiers, about.
RANGE = 8 << 20
#: Bytes of all documents for each partition of blocks, at most.
PARTITION = 128 << 20

_BASES = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_NO_ID = -(1 << 63)
#: Bytes of one step of the passes over a block, so that what it needs fits a core's cache.
_CHUNK = 1 << 15


def _pressed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _spread(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, index, total = TaskContext.get().partitionId(), 0, 0
    ids: list[int] = []
    sizes: list[int] = []
    held: list[bytes] = []

    def packed() -> pa.RecordBatch:
        nonlocal index, total
        raw = b"".join(held)
        row = [[part << 32 | index], [len(raw)], [np.array(ids, np.int64).tobytes()], [np.array(sizes, np.int64).tobytes()], [zstandard.ZstdCompressor(level=3).compress(raw)]]
        index, total = index + 1, 0
        for x in (ids, sizes, held):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "size", "ids", "sizes", "data"])

    for batch in batches:
        raw, ends = text_bytes(batch.column("text"))
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if held and (total + b - a > BLOCK or len(held) == BLOCK_DOCS):
                yield packed()
            total += b - a
            ids.append(_NO_ID if doc is None else doc)
            sizes.append(b - a)
            held.append(raw[a:b].tobytes())
    if held:
        yield packed()


def _least(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours."""
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[:n], x[width - span : width - span + n]) if span < width else x


class Keys:
    """The distinct keys of a block's suffixes in one round, in the order of cells, and the suffixes' place among them."""

    def __init__(self, main: np.ndarray, more: np.ndarray | None, docs: np.ndarray, ranges: int):
        order = np.argsort(main, kind="stable") if more is None else np.lexsort((more, main))
        m = main[order]
        new = np.ones(len(m), dtype=bool)
        new[1:] = m[1:] != m[:-1]
        if more is not None:
            s = more[order]
            new[1:] |= s[1:] != s[:-1]
        first = np.flatnonzero(new)
        self.main, self.more = m[first], None if more is None else more[order][first]
        self.counts = np.diff(np.append(first, len(m)))
        d = docs[order]
        self.least = np.minimum.reduceat(d, first) if len(first) else d
        self.most = np.maximum.reduceat(d, first) if len(first) else d
        self.at = np.empty(len(m), dtype=np.int64)
        self.at[order] = np.cumsum(new) - 1
        # A key's range comes from its leading half, so sorted keys lie range by range.
        place = ((self.main >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        self.ends = np.searchsorted(place, np.arange(ranges + 1))

    def cells(self) -> Iterator[tuple[int, slice]]:
        for r in np.flatnonzero(np.diff(self.ends)).tolist():
            yield r, slice(int(self.ends[r]), int(self.ends[r + 1]))

    def sent(self, block: int, kind: str) -> list[tuple]:
        """A row for each range that gets keys. Kinds a and b send 40 bits of a key, c and w 96 bits and the smallest document."""
        out = []
        for r, s in self.cells():
            if kind in "ab":
                head = (self.main[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (self.main[s] >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8).tobytes()
            else:
                head = self.main[s].tobytes() + self.more[s].tobytes()
            tail = {"a": (), "b": (self.counts[s],), "c": (self.least[s], self.counts[s]), "w": (self.least[s],)}[kind]
            out.append((r, block, kind, s.stop - s.start, head, _pressed(*tail) if tail else b""))
        return out

    def told(self, replies: list[dict], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """For each key what the ranges say: a bit and a number."""
        bits, numbers = np.zeros(len(self.main), dtype=bool), np.zeros(len(self.main), dtype=np.int64)
        for x in replies:
            if x["kind"] == kind:
                s = slice(int(self.ends[x["range"]]), int(self.ends[x["range"] + 1]))
                if s.stop - s.start != x["n"]:
                    raise RuntimeError("a reply doesn't fit the keys that were sent")
                if x["bits"]:
                    bits[s] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]).astype(bool)
                if x["numbers"]:
                    numbers[s] = np.frombuffer(_spread(x["numbers"]), np.int64)
        return bits, numbers


def answered(rows: list[dict]) -> list[tuple]:
    """What a range replies to the cells of one kind that all blocks sent it."""
    kind = rows[0]["kind"]
    sizes = np.array([x["n"] for x in rows])
    more = docs = counts = None
    if kind in "ab":
        low = np.concatenate([np.frombuffer(x["head"], np.uint32, x["n"]) for x in rows]).astype(np.uint64)
        high = np.concatenate([np.frombuffer(x["head"], np.uint8, x["n"], 4 * x["n"]) for x in rows]).astype(np.uint64)
        main = high << np.uint64(32) | low
    else:
        main = np.concatenate([np.frombuffer(x["head"], np.uint64, x["n"]) for x in rows])
        more = np.concatenate([np.frombuffer(x["head"], np.uint32, x["n"], 8 * x["n"]) for x in rows])
    tails = [_spread(x["tail"]) if x["tail"] else b"" for x in rows]
    if kind in "cw":
        docs = np.concatenate([np.frombuffer(t, np.int64, x["n"]) for x, t in zip(rows, tails, strict=True)])
    if kind in "bc":
        counts = np.concatenate([np.frombuffer(t, np.int64, x["n"], 8 * x["n"] * (kind == "c")) for x, t in zip(rows, tails, strict=True)])
    order = np.argsort(main, kind="stable") if more is None else np.lexsort((more, main))
    new = np.ones(len(main), dtype=bool)
    new[1:] = main[order][1:] != main[order][:-1]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    bits = numbers = None
    if kind == "a":
        bits = np.empty(len(main), dtype=bool)
        bits[order] = np.diff(np.append(first, len(main)))[group] > 1
    if docs is not None:
        bits = np.empty(len(main), dtype=bool)
        bits[order] = docs[order] > np.minimum.reduceat(docs[order], first)[group]
    if counts is not None:
        numbers = np.empty(len(main), dtype=np.int64)
        numbers[order] = np.add.reduceat(counts[order], first)[group]
    ends = np.cumsum(sizes)
    out = []
    for x, a, b in zip(rows, (ends - sizes).tolist(), ends.tolist(), strict=True):
        out.append((x["block"], x["range"], kind, x["n"], b"" if bits is None else np.packbits(bits[a:b]).tobytes(), b"" if numbers is None else _pressed(numbers[a:b])))
    return out


class Block:
    """The suffixes of one block of documents, refined as far as the replies allow."""

    def __init__(self, row: dict, ranges: int):
        self.ranges, self.number = ranges, row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(_spread(row["data"]), np.uint8) if row["size"] else np.zeros(0, np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.bucket = self._grams(0, Q)
        self.sampled = self._sampled()

    def _sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        base, n = _BASES[which], _size(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_CODE[self.data] * powers(int(base), n)[: len(self.data)], dtype=np.uint64, out=sums[1:])
        return sums, powers(inverse(base), n)

    def _grams(self, which: int, length: int) -> np.ndarray:
        """The initial bucket of every suffix: an identifier of its first `length` bytes."""
        n = len(self.data) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        sums, undo = self._sums(which)
        out = np.empty(n, dtype=np.uint64)
        for a in range(0, n, _CHUNK):
            b = min(n, a + _CHUNK)
            out[a:b] = mixed((sums[a + length : b + length] - sums[a:b]) * undo[a:b])
        return out

    def _sampled(self) -> np.ndarray:
        """The suffixes that have the least bucket of some string of DEPTH bytes inside their document."""
        n = len(self.data) - DEPTH + 1
        found = []
        for a in range(0, len(self.bucket) if n > 0 else 0, _CHUNK):
            b = min(len(self.bucket), a + _CHUNK)
            # The strings that a suffix of this part can be the least of begin at most SPREAD before it.
            low, high = max(0, a - SPREAD), min(n, b)
            rank = (self.bucket[low : high + SPREAD] >> np.uint64(32)).astype(np.uint32)
            least = _least(rank, SPREAD + 1)
            least[self.doc[low:high] != self.doc[low + DEPTH - 1 : high + DEPTH - 1]] = 0
            ends = np.zeros(SPREAD, np.uint32)
            top = _least(np.concatenate([ends[: SPREAD - (a - low)], least, ends[: b - high + SPREAD]]), SPREAD + 1, np.maximum)
            found.append(a + np.flatnonzero(top[: b - a] == rank[a - low : b - low]))
        at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        doc = self.doc[at]
        return at[(self.doc[at + Q - 1] == doc) & (np.diff(self.ends)[doc] >= DEPTH)]

    def refined(self, at: np.ndarray) -> np.ndarray:
        """Depth 35: the buckets of a suffix and of the one STEP later."""
        return mixed(self.bucket[at] * _PAIR + self.bucket[at + STEP])

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Depth 50: the same from depth 35."""
        return mixed(self.refined(at) * _PAIR + self.refined(at + STEP))

    def _check(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """32 bits of another hash, so that what decides has 96."""
        if not hasattr(self, "_second"):
            self._second = self._sums(1)
        sums, undo = self._second
        return (mixed((sums[at + length] - sums[at]) * undo[at]) >> np.uint64(32)).astype(np.uint32)

    def initial(self) -> Keys:
        # Sampled buckets are the least of many, so they are mixed again to spread over all ranges.
        return Keys(mixed(self.bucket[self.sampled]), None, self.ids[self.doc[self.sampled]], self.ranges)

    def live(self, replies: list[dict]) -> None:
        """Keeps the sampled suffixes whose bucket has several documents."""
        keys = self.initial()
        shared, _ = keys.told(replies, "a")
        self.at = self.sampled[(shared | (keys.least < keys.most))[keys.at]]
        doc = self.doc[self.at]
        self.owner = self.ids[doc]
        self.low, self.high = self.ends[doc], self.ends[doc + 1]
        self.start, self.stop = np.maximum(self.low, self.at - SPREAD), np.minimum(self.high, self.at + DEPTH)

    def surroundings(self) -> Keys:
        key = self.strings(self.start) * _PAIR + self.strings(self.stop - DEPTH)
        key = mixed(key + (self.at - self.start).astype(np.uint64) * np.uint64(131) + (self.stop - self.at).astype(np.uint64))
        return Keys(key, self._check(self.start, self.stop - self.start), self.owner, self.ranges)

    def sides(self) -> tuple[Keys, np.ndarray, np.ndarray]:
        """The buckets of depth 35 that begin STEP before a sampled suffix and at it, where the document has them."""
        left = np.flatnonzero(self.at - STEP >= self.low)
        right = np.flatnonzero(self.at + Q + STEP <= self.high)
        key = np.concatenate([mixed(self.refined(self.at[left] - STEP) + np.uint64(1)), self.refined(self.at[right])])
        return Keys(key, None, np.concatenate([self.owner[left], self.owner[right]]), self.ranges), left, right

    def settle(self, replies: list[dict]) -> None:
        """Suffixes whose surroundings an earlier document has are settled; of the others, the strings that one may still have are left."""
        keys = self.surroundings()
        later, number = keys.told(replies, "c")
        self.repeated = later[keys.at] | (self.owner > keys.least[keys.at])
        sides, left, right = self.sides()
        _, shared = sides.told(replies, "b")
        shared = shared[sides.at]
        own = number[keys.at]
        wide = np.zeros((2, len(self.at)), dtype=bool)
        wide[0, left] = shared[: len(left)] > own[left]
        wide[1, right] = shared[len(left) :] > own[right]
        wide &= ~self.repeated
        places = []
        for rows, before in ((wide[1], range(0, STEP + 1)), (wide[0], range(STEP + 1, SPREAD + 1))):
            some = np.flatnonzero(rows)
            for k in before:
                p = self.at[some] - k
                places.append(p[(p >= self.low[some]) & (p + DEPTH <= self.high[some])])
        self.places = np.unique(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)

    def edges(self) -> Keys:
        return Keys(self.strings(self.places), self._check(self.places, DEPTH), self.ids[self.doc[self.places]], self.ranges)

    def covered(self, replies: list[dict]) -> np.ndarray:
        """Which bytes a repeated string covers."""
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        some = np.flatnonzero(self.repeated)
        first, last = self.start[some], np.minimum(self.at[some], self.high[some] - DEPTH)
        np.add.at(change, first, 1)
        np.subtract.at(change, last + DEPTH, 1)
        keys = self.edges()
        later, _ = keys.told(replies, "w")
        found = self.places[later[keys.at] | (self.ids[self.doc[self.places]] > keys.least[keys.at])]
        np.add.at(change, found, 1)
        np.subtract.at(change, found + DEPTH, 1)
        return np.cumsum(change[:-1]) > 0


_SENT = "range int, block long, kind string, n int, head binary, tail binary"
_REPLY = "block long, range int, kind string, n int, bits binary, numbers binary"
_SENT_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
_REPLY_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _table(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def _replied(sent: DataFrame) -> DataFrame:
    """Replies to all cells; a task has one range of identifiers at a time."""

    def reply(group: pa.Table) -> pa.Table:
        kinds: dict[str, list[dict]] = {}
        for x in group.to_pylist():
            kinds.setdefault(x["kind"], []).append(x)
        return _table([r for rows in kinds.values() for r in answered(rows)], _REPLY, _REPLY_TYPES)

    return sent.groupBy("range").applyInArrow(reply, _REPLY)


def removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text).

    A byte is removed if a string of 50 bytes of its document that covers it also starts in a document with a
    smaller doc_id; all strings are judged on the input. kept is what remains, null unless
    keep_text is set. Identifiers that decide have 96 bits.

    A null text is empty. A null doc_id counts as smaller than every number. Rows that repeat an id
    aren't smaller than each other. Texts shorter than 50 bytes keep all. An empty table gives
    no rows; other columns are not read. A text is never split: a task needs about 60 bytes of
    memory for each byte of a block, or of its longest text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, "block long, size long, ids binary, sizes binary, data binary")
    # The checkpoint keeps its partitioning, so replies come to the blocks and blocks stay where they are.
    blocks = cut(packed.repartition(parts, "block"))
    ranges = max(2 * parts, math.ceil(total / RANGE))

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _table(Block(row, ranges).initial().sent(row["block"], "a"), _SENT, _SENT_TYPES).to_batches()

    def prepared(left: pa.Table, right: pa.Table, rounds: int) -> Iterator[tuple[Block, list[dict]]]:
        replies = right.to_pylist()
        for row in left.to_pylist():
            block = Block(row, ranges)
            block.live(replies)
            if rounds > 1:
                block.settle(replies)
            yield block, replies

    def refine(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, _ in prepared(left, right, 1):
            rows += block.surroundings().sent(block.number, "c") + block.sides()[0].sent(block.number, "b")
        return _table(rows, _SENT, _SENT_TYPES)

    def edges(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table([r for block, _ in prepared(left, right, 2) for r in block.edges().sent(block.number, "w")], _SENT, _SENT_TYPES)

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, replies in prepared(left, right, 2):
            gone = block.covered(replies)
            for doc, a, b in zip(block.ids.tolist(), block.ends[:-1].tolist(), block.ends[1:].tolist(), strict=True):
                mask = gone[a:b]
                kept = block.data[a:b][~mask].tobytes()
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                rows.append((None if doc == _NO_ID else doc, b - a, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return _table(rows, _RESULT, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    def at_blocks(replies: DataFrame, f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, schema)

    replies = stored(_replied(blocks.mapInArrow(initial, _SENT)), "replies")
    replies = replies.unionByName(stored(_replied(at_blocks(replies, refine, _SENT)), "replies"))
    replies = replies.unionByName(stored(_replied(at_blocks(replies, edges, _SENT)), "replies"))
    return at_blocks(replies, result, _RESULT)
