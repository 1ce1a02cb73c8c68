"""The prefix trie of all conversations, built family by family.

Conversations whose ids have the same base are a family and share their first turns. A family's turns meet in one
place, are rebuilt there and become a small trie; only what the families' tries have, a row a node, is shuffled to be merged.

Turns are narrow here: two hashes of role and text, and a length. A prefix is known by its depth and by two 64-bit sums of hashes
of (place, turn), which can be carried on from any place. So a conversation of very many turns is cut into segments that are
families of their own, and no task holds more than PACK turns, about, or SEGMENT turns of each member of one family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lined_up, mixed, stored

#: Members of a family, and one more than the turns that they may share.
FAMILY, SHARED = 5, 9
#: Turns of one segment of a conversation; not less than SHARED.
SEGMENT = 4096
#: Turns of the families that are built by one call, about.
PACK = 1 << 15
#: Bytes of one piece of a list of ids.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = ["depth", "k1", "k2"]
_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, n_bytes long, ends array<long>"


def _codes(turn: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of a turn at its place."""
    return mixed(turn.view(np.uint64) ^ mixed((place.astype(np.uint64) + np.uint64(1)) * _ODD))


def _running(x: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums over each group's members before and at each; first has the place of each group's first member."""
    total = np.cumsum(x, dtype=np.uint64)
    return total - (total[first] - x[first])[group]


def small_tries(turns: dict[str, np.ndarray], members: dict[str, np.ndarray]) -> dict[str, list | np.ndarray]:
    """The nodes of the families in one pack, one for each prefix.

    turns: conv_id, place, t1, t2, n_bytes, the members' own turns of one segment. members: conv_id, base, n_head (the turns of the
    base's that are put first), skip (the own turns that go), last (the segment that has the last turn), o1, o2 (the sums before this segment), segment.
    """
    order = np.lexsort((turns["place"], turns["conv_id"]))
    turns = {k: v[order] for k, v in turns.items()}
    order = np.argsort(members["conv_id"], kind="stable")
    members = {k: v[order] for k, v in members.items()}
    ids, segment = members["conv_id"], int(members["segment"][0])
    of = np.searchsorted(ids, turns["conv_id"])
    own = np.flatnonzero(turns["place"] >= members["skip"][of])
    n_head = members["n_head"] if segment == 0 else np.zeros(len(ids), dtype=np.int64)
    # The base's first turns, once for each member that begins with them.
    heads = np.repeat(np.arange(len(ids)), n_head)
    nth = np.arange(len(heads)) - np.repeat(np.cumsum(n_head) - n_head, n_head)
    taken = np.concatenate([np.searchsorted(turns["conv_id"], members["base"][heads]) + nth, own])
    member = np.concatenate([heads, of[own]])
    place = np.concatenate([nth, turns["place"][own] - members["skip"][of[own]] + members["n_head"][of[own]]])
    order = np.lexsort((place, member))
    taken, member, place = taken[order], member[order], place[order]
    firsts = np.flatnonzero(np.diff(member, prepend=-1))
    group = np.cumsum(np.diff(member, prepend=-1) != 0) - 1
    sums = []
    for turn, before in (("t1", "o1"), ("t2", "o2")):
        code = _codes(turns[turn][taken], place)
        at = _running(code, firsts, group) + members[before].view(np.uint64)[member]
        sums += [at, at - code]
    k1, p1, k2, p2 = sums
    depth, n_bytes = place + 1, turns["n_bytes"][taken]
    # The root has all members; it is counted with the first segment.
    everyone = np.arange(len(ids)) if segment == 0 else np.zeros(0, dtype=np.int64)
    none = np.zeros(len(everyone), dtype=np.int64)
    member, depth, n_bytes = (np.concatenate(x) for x in ((everyone, member), (none, depth), (none, n_bytes)))
    k1, k2, p1, p2 = (np.concatenate([none.view(np.uint64), x]) for x in (k1, k2, p1, p2))
    # A member ends at its deepest prefix, if this is its last segment.
    ends = np.zeros(len(ids), dtype=np.int64) - 1
    np.maximum.at(ends, member, depth)
    ending = (depth == ends[member]) & (members["last"][member] == segment)
    order = np.lexsort((ids[member], k2, k1, depth))
    new = np.ones(len(order), dtype=bool)
    for i, x in enumerate((depth, k1, k2)):
        s = x[order]
        new[1:] = (s[1:] != s[:-1]) if i == 0 else new[1:] | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    one = order[first]
    n_ends = np.bincount(node[ending[order]], minlength=len(first))
    ended = ids[member[order]][ending[order]]
    stops = np.cumsum(n_ends)
    return {
        "depth": depth[one], "k1": k1[one].view(np.int64), "k2": k2[one].view(np.int64), "p1": p1[one].view(np.int64), "p2": p2[one].view(np.int64),
        "conv_id": ids[member[one]], "n_convs": np.diff(np.append(first, len(order))), "n_bytes": n_bytes[one],
        "ends": [ended[a:b] for a, b in zip((stops - n_ends).tolist(), stops.tolist(), strict=True)],
    }


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _family(turns: pa.Table, members: pa.Table) -> pa.Table:
    if not members.num_rows:
        return pa.table([[]] * 9, schema=_SCHEMA)
    nodes = small_tries(_columns(turns), _columns(members))
    return pa.table([pa.array(nodes[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


_SCHEMA = pa.schema([(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in _NODE.split(", ")])


def _signed(x: Column) -> Column:
    """A sum of 64-bit numbers, which may be a long decimal, as the 64-bit number that addition without carry gives."""
    top, half = (F.lit(str(n)).cast("decimal(38,0)") for n in (1 << 64, 1 << 63))
    x = F.pmod(x, top)
    return F.when(x >= half, x - top).otherwise(x).cast("long")


def _before(turns: DataFrame, members: DataFrame, segment: int) -> DataFrame:
    """(of, seg, o1, o2): for conversations of several segments, the sums of their rebuilt turns before each segment but the first."""
    long = members.where(F.col("last") > 0).select(F.col("conv_id").alias("of"), "base", "n_head", "skip", "last")
    own = turns.join(long.drop("base"), F.col("conv_id") == F.col("of")).where("place >= skip")
    own = own.select("of", F.floor(F.col("place") / segment).alias("seg"), (F.col("place") - F.col("skip") + F.col("n_head")).alias("place"), "t1", "t2")
    heads = turns.where((F.col("place") < SHARED) & (F.col("conv_id") == F.col("base"))).drop("base")
    heads = heads.join(long, F.col("conv_id") == F.col("base")).where("place < n_head").select("of", F.lit(0).cast("long").alias("seg"), "place", "t1", "t2")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [pa.array(_codes(b.column(t).to_numpy(), b.column("place").to_numpy()).view(np.int64)) for t in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("seg"), *codes], names=["of", "seg", "c1", "c2"])

    codes = own.unionByName(heads).mapInArrow(coded, "of long, seg long, c1 long, c2 long")
    sums = codes.groupBy("of", "seg").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c) for c in ("c1", "c2")))
    earlier = Window.partitionBy("of").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "seg", *(F.sum(_signed(F.col(c)).cast("decimal(20,0)")).over(earlier).alias(o) for c, o in (("c1", "o1"), ("c2", "o2"))))
    return sums.where("seg > 0").select("of", "seg", *(_signed(F.col(o)).alias(o) for o in ("o1", "o2")))


def _family_nodes(conversations: DataFrame, segment: int) -> DataFrame:
    """The nodes of every family's trie, stored."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(FAMILY), text, role).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"),
        role.alias("role"), F.sha2(text, 256).alias("digest"),
    )
    turns = lined_up(turns, "conv_id", "turn", "role", "digest").drop("turn", "role", "digest")
    counts = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = counts.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    sizes = counts.where("conv_id = base").select(F.col("base").alias("of"), F.col("n").alias("n_base"))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    members = counts.join(sizes, F.col("base") == F.col("of"), "left").select("conv_id", "base", "first", "n", shared.alias("skip"), F.least(shared, F.coalesce("n_base", F.lit(0))).alias("n_head"))
    # The last segment of a conversation is that of its last own turn, the first if none is left.
    members = cut(members.withColumn("last", F.floor((F.col("n") - 1) / segment)))
    total, longest = members.agg(F.sum("n"), F.max("last")).first()
    packs = max(1, -(-(total or 0) // PACK))
    pack = F.pmod(F.xxhash64("base"), F.lit(packs)).alias("pack")
    turns = turns.join(members.select(F.col("conv_id").alias("of"), "base", "first"), F.col("conv_id") == F.col("of"))
    turns = turns.select("conv_id", "base", (F.col("at") - F.col("first")).alias("place"), "t1", "t2", "n_bytes")
    zero = F.lit(0).cast("long")
    facts = members.select(F.col("conv_id").alias("conv_id"), F.col("base").alias("base"), "n_head", "skip", "last", F.explode(F.sequence(zero, "last")).alias("segment"), pack)
    if longest:
        before = _before(turns, members, segment).withColumnRenamed("seg", "at")
        facts = facts.join(before, (F.col("conv_id") == F.col("of")) & (F.col("segment") == F.col("at")), "left").drop("of", "at")
        facts = facts.withColumns({o: F.coalesce(o, zero) for o in ("o1", "o2")})
    else:
        facts = facts.withColumns({"o1": zero, "o2": zero})
    own = turns.select("conv_id", "place", "t1", "t2", "n_bytes", pack.alias("of_pack"), F.floor(F.col("place") / segment).alias("of_segment"))
    nodes = own.groupBy("of_pack", "of_segment").cogroup(facts.groupBy("pack", "segment")).applyInArrow(_family, _NODE)
    return stored(nodes, "family-nodes")


def _ends(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): the hash of every node's list of the conversations that end there.

    Ids are sorted by ranges and joined into pieces, and a node's pieces then go through one hash in their order, a batch at a time: neither a list nor its text is ever held whole.
    """
    ended = nodes.select(*_KEYS, F.explode("ends").alias("conv"))
    ended = ended.repartitionByRange(*_KEYS, "conv").sortWithinPartitions(*_KEYS, "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, first, size = None, [], 0, 0
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*_KEYS, "conv", "piece"])

        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "conv")), strict=True):
                if own != key or size > PIECE:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    if sum(len(x[-1]) for x in out[-1:]) > PIECE // 2 or len(out) >= 4096:
                        yield flushed()
                    key, held, first, size = own, [], conv, 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            out.append((*key, first, ",".join(held)))
        if out:
            yield flushed()

    pieced = ended.mapInArrow(pieces, "depth long, k1 long, k2 long, conv long, piece string")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, piece in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "piece")), strict=True):
                if own == key:
                    state.update(b"," + piece.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(piece.encode())
            if out:
                yield _hashed(out)
        if key:
            yield _hashed([(*key, state.hexdigest())])

    # Spark sorts the pieces of a partition on disk where they are many.
    return pieced.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "conv").mapInArrow(hashes, "e_depth long, e1 long, e2 long, sha string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=["e_depth", "e1", "e2", "sha"])


def _totals(chains: DataFrame) -> DataFrame:
    """chains(conv_id, above, at, leaves, saved) with both numbers summed over all chains below, too.

    After k rounds a chain has the sums of all that are less than 2 ** k steps below, and the chain 2 ** k steps above: as many rounds
    as the logarithm of the longest way up. Each is an aggregation and two joins by chain, of a row a chain.
    """
    state = cut(chains.select("conv_id", F.col("above").alias("up"), "leaves", "saved"))
    while state.where("up IS NOT NULL").limit(1).count():
        rising = state.where("up IS NOT NULL")
        more = rising.groupBy(F.col("up").alias("to")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        over = state.where("up IS NOT NULL").select(F.col("conv_id").alias("via"), F.col("up").alias("next"))
        state = state.join(more, F.col("conv_id") == F.col("to"), "left").join(over, F.col("up") == F.col("via"), "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        state = cut(state.select("conv_id", F.col("next").alias("up"), *sums))
    return chains.select("conv_id", "above", "at").join(state.drop("up"), "conv_id")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix of the rebuilt conversations.

    conversations(conv_id, turn, role, text) are ordered by turn, a null first, then role and the text's SHA-256; null roles and texts
    are empty. With h the CRC-32 of the decimal conv_id modulo 9, a conversation c is rebuilt as the first h
    turns of conversation c - c % 5 (all, if it has fewer; none, if there is no such one) and its own turns after the first h. A node of depth d is
    a distinct sequence of d turns (role, text) that a rebuilt conversation begins with; the root, of depth 0, has none. A node is named by its depth
    and conv_id, the smallest of its members: the conversations that begin with it. saved_tokens sums, over a node and all below it, the bytes of the
    node's last text times its members less one. ends_sha256 hashes the comma-joined ids of those that end at the node.

    Repeated rows are repeated turns. Rows without a conv_id belong to no conversation. Negative ids have c % 5 towards zero. An empty table gives no rows.
    Texts of any length are hashed where they are read. Other columns are not read.
    """
    family = _family_nodes(conversations, segment)
    nodes = family.groupBy(*_KEYS).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *(F.max(c).alias(c) for c in ("p1", "p2", "n_bytes")))
    nodes = cut(nodes)
    parents = nodes.select((F.col("depth") + 1).alias("below"), F.col("k1").alias("of1"), F.col("k2").alias("of2"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(parents, (F.col("depth") == F.col("below")) & (F.col("p1") == F.col("of1")) & (F.col("p2") == F.col("of2")), "left")
    joined = joined.join(_ends(family.where(F.size("ends") > 0)), (F.col("depth") == F.col("e_depth")) & (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    joined = stored(joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "nodes")
    # From here on a node is its conv_id and depth: a conversation's own nodes are the lower end of its path, its chain.
    children = joined.where("depth > 0").groupBy(F.col("parent_conv_id").alias("of"), (F.col("depth") - 1).alias("over")).agg(F.count("*").alias("n"))
    rows = joined.join(children, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("over")), "left")
    rows = rows.select(*joined.columns, F.coalesce("n", F.lit(0)).alias("n_children"))
    rows = stored(rows.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "trie")
    foreign = F.col("parent_conv_id") != F.col("conv_id")
    chains = rows.groupBy("conv_id").agg(F.max(F.when(foreign, F.col("parent_conv_id"))).alias("above"), F.max(F.when(foreign, F.col("depth") - 1)).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hung = _totals(chains).where("above IS NOT NULL").groupBy(F.col("above").alias("of"), F.col("at").alias("over")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    rows = rows.join(hung, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("over")), "left")
    own = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    rows = rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", F.floor(F.col("depth") / segment).alias("part"), *own)
    # Sums from each node down its chain: within a part of the chain, and over the parts below.
    down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))
    under = Window.partitionBy("chain").orderBy(F.desc("of_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("conv_id").alias("chain"), F.col("part").alias("of_part")).agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"))
    parts = parts.select("chain", "of_part", *(F.coalesce(F.sum(c).over(under), F.lit(0)).alias(f"under_{c}") for c in ("a", "b")))
    rows = rows.withColumns({c: F.sum(c).over(down) for c in ("leaves", "saved")})
    rows = rows.join(parts, (F.col("conv_id") == F.col("chain")) & (F.col("part") == F.col("of_part")))
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("under_a")).alias("n_leaves"), (F.col("saved") + F.col("under_b")).alias("saved_tokens"), "ends_sha256"
    )
