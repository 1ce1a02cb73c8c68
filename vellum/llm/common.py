"""Where intermediate tables go, and small helpers that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import shared_folder

#: The only characters that separate words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row under a name new to it. It is stored, so that a row has one number wherever it is used."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small tables of an iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lined_up(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `at`, every row's place from 0 in the order of the keys; rows that are equal in them come in any order.

    All rows are sorted together, by ranges, and places are counted from the partitions' sizes, so that a key of a third of
    all rows is dealt over many tasks. The sorted rows are stored; the driver gets one number a partition.
    """
    columns = rows.columns
    rows = rows.withColumn("equal", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys, "equal").sortWithinPartitions(*keys, "equal").withColumn("rid", F.monotonically_increasing_id())
    # A row's number has its partition's before the lower 33 bits.
    rows = stored(ordered.select(*columns, F.shiftright("rid", 33).alias("block"), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "rows")
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for block in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(block, 0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    return rows.select(*columns, (F.get(offsets, F.col("block").cast("int")) + F.col("within")).alias("at"))


_CHUNK = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over all output bits. Long arrays are worked on in parts that fit a core's cache."""
    flat = np.ascontiguousarray(x).reshape(-1)
    out = np.empty_like(flat)
    for a in range(0, len(flat), _CHUNK):
        y = flat[a : a + _CHUNK]
        y = y ^ (y >> np.uint64(31))
        y *= np.uint64(0x7FB5D329728EA185)
        y ^= y >> np.uint64(27)
        y *= np.uint64(0x81DADEF4BC2DD44D)
        np.bitwise_xor(y, y >> np.uint64(33), out=out[a : a + _CHUNK])
    return out.reshape(x.shape)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates two star contractions until nothing changes. Large star: every neighbour above u
    is tied to the smallest of u and its neighbours. Small star: the same for the neighbours
    below. Each round is two aggregations and two joins; a node with very many neighbours is
    pre-aggregated before the shuffle, and its join side is one that adaptive execution splits.
    No edges give no rows. Loops and repeated or null-ended edges are ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # Every edge is kept once, as (larger, smaller).
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
