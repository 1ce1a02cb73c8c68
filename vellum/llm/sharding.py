"""Sharding by size-tiered compaction, with versioned manifests.

A store is a folder: runs of immutable shard files under data/, and one manifest file for each
version. A version exists once its manifest file has its final name; a job that dies before
leaves files that no manifest names. Only DataFrame operations touch rows. The rename must fail where the name is taken, as on HDFS
and local disks; on an object store without such a rename a store has one writer at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, unused


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class ShardStore:
    """A table kept as immutable shards.

    append() adds the rows it gets as one run of small shards. compact() merges runs of similar
    size: runs are in the same tier if their sizes have the same whole logarithm to the base
    fanout; a tier with fanout runs or more becomes one run of files near target_bytes.
    So a row is rewritten once a tier, and a version has fewer than fanout runs a tier.
    Nulls, repeated rows and any columns, whatever their names, are stored as they come; an
    append of no rows is no new version.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, shard_bytes: int = 8 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.shard_bytes, self.fanout = target_bytes, shard_bytes, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest-{version:08d}.parquet"

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.parquet"))
        return max((int(f.getPath().getName()[9:17]) for f in found or ()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, shard, bytes, rows): the shards of a version."""
        return self.spark.read.parquet(self._manifest_path(version or self.version()))

    def _runs(self, version: int) -> list[tuple[str, int]]:
        """Runs and their bytes: fewer than fanout runs a tier, and those appended since."""
        if not version:
            return []
        rows = self.manifest(version).groupBy("run").agg(F.sum("bytes").alias("bytes")).collect()
        return sorted((r["run"], r["bytes"]) for r in rows)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.shard_bytes, self.fanout) + 1))

    def _shards(self, run: str) -> DataFrame:
        """The shard files of a run with their sizes and rows; no column of the rows is read."""
        rows = self.spark.read.parquet(f"{self.root}/data/{run}")
        file = rows.metadataColumn("_metadata")
        files = rows.select(file.getField("file_name").alias("file"), file.getField("file_size").alias("bytes"))
        shard = F.concat(F.lit(f"{run}/"), F.regexp_extract("file", r"part-(\d+)", 1))
        return files.groupBy("file", "bytes").agg(F.count("*").alias("rows")).select(F.lit(run).alias("run"), shard.alias("shard"), "bytes", "rows")

    def _commit(self, base: int, shards: DataFrame) -> int:
        """Makes `shards` version base + 1 by one rename of a whole file, which fails if another was first."""
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(staged)
        file = self._fs.globStatus(self._path(f"{staged}/part-*.parquet"))[0].getPath()
        to = self._path(self._manifest_path(base + 1))
        if self._fs.exists(to) or not self._fs.rename(file, to):
            self._fs.delete(self._path(staged), True)
            raise CommitConflict(f"version {base + 1} of {self.root} exists")
        self._fs.delete(self._path(staged), True)
        return base + 1

    def append(self, rows: DataFrame) -> int:
        """Commits the rows as one new run, in as many shards as they have partitions. Returns the version."""
        run = f"{self.version() + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/data/{run}")
        return self.adopt(run)

    def land(self, rows: DataFrame, arrival: Column) -> list[str]:
        """Writes rows that belong to several arrivals once, dealt by the arrival's number, and returns a run for each in that order; none is committed."""
        name, landing = unused(rows, "arrival"), f"landed-{uuid.uuid4().hex[:8]}"
        rows.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.root}/data/{landing}")
        found = self._fs.globStatus(self._path(f"{self.root}/data/{landing}/{name}=*")) or ()
        names = [f.getPath().getName() for f in found]
        return [f"{landing}/{n}" for n in sorted(names, key=lambda n: int(n.rpartition("=")[2]))]

    def adopt(self, run: str) -> int:
        """Commits a run whose files are there. Returns the version."""
        base, shards = self.version(), self._shards(run)
        if not shards.limit(1).count():
            return base
        return self._commit(base, self.manifest(base).unionByName(shards) if base else shards)

    @contextmanager
    def _packed(self) -> Iterator[None]:
        """Within it, scans put files into partitions of target_bytes, whatever the number of cores."""
        wanted = {"maxPartitionBytes": self.target_bytes, "openCostInBytes": 0, "minPartitionNum": 1}
        before = {k: self.spark.conf.get(f"spark.sql.files.{k}", None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(f"spark.sql.files.{k}", v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(f"spark.sql.files.{k}") if v is None else self.spark.conf.set(f"spark.sql.files.{k}", v)

    def compact(self) -> int:
        """Merges every tier that has fanout runs, smallest first, until none has. Returns the version."""
        while True:
            base = self.version()
            tiers: dict[int, list[tuple[str, int]]] = {}
            for run, size in self._runs(base):
                tiers.setdefault(self.tier(size), []).append((run, size))
            full = [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not full:
                return base
            names = [run for run, _ in full[0]]
            merged = f"{base + 1:08d}-{uuid.uuid4().hex[:8]}"
            # Shards are packed by their bytes into files of the target size: rows move without a shuffle.
            with self._packed():
                self.spark.read.parquet(*(f"{self.root}/data/{r}" for r in names)).write.parquet(f"{self.root}/data/{merged}")
            self._commit(base, self.manifest(base).where(~F.col("run").isin(names)).unionByName(self._shards(merged)))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self.spark.read.parquet(*(f"{self.root}/data/{run}" for run, _ in self._runs(version or self.version())))

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version in a struct `row`, beside the run and shard each lies in and the shard's bytes."""
        rows = self.read(version)
        file = rows.metadataColumn("_metadata")
        run = F.regexp_extract(file.getField("file_path"), r"/data/((?:landed-[^/]+/)?[^/]+)/[^/]+$", 1)
        part = F.regexp_extract(file.getField("file_name"), r"part-(\d+)", 1)
        whole = F.struct(*(rows[f"`{c}`"] for c in rows.columns))
        return rows.select(run.alias("run"), F.concat(run, F.lit("/"), part).alias("shard"), file.getField("file_size").alias("shard_bytes"), whole.alias("row"))

    def vacuum(self) -> int:
        """Deletes what only older versions name, and their manifests; returns how many runs went. Not while others write."""
        newest = self.version()
        live = {run for run, _ in self._runs(newest)}
        gone = 0
        folders = [f.getPath() for f in self._fs.globStatus(self._path(f"{self.root}/data/*")) or ()]
        landed = [f for f in folders if f.getName().startswith("landed-")]
        runs = [(f.getName(), f) for f in folders if f not in landed]
        runs += [(f"{f.getName()}/{r.getPath().getName()}", r.getPath()) for f in landed for r in self._fs.globStatus(self._path(f"{self.root}/data/{f.getName()}/*=*")) or ()]
        for run, path in runs:
            if run not in live:
                gone += bool(self._fs.delete(path, True))
        for v in range(1, newest):
            self._fs.delete(self._path(self._manifest_path(v)), False)
        return gone


def sharded(docs: DataFrame, arrivals: int = 8, **options) -> ShardStore:
    """A new store in the shared folder to which docs has been added in `arrivals` batches, by hash of doc_id, with a compaction after each. The table is read once."""
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", **options)
    for run in store.land(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))):
        store.adopt(run)
        store.compact()
    return store
