"""Sharded storage with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards. Compaction takes, within each size tier, runs of shards of similar size
and merges a run into one file of about the target size; larger files stay as they are. A version is a manifest: a Parquet
table with a row a shard, which Spark writes aside, and a mark that names it. The mark is made in one step that fails where
another writer has made that version's first, so no version is ever overwritten and readers see whole ones only. Old versions
stay readable until vacuum().

Runs are planned on the manifest's rows by sums along each tier. A round of compaction merges ``ROUND`` shards at most, in one
job: rows go to the partition that their shard's run names, and the runs' names, at most ``ROUND``, are broadcast. What the
driver holds at a time is the names of one round, and, like any reader of Parquet files, of the files that a read opens.

Marks: hard links on local disks and renames on HDFS fail where the name is taken. A store whose rename overwrites has to be
given another ``publish``.

Defined cases: an empty arrival adds no shard; nulls, repeated rows, ties, very long texts and further columns of any name
are stored as they are; a store without shards has no rows to read and raises as Spark does for no files.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import _shuffles_freed, fresh, unused

#: In so many parts the query lets the documents arrive.
ARRIVALS = 3
#: Shards that one round of compaction merges at most, and shards whose names are broadcast.
ROUND = 10_000

_NAME = r"([^/]+/[^/]+)$"


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    SCHEMA = "file string, bytes long, tier int"

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, least_run: int = 4, publish: Callable[[str, str], bool] | None = None):
        """publish: (from, to) -> whether ``to`` was made of ``from`` in one step, False where it is there already."""
        self.spark, self.path, self.target, self.least_run = spark, path.rstrip("/"), target_bytes, least_run
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._publish = publish or self._published

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        at = self._path("manifest")
        if not self._fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file (below the store), bytes and tier of each shard of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.SCHEMA)
        table = self.spark.read.text(f"{self.path}/manifest/v{version:08d}").head()[0]
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/tables/{table}")

    def shards(self, version: int | None = None) -> list[dict]:
        """The manifest's rows in the order of their names."""
        return sorted((r.asDict() for r in self.manifest(version).collect()), key=lambda s: s["file"])

    def _commit(self, manifest: DataFrame, version: int) -> int:
        table, name = uuid.uuid4().hex, f"manifest/v{version:08d}"
        if self._fs.exists(self._path(name)):
            raise VersionTaken(name)
        manifest.write.parquet(f"{self.path}/tables/{table}")
        aside = f"manifest/_{table}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(table.encode()))
        out.close()
        made = self._publish(f"{self.path}/{aside}", f"{self.path}/{name}")
        self._fs.delete(self._path(aside), False)
        if not made:
            self._fs.delete(self._path(f"tables/{table}"), True)
            raise VersionTaken(name)
        return version

    def _published(self, aside: str, name: str) -> bool:
        a, b = self._hadoop.Path(aside), self._hadoop.Path(name)
        if self._fs.getScheme() != "file":
            return self._fs.rename(a, b)
        nio = self.spark._jvm.java.nio.file
        try:
            nio.Files.createLink(*(nio.Path.of(self._fs.makeQualified(p).toUri()) for p in (b, a)))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _tier(self):
        """0 for shards of the target size or more; each further tier is four times smaller."""
        return F.greatest(F.lit(0), F.ceil(F.log(F.lit(self.target) / F.greatest("bytes", F.lit(1))) / math.log(4) - 1e-9)).cast("int")

    def _written(self, folder: str) -> DataFrame:
        """The shards that one write made. Only names and lengths are read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{self.path}/{folder}")
        return files.select(F.concat(F.lit("data/"), F.regexp_extract("path", _NAME, 1)).alias("file"), F.col("length").alias("bytes")).withColumn("tier", self._tier())

    # data

    def append(self, df: DataFrame, shard_rows: int = 2000) -> int:
        """A version with df's rows added, in shards of at most shard_rows rows."""
        last, folder = self.version(), f"data/{uuid.uuid4().hex}"
        counted = df.observe(seen := _observed(), F.count(F.lit(1)).alias("n"))
        counted.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        before = self.manifest(last)
        return self._commit(before.unionByName(self._written(folder)) if seen.get["n"] else before, last + 1)

    def runs(self, manifest: DataFrame) -> DataFrame:
        """file, run: shards of one tier, in the order of their names, cut where another target size is full. Only runs of
        ``least_run`` shards, or of several that come near the target size."""
        along = Window.partitionBy("tier").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
        full = F.floor(F.coalesce(F.sum("bytes").over(along), F.lit(0)) / self.target)
        cut = manifest.where("tier > 0").withColumn("run", F.struct("tier", full.alias("nth")))
        size = cut.groupBy("run").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
        worth = size.where((F.col("n") >= self.least_run) | (F.col("n") > 1) & (F.col("all") >= 0.75 * self.target))
        return cut.join(worth.select("run"), "run").select("file", "run")

    def compact(self) -> int:
        """Merges until no tier holds a run; each round is a version."""
        while True:
            last = self.version()
            manifest = self.manifest(last)
            files = self.runs(manifest).orderBy(F.desc("run.tier"), "run.nth", "file").limit(ROUND).collect()
            whole = [r for r in files if len(files) < ROUND or r.run != files[-1].run]  # the last run may go on
            if not whole:
                return last
            number = {run: k for k, run in enumerate(dict.fromkeys((r.run.tier, r.run.nth) for r in whole))}
            table = [(r.file, number[r.run.tier, r.run.nth]) for r in whole]
            rows = self.spark.read.parquet(*[f"{self.path}/{file}" for file, _ in table])
            shard, run = unused(rows, "shard"), unused(rows, "run")
            names = self.spark.createDataFrame(table, f"`{shard}` string, `{run}` int")
            mine = F.concat(F.lit("data/"), F.regexp_extract(F.col("_metadata.file_path"), _NAME, 1))
            merged = rows.withColumn(shard, mine).join(F.broadcast(names), shard).repartitionById(len(number), F.col(run)).drop(shard, run)
            folder = f"data/{uuid.uuid4().hex}"
            with _shuffles_freed(self.spark):
                merged.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
            gone = names.select(F.col(shard).alias("file"))
            self._commit(manifest.join(F.broadcast(gone), "file", "left_anti").unionByName(self._written(folder)), last + 1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{r.file}" for r in self.manifest(version).select("file").toLocalIterator()])

    def vacuum(self) -> int:
        """Deletes shards that the last version does not name; returns how many."""
        data = f"{self.path}/data"
        there = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(data)
        there = there.select(F.concat(F.lit("data/"), F.regexp_extract("path", _NAME, 1)).alias("file"))
        n = 0
        for r in there.join(self.manifest().select("file"), "file", "left_anti").toLocalIterator():
            n += self._fs.delete(self._path(r.file), False)
        return n


def _observed():
    from pyspark.sql import Observation

    return Observation()


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the store returns it after ``ARRIVALS`` appends, each compacted: doc_id, n_chars, text_sha256, its
    shard's name, tier and bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, fresh(spark, "shards"), target_bytes=32 << 20)
    if docs.isEmpty():
        return docs.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.lit("").alias("shard"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("shard_bytes"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact()
        store.vacuum()
    table = store.manifest().select(F.col("file").alias("shard"), "tier", F.col("bytes").alias("shard_bytes"))
    table = F.broadcast(table) if table.count() <= ROUND else table
    mine = F.concat(F.lit("data/"), F.regexp_extract(F.col("_metadata.file_path"), _NAME, 1))
    rows = store.read().select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"), mine.alias("shard"))
    return rows.join(table, "shard")
