"""Rows of a table replayed as a stream: files in order, one a micro-batch, with a stop and a restart between."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import folder

STORE = "spark.sql.streaming.stateStore.providerClass"
FILE_ROWS = 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(s: SparkSession):
    """Keyed state needs the RocksDB store."""
    before = s.conf.get(STORE, None)
    s.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        s.conf.set(STORE, before) if before else s.conf.unset(STORE)


def _dated(s: SparkSession, at: str, first: int) -> int:
    """The file source takes files by their time; gives the files from number ``first`` on, which one write made together,
    times in the order of their names. Only names and times pass the driver."""
    path = s._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(s._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
    new = sorted((f for f in files if f.getModificationTime() > 10**12), key=lambda f: f.getPath().getName())
    for k, f in enumerate(new):
        fs.setTimes(f.getPath(), 1000 * (first + k + 1), -1)
    return first + len(new)


def replayed(rows: DataFrame, order: str, job: Callable[[DataFrame], DataFrame], files: int = 4, files_per_trigger: int = 1) -> DataFrame:
    """Writes rows as files, by ranges of ``order``, and reads them as a stream, ``files_per_trigger`` files a micro-batch.
    The job is stopped when half of the files are taken and started again from its checkpoint for the others. Returns what
    it appended. ``files``: at least; a larger table is written as more, of about ``FILE_ROWS`` rows."""
    s = rows.sparkSession
    at, out, checkpoint = folder(s, "arrivals"), folder(s, "appended"), folder(s, "stream")
    half, n = rows.agg(F.percentile_approx(order, 0.5, 1000), F.count("*")).head()
    each, done = max(files // 2, n // (2 * FILE_ROWS)), 0
    s._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(s._jsc.hadoopConfiguration()).mkdirs(s._jvm.org.apache.hadoop.fs.Path(at))
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(at)
    with _rocks(s):
        result = job(source)
        for part in (F.col(order) <= half, F.coalesce(F.col(order) > half, F.lit(True))):
            rows.where(part).repartitionByRange(each, order).sortWithinPartitions(order).write.mode("append").parquet(at)
            done = _dated(s, at, done)
            running = result.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
    return s.read.schema(result.schema).parquet(out)
