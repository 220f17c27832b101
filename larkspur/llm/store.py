"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only on one machine (tests) it may be unset: then a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries within go as soon as each query ends: what they made is in a table."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f.startswith(shared_dir(spark)) or f.removeprefix("file:///").startswith(shared_dir(spark).removeprefix("file:///")):
            delete(spark, f)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
