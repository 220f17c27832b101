"""Tables that others read: written only if their gates hold, with counts and fingerprints beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, by: str, gates: dict[str, Column], disjoint: str | None = None) -> str:
    """Writes df as Parquet partitioned by a column. Raises, and writes nothing, if a gate fails for any row or if a value
    of ``disjoint`` occurs under two partitions."""
    failed = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in gates.items()]).head().asDict()
    if any(failed.values()):
        raise ValueError(f"gates failed: {failed}")
    if disjoint and not df.groupBy(disjoint).agg(F.min(by).alias("a"), F.max(by).alias("b")).where("a <> b").isEmpty():
        raise ValueError(f"{disjoint} occurs under more than one {by}")
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(by).parquet(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("part"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables below path. Returns the manifest: part, file, bytes, sha256."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return _files(next(iter(tables.values())).sparkSession, path)


def checked_bundle(spark: SparkSession, path: str, manifest: DataFrame, budget: int) -> DataFrame:
    """(part, n, hashed, within_budget) of a bundle as it lies there: rows of each part, whether its files are those of the
    manifest with their fingerprints, and whether the whole bundle is at most ``budget`` bytes."""
    told = manifest.select("part", "file", F.col("sha256").alias("told"))
    each = _files(spark, path).join(told, ["part", "file"], "full").groupBy("part").agg(F.sum("bytes").alias("bytes"), F.bool_and(F.coalesce(F.col("sha256") == F.col("told"), F.lit(False))).alias("hashed"))
    total = each.agg(F.sum("bytes").alias("total"))
    rows = None
    for name in [r.part for r in manifest.select("part").distinct().collect()]:  # a few parts
        n = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        rows = n if rows is None else rows.union(n)
    return rows.join(each, "part").crossJoin(F.broadcast(total)).select("part", "n", "hashed", (F.col("total") <= budget).alias("within_budget"))  # one row
