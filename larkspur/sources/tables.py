"""The test tables as interactions, listens, vectors and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, ctx, pos, item, artist, title, ts, weight: order lines as listens of an order's context."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ctx"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("weight"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctx"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    return lines.join(orders, "ctx").join(parts, "item").select("user", "ctx", "pos", "item", "artist", "title", "ts", "weight")


INTERACTIONS = """
x AS (
  SELECT o_custkey AS "user", l_orderkey AS ctx, l_linenumber AS pos, l_partkey AS item, p_brand AS artist,
         p_name AS title, o_orderdate AS ts, l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user, ts (epoch seconds), item, action."""
    e = table(spark, sf_dir, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return e.select("event_id", F.col("user_id").alias("user"), seconds.alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("event_type").alias("action"))


LISTENS = """
e AS (
  SELECT event_id, user_id AS "user", CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_type AS action
  FROM events
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, artist, title."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
