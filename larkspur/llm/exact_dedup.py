"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: the join of new digests with it needs no shuffle of the
index (Spark sorts a bucket again where several batches left a file each; ``compact`` makes it one file). New data is
grouped by digest (partial aggregates first, so that a text with very many copies sends one row per task), the known
digests leave by a sort-merge anti-join, and the rest is appended. Rows meet their digest's entry by a sort-merge join
too, but for digests that more than one row in ``HOT`` has: of those there are at most ``HOT``, and they are broadcast.

Batches: with a ``batch`` id from the caller, a job that died and runs again gives the rows of the first run, since the
entries that a batch brought carry its id. Without one, each call is a batch of its own.

Defined cases: a null text counts as empty; of rows with one digest the one with the most code points stays, then the
smallest id, null ids last; repeated rows are members of their group like any other; an empty table gives no rows;
further columns are ignored. In a later batch a digest that the index knows keeps the row that the index names, so no
row of the batch stays for it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, fresh, staged, unused

#: A digest that more than one row in HOT of a batch has is joined by broadcast.
HOT = 1000

#: What normalisation deletes: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def _digest(text):
    return F.unhex(F.sha2(F.translate(text, SPACE, ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), F.length(text).alias("n_chars"))


class DigestIndex:
    """digest, keep_id, n_chars, group_size, batch: one row for each distinct normalised text seen so far."""

    SCHEMA = "digest BINARY, keep_id BIGINT, n_chars INT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        """name: of the catalog table; path: its files, in a store that all executors share; buckets: fixed when the
        table is made, so that one bucket of the final index fits a task (default: the shuffle partitions, twelve at
        least)."""
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.name):
            at = path or fresh(spark, "digest-index")
            spark.sql(
                f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet OPTIONS (compression 'zstd') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds the new texts of docs to the index. Returns one row per document: doc_id, keep_id, group_size (rows with
        this text in the batch that brought it), kept, text_sha256."""
        name = batch or uuid.uuid4().hex
        rows = staged(digests(docs, id_col, text_col), "digests")
        order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_chars"))
        best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        best = best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size", F.lit(name).alias("batch"))
        best = staged(best, "texts")
        new = best.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        known = self.table().select("digest", "keep_id", "group_size", (F.col("batch") == name).alias("new"))
        hot = best.where(F.col("group_size") > rows.count() / HOT).select("digest")  # HOT rows at most
        often = known.join(F.broadcast(hot), "digest").select("digest", F.struct("keep_id", "group_size", "new").alias("entry"))
        marked = rows.join(F.broadcast(often), "digest", "left")
        found = [
            marked.where("entry IS NOT NULL").select("digest", "doc_id", "entry.*"),
            marked.where("entry IS NULL").drop("entry").hint("merge").join(known.hint("merge"), "digest").select("digest", "doc_id", "keep_id", "group_size", "new"),
        ]
        return found[0].unionByName(found[1]).select(
            "doc_id", "keep_id", "group_size", (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def compact(self) -> None:
        """One sorted file a bucket in place of one a batch. No other job may write meanwhile."""
        old, new = f"{self.name}_old", DigestIndex(self.spark, f"{self.name}_new", buckets=self.buckets)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self._location()).repartition(self.buckets, "digest")  # not as buckets: Spark would drop the shuffle
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(new.name)
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {new.name} RENAME TO {self.name}")
        DigestIndex(self.spark, old).drop()

    def _location(self) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").head()["data_type"]

    def drop(self) -> None:
        """Deletes the index, files included."""
        at = self._location()
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, at)


@contextmanager
def _own_index(spark: SparkSession):
    """An index for one run."""
    index = DigestIndex(spark)
    try:
        yield index
    finally:
        index.drop()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents of a batch that stay, with all their columns: one row for each new text, also where ids are null or
    several texts have one id. Without an index, texts are compared within the batch only."""
    if index is None:
        with _own_index(docs.sparkSession) as own:
            winners = staged(_winners(docs, own, id_col, text_col, batch), "winners")
    else:
        winners = staged(_winners(docs, index, id_col, text_col, batch), "winners")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest, chars = unused(docs, "digest"), unused(docs, "chars")
    own_rows = docs.withColumns({digest: _digest(text), chars: F.length(text)})
    same = (own_rows[digest] == winners["digest"]) & own_rows[id_col].eqNullSafe(winners["keep_id"]) & (own_rows[chars] == winners["n_chars"])
    return own_rows.join(winners, same, "left_semi").dropDuplicates([digest, id_col]).drop(digest, chars)


def _winners(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str | None) -> DataFrame:
    """digest, keep_id, n_chars of the texts that a batch brings."""
    name = batch or uuid.uuid4().hex
    index.ingest(docs, id_col, text_col, name)
    return index.table().where(F.col("batch") == name).select("digest", "keep_id", "n_chars")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _own_index(spark) as index:
        return staged(index.ingest(spark.read.parquet(f"{sf_dir}/documents.parquet")), "op3")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
