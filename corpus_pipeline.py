"""A corpus made ready for training, stage by stage. Each stage's rows are written and read again by the next.

Defined cases: a document without text or without a letter goes in the first stage, so later ones see texts only; rows that
are equal as a whole are exact copies; a null id is carried along, and documents with one are never near copies; empty
tables give no rows; further columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, language, near_dup, packing, pii
from larkspur.llm.store import staged, unused


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose best language is less likely than all others together."""
    labelled = docs.select("doc_id", "text", "lang").where(~language.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = language.LanguageModel.fit(labelled)
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    kept = model.predict(docs, keep=tuple(c for c in docs.columns if c != "doc_id"), names=(pred, score))
    return kept.where((F.col(pred) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.near_dedup(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(staged(packing.token_pieces(docs), "token-pieces"))


STAGES = [
    ("language", keep_known_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the language, near-copy, disguise and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
