"""Long passages that repeat across documents, by recompression.

A scan parses each document into locally consistent symbols and stands one symbol for each run of windows (see
recompress.anchors). Runs whose symbol only one document has are done. Spark groups the others: by symbol and the hash of all words that the run covers, which settles runs
that are equal as a whole, however many documents have them; and by symbol, which leaves the runs whose symbol two
documents share with different surroundings. Only the latter's windows are hashed one by one (128 bits) and grouped.

Groups go through partial aggregates and joins; no list of a group's members is ever built.

Defined cases: a null text counts as empty; documents with a null id neither remove nor lose words; rows that repeat an
id are one document; texts shorter than a window lose nothing; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recompress import anchors, spans
from .store import free, staged
from .words import blocks, tidy, words

WINDOW = 50


def _runs(window: int):
    def run(batches):
        for b in batches:
            for lo, hi, text in blocks(b.column(1)):
                w = words(text)
                start, end, name, region, _ = anchors(w.hashes(), w.doc, window)
                doc = w.doc[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)),
                        pa.array(region.view(np.int64)),
                        b.column(0).take(pa.array(doc + lo)),
                        pa.array((start - w.first[doc]).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)),
                    ],
                    ["symbol", "region", "doc", "at", "n"],
                )

    return run


def _windows(window: int):
    def run(batches):
        for b in batches:
            for lo, hi, text in blocks(b.column(1)):
                w = words(text)
                lists = b.column(2).slice(lo, hi - lo)
                size = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                doc = np.repeat(np.arange(hi - lo), size)
                within = at.astype(np.int64) + n + window - 1 <= w.count[doc]
                at, n, doc = at[within], n[within], doc[within]
                doc = np.repeat(doc, n)
                pos = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = w.first[doc] + pos
                one, two = w.hashes(), w.hashes(1)
                for i in range(0, len(start), 200_000):
                    s = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(spans(one, start[s], start[s] + window).view(np.int64)),
                            pa.array(spans(two, start[s], start[s] + window).view(np.int64)),
                            b.column(0).take(pa.array(doc[s] + lo)),
                            pa.array(pos[s].astype(np.int32)),
                        ],
                        ["h1", "h2", "doc", "at"],
                    )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, start, end) word ranges covered by windows whose words also start in a document with a smaller id."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    runs = texts.mapInArrow(tidy(_runs(window)), f"symbol long, region long, doc {kind}, at int, n int")  # cheaper to make twice than to keep
    ends = runs.groupBy("symbol").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = staged(ends.where("lo < hi").select("symbol"), "symbols")
    runs = staged(runs.join(shared, "symbol", "left_semi"), "runs")
    regions = staged(runs.groupBy("symbol", "region").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "regions")
    symbols = regions.groupBy("symbol").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("symbol", F.lit(True).alias("open"))
    marked = regions.join(symbols, "symbol", "left").where("open OR n > 1").select("symbol", "region", "first", F.coalesce("open", F.lit(False)).alias("open"))
    told = staged(runs.join(marked, ["symbol", "region"]).where("doc > first OR open").select("doc", "at", "n", (F.col("doc") > F.col("first")).alias("known")), "told")
    for x in (shared, runs, regions):
        free(docs.sparkSession, x)
    open_ = told.where("NOT known").groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    windows = staged(texts.join(open_, "doc").mapInArrow(tidy(_windows(window)), f"h1 long, h2 long, doc {kind}, at int"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    found = windows.join(first, ["h1", "h2"]).where("doc > first").select("doc", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    known = told.where("known").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") + (window - 1)).alias("end"))
    return known.union(found)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the kept words."""
    gone = staged(repeated_spans(docs, id_col, text_col, window).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(gone, rows["doc_id"] == gone["doc"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            n, removed, sha, kept = [], [], [], []
            for text, cut in zip(b.column(1), b.column(2)):
                x = (text.as_py() or "").encode().split()
                n.append(len(x))
                lost = 0
                if cut.is_valid:
                    step = np.zeros(len(x) + 1, np.int64)
                    np.add.at(step, np.minimum(cut.values.field("start").to_numpy(), len(x)), 1)
                    np.add.at(step, np.minimum(cut.values.field("end").to_numpy(), len(x)), -1)
                    stays = np.cumsum(step[:-1]) == 0
                    lost = len(x) - int(stays.sum())
                    x = [x[i] for i in np.flatnonzero(stays)]
                removed.append(lost)
                out = b" ".join(x)
                sha.append(hashlib.sha256(out).hexdigest())
                if texts:
                    kept.append(out.decode())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * texts
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
