"""Quality rules and robust multivariate outliers.

Each text gets simple counts and a transformed vector of five statistics. For each language and source the minimum
covariance determinant gives a mean and a covariance that outliers cannot drag along; texts whose squared Mahalanobis
distance exceeds ``cutoff`` are rejected. That is a quantile of chi-squared; for small groups it is raised as the same
quantile of F is, with the subset's rows less the dimensions as degrees of freedom.

The estimate starts from several fits (median and absolute deviations, all rows, hashed quarters of the rows) and makes
concentration steps: distances, the h = 3/4 of the rows with the smallest ones, their mean and covariance. All groups and
starts step at once. Counts and moments are partial aggregates; parameters are one row a group, joined with a salt, so
one group may hold any share of the rows. The h-th smallest distance is found on a grid of 1/64 octaves; the subset is all
rows up to that grid value. A small ridge bounds the variances from below, as most texts have no symbol or repeated line.

Defined cases: a null text counts as empty; null languages and sources are groups of their own; texts that fail a base
rule are neither fitted nor judged; groups of fewer than ``least`` fitted rows are judged by the estimate of all rows of
their language, or else of all rows; only where even those are fewer do the base rules judge alone;
repeated rows each get their row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recompress import spans
from .store import staged, unused
from .words import SPACE, Words, blocks, mix, tidy, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIM, STARTS, SALTS = 5, ("median", "all", "q0", "q1", "q2", "q3"), 16
#: Variances that the ridge adds, in the units of the transformed vector.
RIDGE = (0.5**2, 0.05**2, 0.05**2, 0.075**2, 0.1**2)
#: Quantile 3/4 of chi-squared with five degrees of freedom (fixed value).
CHI2_75 = 6.6257
#: Its quantile 0.9999.
CUTOFF = 25.745


def text_counts(w: Words, n: int) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row of a block."""
    size = len(w.buf)
    heads = np.zeros(size + 1, np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, out=heads[1:])
    chars = np.bincount(w.doc, heads[w.end] - heads[w.start], n).astype(np.int64)
    signs = np.zeros(size + 1, np.int64)
    np.cumsum(SYMBOLS[w.buf], out=signs[1:])
    symbols = signs[w.offsets[1:]] - signs[w.offsets[:-1]]
    # lines that hold a word
    cut = np.unique(np.concatenate([w.offsets, np.flatnonzero(w.buf == 10) + 1]))
    start, end = cut[:-1], cut[1:].copy()
    end -= w.buf[end - 1] == 10
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    lines = np.bincount(doc, minlength=n)
    line = Words(w.buf, w.offsets, start, end, doc, lines, lines).hashes()
    distinct = np.unique(mix(line ^ mix(doc.astype(np.uint64) + np.uint64(1))) if len(line) else line, return_index=True)[1]
    dup = lines - np.bincount(doc[distinct], minlength=n)
    # words in three-word windows that occur twice in their text
    at = np.arange(max(0, len(w.doc) - 2))
    at = at[w.doc[at] == w.doc[at + 2]] if len(at) else at
    h = w.hashes()
    gram = mix(spans(h, at, at + 3) ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = g[1:] == g[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.doc), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    repeat = np.bincount(w.doc, covered, n).astype(np.int64)
    return w.count.astype(np.int64), chars, symbols.astype(np.int64), lines.astype(np.int64), dup.astype(np.int64), repeat


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def counts(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    rows = docs.select(*keys, F.col(text_col).alias(unused(docs.select(*keys), "whole_text")))

    def run(batches):
        for b in batches:
            out = np.zeros((len(_COUNTS), b.num_rows), np.int64)
            for lo, hi, text in blocks(b.column(len(keys))):
                out[:, lo:hi] = text_counts(words(text), hi - lo)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array(x) for x in out)], [*keys, *_COUNTS])

    schema = docs.select(*keys).schema
    for c in _COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(tidy(run), schema)


def _vector() -> list:
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(n),
        F.log(c / n),
        F.sqrt(F.col("n_symbols") / c),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _moments() -> list:
    """n, sums and products of x0.., as columns."""
    one = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
    return one + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(DIM) for j in range(i, DIM)]


_PARAMS = "group long, start string, size long, " + ", ".join(f"m{i} double" for i in range(DIM)) + ", " + ", ".join(f"p{i}{j} double" for i in range(DIM) for j in range(i, DIM)) + ", logdet double"


def _fitted(moments: DataFrame) -> DataFrame:
    """Mean, precision and log-determinant from each row of moments."""

    def run(batches):
        for b in batches:
            col = {f: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema.names)}
            n = np.maximum(col["n"].astype(float), 1)
            mean = np.stack([col[f"s{i}"] for i in range(DIM)], 1) / n[:, None]
            cov = np.zeros((len(n), DIM, DIM))
            for i in range(DIM):
                for j in range(i, DIM):
                    cov[:, i, j] = cov[:, j, i] = col[f"s{i}{j}"] / n - mean[:, i] * mean[:, j]
            cov += np.diag(RIDGE)
            value, vector = np.linalg.eigh(cov)
            value = np.maximum(value, min(RIDGE))  # rounding may leave it below the ridge
            precision = np.einsum("nik,nk,njk->nij", vector, 1 / value, vector)
            out = [col["group"], col["start"], col["size"], *mean.T, *(precision[:, i, j] for i in range(DIM) for j in range(i, DIM)), np.log(value).sum(1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    names = [x.split()[0] for x in _PARAMS.split(", ")]
    return moments.mapInArrow(tidy(run), _PARAMS)


def _distance():
    d = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            d += (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


def _grid(d):
    return F.least(F.floor(F.log2(1 + 16 * d) * 64), F.lit(1 << 14)).cast("int")


def _with(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with the parameters of their group, dealt by group and salt."""
    each = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(each, ["group", "salt"])


def _limits(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """Of each group and start, the grid value that the share of its rows reaches."""
    grid = _with(rows, params).groupBy("group", "start", "size", _grid(_distance()).alias("grid")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("group", "start").orderBy("grid").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("upto", F.sum("n").over(up)).where(F.col("upto") >= F.ceil(F.col("size") * share)).groupBy("group", "start").agg(F.min("grid").alias("limit"))


def _concentrate(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    with_limits = params.join(_limits(rows, params, share), ["group", "start"])
    inner = _with(rows, with_limits).where(_grid(_distance()) <= F.col("limit"))
    return staged(_fitted(inner.groupBy("group", "start", "size").agg(*_moments())), "mcd")


def minimum_covariance_determinant(rows: DataFrame, least: int = 40, share: float = 0.75, first: int = 3, last: int = 3) -> DataFrame:
    """rows: group, salt, x0.. -> parameters of each group of ``least`` rows or more, and limit: the grid value of its
    distances that the share of the rows reaches."""
    sizes = rows.groupBy("group").agg(
        F.count("*").alias("size"), *[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"c{i}") for i in range(DIM)]
    ).where(F.col("size") >= least)
    sizes = staged(sizes, "medians")
    centred = _with(rows, sizes).groupBy("group", "size", *[f"c{i}" for i in range(DIM)]).agg(
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 1000).alias(f"d{i}") for i in range(DIM)]
    )
    by_median = [F.col("size").alias("n")] + [(F.col("size") * F.col(f"c{i}")).alias(f"s{i}") for i in range(DIM)]
    for i in range(DIM):
        for j in range(i, DIM):
            spread = F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0)
            by_median.append((F.col("size") * (F.col(f"c{i}") * F.col(f"c{j}") + spread)).alias(f"s{i}{j}"))
    median = centred.select("group", F.lit("median").alias("start"), "size", *by_median)
    quarters = rows.join(sizes.select("group", "size"), "group", "left_semi").withColumn("start", F.explode(F.array(F.lit("all"), F.concat(F.lit("q"), F.pmod("hash", F.lit(4)).cast("string")))))
    other = quarters.groupBy("group", "start").agg(*_moments()).join(sizes.select("group", "size"), "group")
    params = staged(_fitted(median.unionByName(other.select(median.columns))), "mcd")
    for _ in range(first):
        params = _concentrate(rows, params, share)
    best = params.groupBy("group").agg(F.min_by("start", "logdet").alias("start"))
    params = staged(params.join(best, ["group", "start"], "left_semi"), "mcd")
    for _ in range(last):
        params = _concentrate(rows, params, share)
    return staged(params.join(_limits(rows, params, share), ["group", "start"]), "mcd")


def _small_sample(n):
    """Quantile 0.9999 over quantile 3/4 of F(5, 3/4 n - 5), relative to chi-squared; within 1 % from five degrees on."""
    t = 1 / F.greatest(0.75 * n - DIM, F.lit(4.0))
    return F.exp(9.774 * t + 9.87 * t * t)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, least: int = 40) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, distance (squared, null if not judged), kept."""
    key, pool, all_ = (F.xxhash64(F.lit(level), *[x for c in by[:level] for x in (F.col(c).isNull(), F.col(c).cast("string"))]) for level in (len(by), 1, 0))
    keyed = docs.select(F.col(id_col).alias("doc_id"), key.alias("group"), pool.alias("pool"), F.col(text_col).alias("text"))
    each = staged(counts(keyed, ["doc_id", "group", "pool"]), "counts").withColumn("whole", all_)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    hashed = F.xxhash64("doc_id", "n_words", "word_chars")
    each = each.withColumn("base_failed", failed).withColumn("hash", hashed).withColumn("salt", F.pmod(F.shiftright("hash", 8), F.lit(SALTS)).cast("int"))
    rows = each.select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector())])
    levels = F.explode(F.array_distinct(F.array("group", "pool", "whole"))).alias("group")
    params = minimum_covariance_determinant(rows.where("NOT base_failed").select(levels, "salt", "hash", *[f"x{i}" for i in range(DIM)]), least)
    known = rows.select("group", "pool", "whole").distinct()
    for at in ("group", "pool", "whole"):
        known = known.join(params.select(F.col("group").alias(at), F.lit(True).alias(f"has_{at}")), at, "left")
    use = F.coalesce(*[F.when(F.col(f"has_{at}"), F.col(at)) for at in ("group", "pool", "whole")])
    params = params.withColumnRenamed("group", "fitted").join(known.select("group", use.alias("use")), F.col("fitted") == F.col("use")).drop("fitted", "use")
    reached = (F.pow(2.0, F.col("limit") / 64) - 1) / 16
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("size", "fitted_rows")
    scaled = F.when(~F.col("base_failed") & F.col("limit").isNotNull(), _distance() * CHI2_75 / F.greatest(reached, F.lit(0.05)))
    out = rows.join(salted, ["group", "salt"], "left").withColumn("distance", scaled)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff * _small_sample(F.col("fitted_rows")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
