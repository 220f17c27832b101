"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum, over all ways to cut the marked word into pieces, of the product of their probabilities: a forward pass computes it
for all languages at once. A text's log-probability is the sum over its words, since no piece crosses white space.

The piece probabilities are fitted by expectation maximisation on a bounded sample of labelled rows (``fit_rows`` rows a
language in expectation, chosen by a hash of the id), from all their words. Each step's expected
counts come from Spark tasks; languages x pieces numbers reach the driver.

A run of over ``MOST`` characters without white space counts as words of ``MOST`` each; texts of any length are read whole.

Defined cases: null text, or text without a letter: 'und' with score 0; nothing to learn from: 'und' for all; a null id
is held in (no remainder); repeated rows and further columns make no difference.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import unused
from .words import WordRows, blocks, kept, mix, tidy, words

MARK, LONGEST = "▁", 16
#: Characters of a word; a longer run without white space, as of scripts that write none, counts as words of so many.
MOST = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def pieces(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


class Lookup:
    """Piece number of substrings by hash, in an open-addressed table."""

    BITS = 18

    def __init__(self, vocabulary: list[str]):
        codes = "".join(vocabulary)
        ends = np.cumsum([len(p) for p in vocabulary])
        h = _Codes(codes).hashes(ends - [len(p) for p in vocabulary], ends)
        self.keys, self.values, self.probes = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32), 1
        mask = (1 << self.BITS) - 1
        for v, x in enumerate(h.tolist()):
            s = x >> (64 - self.BITS)
            k = 1
            while self.values[s] >= 0:
                s, k = (s + 1) & mask, k + 1
            self.keys[s], self.values[s] = x, v
            self.probes = max(self.probes, k)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        s = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            hit = self.keys[s] == h[todo]
            value = self.values[s]
            out[todo[hit]] = value[hit]
            more = ~hit & (value >= 0)
            todo, s = todo[more], (s[more] + 1) & ((1 << self.BITS) - 1)
            if not len(todo):
                break
        return out


class _Codes:
    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes) + 1
        up, down = np.full(n, _ODD, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.total = np.zeros(n, np.uint64)
        np.cumsum(mix(self.codes.astype(np.uint64) + np.uint64(7)) * up[:-1], out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


@lru_cache(1)
def lookup(path: str) -> tuple[Lookup, int]:
    p = pieces(path)
    return Lookup(p), len(p)


def _groups(texts: list[str], table: Lookup, unknown: int):
    """Marked words in groups of alike lengths: (indexes, lengths, edges), where edges(j) gives (length, which words, which
    pieces) of the pieces that end after j characters; a character that is no piece is the unknown one."""
    marked = [MARK + t for t in texts]
    size = np.array([len(t) for t in marked])
    bounds = [0, 4, 6, 8, 10, 13, 17, 24, 33]
    while bounds[-1] < size.max(initial=0):
        bounds.append(bounds[-1] * 2)
    for lo, hi in zip(bounds, bounds[1:]):
        of = np.flatnonzero((size > lo) & (size <= hi))
        step = max(1, 200_000 // hi)
        for k in range(0, len(of), step):
            part = of[k : k + step]
            yield part, size[part], _edges([marked[i] for i in part], size[part], table, unknown)


def _edges(marked: list[str], size: np.ndarray, table: Lookup, unknown: int):
    codes = _Codes("".join(marked))
    start = np.cumsum(size) - size
    place = np.arange(1, int(size.sum()) + 1) - np.repeat(start, size)  # characters of the word up to this one
    ends = np.arange(1, len(place) + 1)
    found = np.full((LONGEST, len(place)), -1, np.int32)
    some = np.zeros((int(size.max()) + 1, LONGEST), bool)
    for n in range(1, LONGEST + 1):
        on = np.flatnonzero(place >= n)
        found[n - 1, on] = table(codes.hashes(ends[on] - n, ends[on]))
        if n == 1:
            found[0][found[0] < 0] = unknown
        some[place[found[n - 1] >= 0], n - 1] = True

    def edges(j: int):
        live = np.flatnonzero(size >= j)
        at = start[live] + (j - 1)
        for n in np.flatnonzero(some[j]).tolist():
            e = found[n, at]
            hit = e >= 0
            yield n + 1, live[hit], e[hit]

    return edges


def _parts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of MOST characters at most, and the text that each is of. All parts go side by side, so the steps of a pass are
    bounded whatever the length of a text."""
    parts = [[t[i : i + MOST] for i in range(0, max(len(t), 1), MOST)] for t in texts]
    return [x for part in parts for x in part], np.repeat(np.arange(len(texts)), [len(x) for x in parts])


def log_words(texts: list[str], table: Lookup, p: np.ndarray) -> np.ndarray:
    """p: languages x (pieces + 1), the last for a character that is no piece. Log-probability of each word in each."""
    parts, owner = _parts(texts)
    if len(parts) > len(texts):
        whole = np.zeros((len(texts), len(p)))
        np.add.at(whole, owner, log_words(parts, table, p))
        return whole
    out = np.zeros((len(texts), len(p)))
    q = np.ascontiguousarray(p.T)
    unknown = q.shape[0] - 1
    for part, size, edges in _groups(texts, table, unknown):
        ring = np.zeros((LONGEST, len(part), len(p)))
        ring[0] = 1
        scale = np.zeros((len(part), len(p)))
        for j in range(1, int(size.max()) + 1):
            now = np.zeros((len(part), len(p)))
            for n, on, e in edges(j):
                now[on] += ring[(j - n) % LONGEST][on] * q[e]
            ring[j % LONGEST] = now
            done = np.flatnonzero(size == j)
            out[part[done]] = np.log(now[done]) + scale[done]
            if j % 8 == 0:  # keeps long words within the floating range
                scale += _rescaled(ring)
    return out


def expected(texts: list[str], counts: np.ndarray, table: Lookup, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with counts (words x languages), by a forward and a backward pass. Both are scaled
    every few characters, so words may be of any length."""
    parts, owner = _parts(texts)
    if len(parts) > len(texts):
        return expected(parts, counts[owner], table, p)
    total = np.zeros_like(p.T)
    q = np.ascontiguousarray(p.T)
    unknown, slots = q.shape[0] - 1, LONGEST + 1
    for part, size, edges in _groups(texts, table, unknown):
        top, shape = int(size.max()), (len(part), len(p))
        c = counts[part]
        forward, scales, scale = np.zeros((top + 1, *shape)), np.zeros((top // 8 + 1, *shape)), np.zeros(shape)
        ring = np.zeros((slots, *shape))
        ring[0] = forward[0] = 1
        for j in range(1, top + 1):
            now = np.zeros(shape)
            for n, on, e in edges(j):
                now[on] += ring[(j - n) % slots][on] * q[e]
            ring[j % slots] = forward[j] = now
            if j % 8 == 0:
                scale = scale + _rescaled(ring)
                scales[j // 8] = scale
        ends = np.arange(len(part))
        whole = np.log(np.maximum(forward[size, ends], 1e-300)) + scales[(size - 1) // 8, ends]
        ring, back = np.zeros((slots, *shape)), np.zeros(shape)
        for j in range(top, 0, -1):
            ring[j % slots][size == j] = 1
            now = ring[j % slots].copy()
            for n, on, e in edges(j):
                i = j - n
                step = now[on] * q[e]
                ring[i % slots][on] += step
                share = np.exp(np.minimum(scales[max(i - 1, 0) // 8, on] + back[on] - whole[on], 700))
                np.add.at(total, e, forward[i, on] * step * share * c[on])
            ring[j % slots] = 0
            if j % 8 == 0:
                back = back + _rescaled(ring)
    return total.T


def _rescaled(ring: np.ndarray) -> np.ndarray:
    """Divides the ring by its largest values in place; their logs."""
    top = ring.max(0)
    top[top <= 0] = 1
    ring /= top
    return np.log(top)


class LanguageModel:
    """names: languages; p: piece probabilities; prior: log share of each language among the labelled rows."""

    def __init__(self, names: list[str], p: np.ndarray, prior: np.ndarray, path: str):
        self.names, self.p, self.prior, self.path, self.key = names, p, prior, path, uuid.uuid4().hex

    @classmethod
    def fit(cls, labelled: DataFrame, path: str | None = None, fit_rows: int = 1500, steps: int = 3) -> LanguageModel:
        """labelled: doc_id, text, lang."""
        path = path or default_vocabulary()
        sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        names = sorted(sizes)
        if not names:
            return cls([], np.zeros((0, 1)), np.zeros(0), path)
        unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, fit_rows / sizes[n]))])
        sample = labelled.where(unit < share[F.col("lang")])
        each = sample.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
        table = each.groupBy("word").pivot("lang", names).count().na.fill(0).toDF("word", *[f"n{i}" for i in range(len(names))])
        table = table.persist()
        n = lookup(path)[1]
        p = np.full((len(names), n + 1), 1 / (n + 1))
        for _ in range(steps):
            got = table.mapInArrow(tidy(_e_step(p, path)), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
            total = np.full_like(p, 0.05)
            total[got["lang"].to_numpy(), got["piece"].to_numpy()] += got["n"].to_numpy()
            p = total / total.sum(1, keepdims=True)
        table.unpersist()
        prior = np.log([sizes[x] for x in names]) - np.log(sum(sizes.values()))
        return cls(names, p, prior, path)

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """One row per document: the id, the columns in keep, lang_pred and score (posterior of the language) under the
        given names, which must not be among the others."""
        spark = docs.sparkSession
        first = docs.select(id_col, *keep)
        rows = docs.select(*first.columns, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(unused(first, "letters")), F.col(text_col).alias(unused(first, "whole_text")))
        schema = T.StructType([*first.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
        model = spark.sparkContext.broadcast((self.names, self.p, self.prior, self.path, self.key))  # languages x 32,000 numbers
        return rows.mapInArrow(tidy(_predict(model, first.columns, schema)), schema)


def _e_step(p: np.ndarray, path: str):
    def run(batches):
        table = lookup(path)[0]
        total = np.zeros_like(p)
        for b in batches:
            if b.num_rows:
                counts = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(p))], 1).astype(float)
                total += expected(b.column(0).to_pylist(), counts, table, p)
        lang, piece = np.nonzero(total > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], ["lang", "piece", "n"])

    return run


def _predict(model, columns: list[str], schema):
    def run(batches):
        names, p, prior, path, key = model.value

        def make():
            scores: list[np.ndarray] = []
            table = lookup(path)[0] if names else None

            def keep(rows):
                scores[:] = [np.concatenate(scores)[rows]]

            return WordRows(lambda new: scores.append(log_words(new, table, p)), keep), scores

        number, scores = kept(("language", key), make)
        for b in batches:
            letters = b.column(len(columns)).to_numpy(zero_copy_only=False)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for lo, hi, text in blocks(b.column(len(columns) + 1)):
                w = words(text)
                if not names or not len(w.start):
                    continue
                row = number(w)
                if len(scores) > 1:
                    scores[:] = [np.concatenate(scores)]
                each = scores[0][row]
                total = np.stack([np.bincount(w.doc, each[:, g], hi - lo) for g in range(len(names))], 1) + prior
                total -= total.max(1, keepdims=True)
                e = np.exp(total)
                best = e.argmax(1)
                ok = letters[lo:hi].astype(bool)
                lang[lo:hi][ok] = np.array(names, object)[best[ok]]
                score[lo:hi][ok] = (1 / e.sum(1))[ok]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return run


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the fifth that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = LanguageModel.fit(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return model.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), keep=("held_out",))
