"""Language-model scores by masked pseudo-likelihood.

A network of one hidden layer predicts each word of a text from ``SIDE`` words on both sides; the text's score is the sum
of the log-probabilities of all its words. The network knows the ``vocabulary`` most frequent words of the corpus, and all
others by one of ``GROUPS`` symbols, which a hash of the word names: so it predicts them from both sides too, and sees them
beside a word. Its output is a two-level softmax over classes, of words of like frequency or of such symbols. A word behind
a symbol also has its own probability among the words of that symbol: its count over all documents. What is gathered from
the corpus (a count for each distinct word) grows with it.

Counting merges in each task first, then by word. Counts of up to ``OFTEN`` words, a frequency bound chosen so that they are
no more, are broadcast; all other words are joined with theirs. Training is numpy in Spark tasks: each task makes one pass
of Adagrad over all positions of its partition (one in ``every``, chosen by a hash, if the caller asks for less) from
common weights, in batches that grow with what it has seen, so that a small partition makes many steps too; the weights
are averaged by number of positions, in two groupings, and the next round starts from them. Only the vocabulary, those
counts and one set of weights, all of bounded size, reach the driver. A word outside the vocabulary is less than one word
in its size, so no key of the join is hot.

Defined cases: a null text, or one without a word, has 0 words and score 0; repeated rows each get their row; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import staged
from .words import blocks, mix, tidy, words

SIDE, WIDTH, CLASSES, PART = 2, 24, 64, 8192
#: Least and largest batch of a step.
FIRST_BATCH, BATCH = 256, 8192
#: Symbols of the words outside the vocabulary, and words whose counts are broadcast at most.
GROUPS, OFTEN = 1024, 1_000_000
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


class Net:
    """Weights for a vocabulary of CLASSES * CLASSES words at most; the id after the last stands for a missing neighbour."""

    SHAPES = {
        "embed": (CLASSES * CLASSES + 1, len(_OFFSETS), WIDTH),
        "bias": (WIDTH,),
        "group": (WIDTH, CLASSES),
        "group_bias": (CLASSES,),
        "word": (CLASSES, WIDTH, CLASSES),
        "word_bias": (CLASSES, CLASSES),
    }

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.wide = self.embed.reshape(len(self.embed), -1)

    @classmethod
    def size(cls) -> int:
        return sum(map(math.prod, cls.SHAPES.values()))

    @classmethod
    def start(cls) -> np.ndarray:
        return np.random.default_rng(7).normal(0, 0.1, cls.size()).astype(np.float32)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = self.bias + self.embed[near[:, 0], 0]
        for k in range(1, len(_OFFSETS)):
            h += self.embed[near[:, k], k]
        return np.maximum(h, 0, out=h)

    def hidden_of(self, ids: np.ndarray) -> np.ndarray:
        """The same for each id of a text but the SIDE first and last, with the ids beside it."""
        n, e = len(ids) - 2 * SIDE, self.wide[ids]
        h = self.bias + e[SIDE + _OFFSETS[0] : SIDE + _OFFSETS[0] + n, :WIDTH]
        for k, o in enumerate(_OFFSETS[1:], 1):
            h += e[SIDE + o : SIDE + o + n, k * WIDTH : (k + 1) * WIDTH]
        return np.maximum(h, 0, out=h)

    def log_prob(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.log_prob_of(self.hidden(near), target)

    def log_prob_of(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, cuts = _by_group(target)
        h, target, out = h[order], target[order], np.empty(len(target), np.float64)
        each = _log_of(h @ self.group + self.group_bias, target // CLASSES)
        for c in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[c], cuts[c + 1])
            each[rows] += _log_of(h[rows] @ self.word[c] + self.word_bias[c], target[rows] % CLASSES)
        out[order] = each
        return out

    def _learn_outputs(self, h: np.ndarray, target: np.ndarray, past: Net, rate: float) -> np.ndarray:
        """One Adagrad step of the output weights; returns the gradient by the hidden values before their cut at 0."""
        n = len(target)
        order, cuts = _by_group(target)
        h, target = h[order], target[order]
        p = _softmax(h @ self.group + self.group_bias)
        p[np.arange(n), target // CLASSES] -= 1
        dh = p @ self.group.T
        _adagrad(self.group, past.group, h.T @ p / n, rate)
        _adagrad(self.group_bias, past.group_bias, p.mean(0), rate)
        for c in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[c], cuts[c + 1])
            mine = h[rows]
            q = _softmax(mine @ self.word[c] + self.word_bias[c])
            q[np.arange(len(q)), target[rows] % CLASSES] -= 1
            dh[rows] += q @ self.word[c].T
            _adagrad(self.word[c], past.word[c], mine.T @ q / n, rate)
            _adagrad(self.word_bias[c], past.word_bias[c], q.sum(0) / n, rate)
        dh *= h > 0
        out = np.empty_like(dh)
        out[order] = dh
        return out

    def step(self, near: np.ndarray, target: np.ndarray, past: Net, rate: float) -> None:
        """One Adagrad step; past holds the sums of squared gradients."""
        dh = self._learn_outputs(self.hidden(near), target, past, rate)
        _adagrad(self.bias, past.bias, dh.mean(0), rate)
        dh /= len(target)
        for k in range(len(_OFFSETS)):
            order = np.argsort(near[:, k], kind="stable")
            ids = near[order, k]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            g, ids = np.add.reduceat(dh[order], first, axis=0), ids[first]
            past.embed[ids, k] += g * g
            self.embed[ids, k] -= rate * g / (np.sqrt(past.embed[ids, k]) + 1e-6)

    def step_of(self, ids: np.ndarray, on: np.ndarray, past: Net, rate: float) -> None:
        """The same for the places ``on`` of a text's ids: neighbours are read and taught as shifts of one matrix."""
        h = self.hidden_of(ids)
        n = len(on)
        dh = self._learn_outputs(h[on], ids[SIDE + on], past, rate)
        _adagrad(self.bias, past.bias, dh.mean(0), rate)
        by_place = np.zeros((WIDTH, n_all := len(h)))
        by_place[:, on] = dh.T / n
        g = np.empty((len(_OFFSETS) * WIDTH, len(self.wide)))
        for k, o in enumerate(_OFFSETS):
            beside = ids[SIDE + o : SIDE + o + n_all]
            for j in range(WIDTH):
                g[k * WIDTH + j] = np.bincount(beside, by_place[j], len(self.wide))
        _adagrad(self.wide, past.wide, np.ascontiguousarray(g.T, np.float32), rate)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their class, and where each class begins."""
    group = (target // CLASSES).astype(np.uint8)
    return np.argsort(group, kind="stable"), np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_of(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of x at one place of each row."""
    x -= x.max(1, keepdims=True)
    out = x[np.arange(len(x)), which]
    return out - np.log(np.exp(x, out=x).sum(1))


def _adagrad(w: np.ndarray, past: np.ndarray, g: np.ndarray, rate: float) -> None:
    past += g * g
    w -= rate * g / (np.sqrt(past) + 1e-6)


def _ids(w, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hashes and ids of its words; and all its texts as one, with SIDE missing words around each, and the
    place of each word there."""
    h = w.hashes()
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    group = (h % np.uint64(GROUPS)).astype(np.int64)
    own = np.where(known[at] == h, ids[at], group) if len(known) else group
    place = np.arange(len(h)) + (w.doc + 1) * SIDE
    text = np.full(len(h) + (len(w.count) + 1) * SIDE, CLASSES * CLASSES, np.int64)
    text[place] = own
    return h, own, text, place


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word hash, n) over all documents."""

    def run(batches):
        parts, size = [], 0

        def merged():
            keys, back = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([m for _, m in parts] or [np.zeros(0)]), len(keys)).astype(np.int64)

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

        for b in batches:
            for _, _, text in blocks(b.column(0)):
                parts.append(np.unique(words(text).hashes(), return_counts=True))
                size += len(parts[-1][0])
                if size > 1_000_000:
                    parts, size = [merged()], 0
                    if len(parts[0][0]) > 500_000:
                        yield rows(*parts.pop())
        yield rows(*merged())

    return docs.select(text_col).mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class MaskedModel:
    """known, ids: hashes of the vocabulary, sorted, and their ids; flat: the weights; counts: (word, n) of all words; rare:
    how many of the corpus' words are outside the vocabulary."""

    def __init__(self, known: np.ndarray, ids: np.ndarray, flat: np.ndarray, counts: DataFrame, rare: int):
        self.known, self.ids, self.flat, self.counts, self.rare = known, ids, flat, counts, rare

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", vocabulary: int = CLASSES * CLASSES - GROUPS, every: int = 1, rounds: int = 1, rate: float = 0.1) -> MaskedModel:
        spark = docs.sparkSession
        counts = staged(word_counts(docs, text_col), "word-counts")
        top = counts.orderBy(F.desc("n"), "word").limit(min(vocabulary, CLASSES * CLASSES - GROUPS)).select("word", "n").toArrow()
        rare = (counts.agg(F.sum("n")).head()[0] or 0) - sum(top["n"].to_pylist())
        known = top["word"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, ids = known[order], order + GROUPS
        flat = Net.start()
        for r in range(rounds):
            shared = spark.sparkContext.broadcast((known, ids, flat))
            trained = docs.select(text_col).mapInArrow(tidy(_train(shared, every, r, rate)), "salt int, part int, weight double, values array<float>")
            once = trained.groupBy("salt", "part").applyInArrow(_averaged, "salt int, part int, weight double, values array<float>")
            whole = once.withColumn("salt", F.lit(0)).groupBy("salt", "part").applyInArrow(_averaged, "salt int, part int, weight double, values array<float>")
            got = whole.orderBy("part").select("values").toArrow().column(0).combine_chunks()
            if len(got):
                flat = got.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        return cls(known, ids, flat, counts, rare)

    def _often(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, sorted, and logarithms of the counts of the words above the least frequency that leaves OFTEN at most."""
        step = F.floor(F.log2("n") * 8)
        sizes = sorted(((r.step, r.m) for r in self.counts.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()), reverse=True)  # few hundred steps
        bound, total = None, 0
        for at, m in sizes:
            total += m
            if total > OFTEN:
                break
            bound = at
        got = self.counts.where(step >= bound if bound is not None else F.lit(False)).toArrow()
        word = got["word"].to_numpy().view(np.uint64)
        order = np.argsort(word)
        return word[order], np.log(got["n"].to_numpy()[order].astype(np.float64))

    def _totals(self) -> np.ndarray:
        """Of each symbol, the logarithm of how many of the corpus' words stand behind it."""
        by_group = np.zeros(GROUPS)
        group = F.col("word").bitwiseAND(GROUPS - 1)
        known = self.counts.sparkSession.createDataFrame(pa.table({"word": pa.array(self.known.view(np.int64))})) if len(self.known) else None
        rare = self.counts.join(F.broadcast(known), "word", "left_anti") if known is not None else self.counts  # the vocabulary's size is fixed
        for r in rare.groupBy(group.alias("group")).agg(F.sum("n").alias("n")).collect():
            by_group[r.group] = r.n
        return np.log(np.maximum(by_group, 1))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, log_likelihood (sum over the words), mean_log_likelihood (null without words)."""
        shared = docs.sparkSession.sparkContext.broadcast((self.known, self.ids, self.flat, self._totals(), *self._often()))  # 18 MB at most
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches):
            known, ids, flat, totals, often, logs = shared.value
            net = Net(flat)
            for b in batches:
                for lo, hi, text in blocks(b.column(1)):
                    w = words(text)
                    h, target, whole, place = _ids(w, known, ids)
                    each = np.zeros(len(target))
                    for i in range(0, len(target), 32768):
                        on = place[i : i + 32768] - place[i]
                        each[i : i + 32768] = net.log_prob_of(net.hidden_of(whole[place[i] - SIDE : place[i] + on[-1] + SIDE + 1])[on], target[i : i + 32768])
                    behind = np.flatnonzero(target < GROUPS)
                    each[behind] -= totals[target[behind]]
                    if len(often):
                        at = np.minimum(np.searchsorted(often, h[behind]), len(often) - 1)
                        told = often[at] == h[behind]
                        each[behind[told]] += logs[at[told]]
                        behind = behind[~told]
                    ends = np.append(0, np.cumsum(np.bincount(w.doc[behind], minlength=hi - lo))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[behind].view(np.int64)))
                    columns = [b.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(np.bincount(w.doc, each, hi - lo)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "rare"])

        rows = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, base double, rare array<long>")
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
        words_of = rows.select("row", F.explode("rare").alias("word"))
        own = words_of.join(self.counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("logs"))
        total = F.col("base") + F.coalesce("logs", F.lit(0.0))
        whole = rows.drop("rare").join(own, "row", "left")
        return whole.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))


def _train(shared, every: int, turn: int, rate: float):
    def run(batches):
        known, ids, flat = shared.value
        net, past, seen, first = Net(flat.copy()), Net(np.zeros_like(flat)), 0, 0
        for b in batches:
            for _, _, text in blocks(b.column(0)):
                w = words(text)
                h, _, whole, place = _ids(w, known, ids)
                if every > 1:
                    mark = mix(h + np.arange(len(h), dtype=np.uint64) - w.first[w.doc].astype(np.uint64) + np.uint64(turn << 40))
                    place = place[mark % np.uint64(every) == 0]
                first = first or int(h[0] % np.uint64(1 << 30)) if len(h) else first
                while len(place):
                    size = min(BATCH, max(FIRST_BATCH, seen // 8))
                    at, place = place[:size], place[size:]
                    net.step_of(whole[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0], past, rate)
                    seen += len(at)
        if seen:
            n = -(-len(flat) // PART)
            ends = np.minimum(np.arange(n + 1) * PART, len(flat)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(net.flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, first % 64, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, float(seen))), values], ["salt", "part", "weight", "values"]
            )

    return run


def _averaged(table: pa.Table) -> pa.Table:
    weight = table["weight"].to_numpy()
    values = np.stack([np.asarray(x.values) for x in table["values"]])
    mean = (values * (weight / weight.sum())[:, None]).sum(0).astype(np.float32)
    return pa.table(
        {"salt": table["salt"].slice(0, 1), "part": table["part"].slice(0, 1), "weight": pa.array([weight.sum()]), "values": pa.array([mean], pa.list_(pa.float32()))}
    )


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return MaskedModel.fit(docs).score(docs)
