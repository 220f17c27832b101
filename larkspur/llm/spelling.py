"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

Of two words that differ by one code point, one half of the longer word is untouched. So a word is searched twice: its
right half is matched backwards from the word's end and the rest is read on to the left with one error; and the same with
both words reversed, for the left half. An index holds the words of a block with a delimiter before each and one behind
it that names direction and length. A search narrows an interval of suffix ranks: one step by a code point is a lookup of
its two ends among the ranks that this code point stands before. Errors are replaced or deleted code points of the
searched word; the insertions are the deletions seen from the other word. Of equal deletions in a run of one code point
only the last counts, so each pair is found once.

On Spark: words are counted natively. A word is dealt to blocks by a hash of direction, length and the half that all who
search it have in common, so a search meets one block of each length and direction. Blocks are of bounded size: their
number follows the code points of the vocabulary, separately for each power of two of lengths, and a group over
``GROUP`` code points is split, its searches sent to all parts. What reaches the driver is one number a power of two;
broadcast are the groups over ``GROUP``, at most (code points of the vocabulary) / ``GROUP`` of them. Forms are followed to
the last by doubling steps, each written to a table.

Defined cases: a null text has no words; a null id counts as the empty string; repeated rows count again; ties go to the
smaller word in code-point order; empty texts and tables give no rows; a text of any length is read whole, and a word of
any length is compared; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checksums import CRC, crc_sql
from .store import free, staged

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, EVERY, RATIO = 5, 3, 97, 2

#: Code points of a block's index, and of a group that is not split.
BLOCK, GROUP = 1 << 17, 1 << 20
#: Searches that go on side by side, and the longest interval that is walked rank by rank.
SIDE_BY_SIDE, NARROW = 8192, 48


def misspelt(doc_id: Column, run: Column) -> Column:
    """The lower-case run, with a code point deleted where the checksum of document and run says so."""
    low = F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = (h % F.length(low)).cast("int")
    return F.when(h % EVERY == 0, F.concat(low.substr(F.lit(1), at), low.substr(at + 2, F.length(low)))).otherwise(low)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of SHORTEST code points at least that occur LEAST times at least."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"({RUN})"), 1)).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


class Ranks:
    """FM-index of delimited words. ``text`` has 0 before each word and a symbol of its class (256 and more) behind it."""

    def __init__(self, words: list[bytes], kind: np.ndarray):
        size = np.array([len(w) for w in words], np.int64) + 2
        end = np.cumsum(size)
        self.text = np.zeros(int(end[-1]) if len(words) else 0, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[end - size] = inside[end - 1] = False
        self.text[inside] = np.frombuffer(b"".join(words), np.uint8)
        self.text[end - 1] = 256 + kind
        self.n = n = len(self.text)
        self.word = np.repeat(np.arange(len(words)), size)
        stop = np.repeat(end, size)
        rank, width, place = np.unique(self.text, return_inverse=True)[1] + 1, 1, np.arange(n)
        while width < size.max(initial=0):  # order of suffixes up to their word's end, by doubling
            on = place + width < stop
            key = rank * (n + 1)
            key[on] += rank[place[on] + width]
            rank = np.unique(key, return_inverse=True)[1] + 1
            width *= 2
        self.at = np.argsort(rank, kind="stable")
        self.first = self.text[self.at]
        self.before = np.where(self.first == 0, -1, self.text[self.at - 1])
        known = np.flatnonzero(self.before >= 0)
        self.steps = np.sort(self.before[known] * (n + 1) + known)
        self.letters = np.setdiff1d(np.unique(self.before[known]), [0])

    def of_kind(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.first, 256 + kind), np.searchsorted(self.first, 257 + kind)

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank of the suffixes at ``rank`` once ``symbol`` stands before them."""
        return np.searchsorted(self.steps, symbol * (self.n + 1) + rank)

    def near(self, query: np.ndarray, size: np.ndarray, exact: np.ndarray, kind: np.ndarray, drop: np.ndarray, mirrored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query: a row of symbols a search, size: how many, exact: how many at its end must match, kind: whom it searches,
        drop: whether one symbol is deleted, not replaced, mirrored: whether words are reversed. Pairs (query, word)."""
        who = np.arange(len(query))
        lo, hi = self.of_kind(kind)
        for t in range(int(exact.max(initial=0))):
            more = exact[who] > t
            c = query[who[more], size[who[more]] - 1 - t]
            lo[more], hi[more] = self.step(c, lo[more]), self.step(c, hi[more])
            on = lo < hi
            who, lo, hi = who[on], lo[on], hi[on]
        left, found = size[who] - exact[who], []
        while len(who):
            on = left > 0
            who, lo, hi, left = who[on], lo[on], hi[on], left[on]
            c = query[who, left - 1]
            gone = drop[who]
            beside = np.where(mirrored[who], left - 2, left)
            twin = (beside >= 0) & (beside < size[who])
            twin[twin] = query[who[twin], beside[twin]] == c[twin]
            i = np.flatnonzero(gone & ~twin)
            found.append(self._rest(query, who[i], lo[i], hi[i], left[i] - 1))
            for i, symbol, a, b in self._others(np.flatnonzero(~gone), lo, hi):
                on = symbol != c[i]
                found.append(self._rest(query, who[i[on]], a[on], b[on], left[i[on]] - 1))
            lo, hi, left = self.step(c, lo), self.step(c, hi), left - 1
            on = lo < hi
            who, lo, hi, left = who[on], lo[on], hi[on], left[on]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _others(self, i: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The intervals i one step on, by each symbol that stands before them."""
        wide = hi[i] - lo[i] > NARROW
        few, many = i[~wide], i[wide]
        n = hi[few] - lo[few]
        which = np.repeat(few, n)
        rank = np.repeat(lo[few] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        on = self.before[rank] > 0
        symbol, rank = self.before[rank[on]], rank[on]
        a = self.step(symbol, rank)
        yield which[on], symbol, a, a + 1
        for c in self.letters if len(many) else ():
            symbol = np.full(len(many), c)
            yield many, symbol, self.step(symbol, lo[many]), self.step(symbol, hi[many])

    def _rest(self, query, who, lo, hi, left) -> tuple[np.ndarray, np.ndarray]:
        """Matches what is left without an error, up to the delimiter."""
        done = []
        while True:
            on = lo < hi
            who, lo, hi, left = who[on], lo[on], hi[on], left[on]
            if not len(who):
                break
            c = np.where(left > 0, query[who, np.maximum(left - 1, 0)], 0)
            lo, hi = self.step(c, lo), self.step(c, hi)
            over = left == 0
            done.append((who[over], lo[over], hi[over]))
            who, lo, hi, left = who[~over], lo[~over], hi[~over], left[~over] - 1
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, lo, hi = (np.concatenate(x) for x in zip(*done))
        n = np.maximum(hi - lo, 0)
        rank = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(who, n), self.word[self.at[rank]]


_FOUND = "word string, n_near long, form_n long, form string"


def _block(rows: pa.Table) -> pa.Table:
    """Searches of one block. Rows: searched (else an indexed word), mirrored, m (length of the words searched), word, n."""
    word = [w.encode("latin-1") for w in rows["word"].to_pylist()]
    n, m, asks, mirrored = (rows[c].to_numpy().astype(np.int64) for c in ("n", "m", "searched", "mirrored"))
    names, number = np.unique(np.array(word or [b""]), return_inverse=True)  # in code-point order
    text = [w[::-1] if x else w for w, x in zip(word, mirrored)]
    kind = m * 2 + mirrored
    have, ask = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
    index = Ranks([text[i] for i in have], kind[have])
    pairs = []
    for at in range(0, len(ask), SIDE_BY_SIDE) if len(have) else ():
        some = ask[at : at + SIDE_BY_SIDE]
        size = np.array([len(text[i]) for i in some], np.int64)
        flat = np.zeros((len(some), int(size.max())), np.int64)
        flat[np.arange(flat.shape[1]) < size[:, None]] = np.frombuffer(b"".join(text[i] for i in some), np.uint8)
        exact = np.where(mirrored[some] == 1, size // 2, size - size // 2)
        drop = size > m[some]
        q, v = index.near(flat, size, exact, kind[some], drop, mirrored[some] == 1)
        q, v, both = some[q], have[v], drop[q]
        pairs += [(number[q], n[v], number[v]), (number[v[both]], n[q[both]], number[q[both]])]
    if not pairs:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    of, form_n, form = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((form, -form_n, of))
    of, form_n, form = of[order], form_n[order], form[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    spelt = lambda x: pa.array([w.decode("latin-1") for w in names[x]], pa.string())
    return pa.table({"word": spelt(of[first]), "n_near": pa.array(np.diff(np.append(first, len(of)))), "form_n": pa.array(form_n[first]), "form": spelt(form[first])})


def near_words(words: DataFrame) -> DataFrame:
    """word, n -> word, n_near, form_n, form: of each word that has near ones, how many, and the most frequent of them."""
    size = F.length("word")
    octave = lambda c: F.floor(F.log2(c)).cast("int")
    by_octave = {r.octave: r.letters for r in words.groupBy(octave(size).alias("octave")).agg(F.sum(size).alias("letters")).collect()}
    if not by_octave:
        return words.sparkSession.createDataFrame([], _FOUND)
    blocks = F.create_map(*[F.lit(x) for o, letters in by_octave.items() for x in (o, max(1, -(-2 * letters // BLOCK)))])
    roles = [(0, x, 0) for x in (0, 1)] + [(1, x, less) for x in (0, 1) for less in (0, 1)]
    role = F.explode(F.array(*[F.struct(F.lit(a).alias("searched"), F.lit(b).alias("mirrored"), F.lit(c).alias("less")) for a, b, c in roles]))
    rows = words.select("word", "n", role.alias("role")).select("word", "n", "role.searched", "role.mirrored", (size - F.col("role.less")).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    common = F.when(F.col("mirrored") == 1, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", size - (F.col("m") - half) + 1, F.col("m") - half))
    rows = rows.where(F.col("m") >= SHORTEST).select("*", F.xxhash64("mirrored", "m", common).alias("group"))
    hot = rows.where("searched = 0").groupBy("group").agg(F.sum("m").alias("letters")).where(F.col("letters") > GROUP)
    hot = hot.select("group", F.ceil(F.col("letters") / GROUP).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    mine = F.when(F.col("searched") == 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), parts).cast("int")))
    number = lambda part: F.pmod(F.xxhash64("group", part), F.coalesce(blocks[octave(F.col("m"))], F.lit(1)))
    rows = rows.join(F.broadcast(hot), "group", "left").select("word", "n", "searched", "mirrored", "m", F.explode(F.array_distinct(F.transform(mine, number))).alias("number"))
    rows = rows.select(F.struct(octave(F.col("m")).alias("octave"), "number").alias("block"), "word", "n", "searched", "mirrored", "m")
    found = rows.groupBy("block").applyInArrow(_block, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the first step of each word -> its last, by steps that double. No word leads back to itself."""
    links = staged(links, "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        free(links.sparkSession, links)
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = staged(word_counts(docs, id_col, text_col), "words")
    near = staged(words.join(near_words(words), "word", "left"), "near-words")
    has = F.col("form_n") >= RATIO * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    last = roots(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = rf"""
WITH RECURSIVE {CRC}, r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), h AS (SELECT run, n, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM r, crc
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), d AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word
), b AS (SELECT p.word, count(*) AS n_near, max(n) AS m, arg_min(near, {{'a': -n, 'b': encode(near)}}) AS best FROM p JOIN w ON p.near = w.word GROUP BY 1
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN best END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word
), t AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL
  UNION SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL
), e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON f.word = e.word
"""
