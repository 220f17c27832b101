"""Near-duplicate documents by DartMinHash over five-word shingles.

Signatures: darts fall on the region (shingle, weight interval) as a Poisson process whose arrivals are hashes of the
shingle, so equal regions get equal darts in every document. A document keeps, for each of ``coordinates`` coordinates,
its earliest dart below the shingle's weight (how often the document has it). Two documents agree in a coordinate with a
probability that is their weighted Jaccard similarity. Only darts before a time threshold are thrown; documents that
still lack a coordinate are thrown again with twice the time.

Candidates: ``rows`` coordinates make a band. Documents with equal word sequences count as one. Members of a bucket are
ordered by how many other members they meet in all their buckets, so that originals come before their copies. A bucket of
at most ``small`` members compares all of different classes. A larger one compares its first member, the leader, with the
members of other classes: a group of copies is one class after a round or two, at one comparison a member, however large
it is. The leader leaves, and buckets whose members are in one class are done. What is still open and large after
``refine_after`` rounds (mostly documents that share a passage but are not alike) is dealt anew by shingles: with all shingles
in one order, those rare among these documents first, two sets as alike as asked for share one of the first n - ceil(0.8 n) + 1
of each. So every such pair of the open buckets meets again, whatever its coordinates (shingles that only one class has are
not dealt); a pair at 0.8 shares a bucket of the first deal with probability 0.99995. After ``refine_after`` rounds more, leaders grow fourfold each round, up to ``LEADERS``,
until no bucket is open; that is quadratic in a group of variants of one text that are a little less alike than asked for.
Pairs in one class, and pairs that their numbers of shingles, or of those left after the one that they share, rule out, are
not compared. Only ``exhaustive=False`` stops before; no query or stage does.

All comparisons are exact: weighted Jaccard of the shingle multisets, from the texts. The set of a document that very many
pairs name is copied to as many parts as they need, so no task takes all members of a hub.

Defined cases: a document without words (null, empty) or with a null id is a class of its own; one of 1 to 4 words has
one shingle, its whole word sequence; rows that repeat an id are one document; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recompress import spans
from .store import free, staged, unused
from .words import blocks, kept, mix, tidy, words

SHINGLE = 5
#: Counters of shingles, for an order that puts rare ones first; any order gives the same classes.
SLOTS = 1 << 20
#: Rows in which a task hands on what it counted.
RANGES = 64
#: Most leaders of a bucket in one round: up to so many, Spark picks them before it deals the members out.
LEADERS = 1000
#: Pairs of one document that meet in one task, and documents with more whose names are broadcast at most (16 bytes each).
CROWD, FEW = 256, 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(h: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle occurrence of a block."""
    n = np.where(w.count >= SHINGLE, w.count - SHINGLE + 1, np.minimum(w.count, 1))
    row = np.repeat(np.arange(len(n)), n)
    start = np.repeat(w.first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, spans(h, start, start + np.minimum(w.count[row], SHINGLE))


def weighted(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and how often each occurs."""
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, t: int) -> np.ndarray:
    """Signatures (n x t) of n weighted sets given as (row, element, weight >= 1); 0 where a row has no element."""
    # regions of an element: weights [0, 1), [1, 2), [2, 4), [4, 8), ..
    parts = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    region = np.repeat(np.arange(len(row)), parts)
    part = np.arange(len(region)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part > 0, 2.0 ** (part - 1), 0.0)
    width = np.maximum(low, 1.0)
    seed = mix(element[region] ^ mix(part.astype(np.uint64) + np.uint64(1)))
    owner, below = row[region], (weight[region] - low) / width
    total = np.bincount(row, weight, n)
    best, ident = np.full(n * t, np.inf), np.zeros(n * t, np.uint64)
    limit = (np.log(t) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        on = np.flatnonzero(todo[owner])
        time, step = np.zeros(len(on)), seed[on]
        while len(on):
            step = step + _STEP
            x = mix(step)
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (t * width[on])
            early = time <= limit[owner[on]]
            on, time, step, x = on[early], time[early], step[early], x[early]
            y = mix(x ^ _ODD)
            hit = ((y >> np.uint64(40)).astype(np.float64) * 2.0**-24) < below[on]
            slot = owner[on[hit]] * t + (y[hit] % np.uint64(t)).astype(np.int64)
            np.minimum.at(best, slot, time[hit])
            won = best[slot] == time[hit]
            ident[slot[won]] = x[hit][won]
        todo &= np.isinf(best.reshape(n, t)).any(1)
        limit = np.where(todo, limit * 2, limit)
    return ident.reshape(n, t)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, n_words, c1 and c2 (hash of the word sequence), bands (a hash of each)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        kept(None)
        for b in batches:
            c1, c2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            count = np.zeros(b.num_rows, np.int64)
            out = np.zeros((b.num_rows, bands), np.uint64)
            for lo, hi, text in blocks(b.column(1)):
                w = words(text)
                h = w.hashes()
                count[lo:hi] = w.count
                c1[lo:hi] = spans(h, w.first, w.first + w.count).view(np.int64)
                c2[lo:hi] = spans(w.hashes(1), w.first, w.first + w.count).view(np.int64)
                sig = dart_minhash(*weighted(*shingles(h, w)), hi - lo, bands * rows)
                for k in range(bands):
                    x = np.full(hi - lo, k + 1, np.uint64)
                    for r in range(rows):
                        x = mix(x * _ODD + sig[:, k * rows + r])
                    out[lo:hi, k] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.array(c1), pa.array(c2), _lists(out.view(np.int64))], ["doc_id", "n_words", "c1", "c2", "bands"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, c1 long, c2 long, bands array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """doc, set: hashes of (shingle, number of the occurrence), so that sets compare as multisets."""

    def run(batches):
        for b in batches:
            for lo, hi, text in blocks(b.column(1)):
                w = words(text)
                row, shingle, weight = weighted(*shingles(w.hashes(), w))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                values = mix(np.repeat(shingle, weight) + nth.astype(np.uint64) * _STEP)
                ends = np.append(0, np.cumsum(np.bincount(np.repeat(row, weight), minlength=hi - lo)))
                for i in range(0, hi - lo, 500):
                    j = min(hi - lo, i + 500)
                    lists = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.array(values[ends[i] : ends[j]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo + i, j - i), lists], ["doc", "set"])

    return docs.mapInArrow(tidy(run), f"doc {docs.schema['doc'].dataType.simpleString()}, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root), root the smallest node that edges lead to. Each node takes its smallest neighbour, if smaller, and
    the chains are followed to their ends; edges then lead from end to end, and those within one are done."""
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        new = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
        while True:
            jump = new.select(F.col("node").alias("at"), F.col("root").alias("next"))
            far = staged(new.join(jump, new["root"] == jump["at"]).select("node", F.col("next").alias("root"), F.col("root").alias("was")), "labels")
            new = far.select("node", "root")
            if far.where("root <> was").isEmpty():
                break
        edges = staged(_between(edges, new).distinct(), "edges")
        labels = new if labels is None else staged(_relabelled(labels, new), "labels")
    return labels


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) as those between the roots of their ends, without those that lead to their own."""
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias("at"), F.col("root").alias("end"))
        edges = edges.join(to, edges[end] == to["at"], "left").withColumn(end, F.coalesce("end", end)).select("a", "b")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels whose roots have got a root in ``new``."""
    to = new.select(F.col("node").alias("at"), F.col("root").alias("end"))
    return labels.join(to, labels["root"] == to["at"], "left").select("node", F.coalesce("end", "root").alias("root"))


def _joined(klass: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes (node, root) with further links: only what these join is gone through, not the links before."""
    if klass is None:
        return components(links)
    new = components(_between(links, klass))
    first = new.select("node", F.col("node").alias("root")).join(klass.select("node"), "node", "left_anti")
    return staged(_relabelled(klass.union(first), new), "classes")


def near_dup_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 25, rows: int = 5, small: int = 16, refine_after: int = 3, exhaustive: bool = True
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), kept (whether it is that one), links (to
    documents of other texts that were compared and found at or above the similarity), n_words."""
    spark = docs.sparkSession
    sig = staged(signatures(docs, id_col, text_col, bands, rows), "signatures")
    real = sig.where("n_words > 0 AND doc_id IS NOT NULL")
    texts = staged(real.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "texts")
    reps = real.join(texts.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    size = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    dealt = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("doc"), size.alias("size"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(shared, "bucket").groupBy("doc").agg(F.sum("n").alias("hub"), F.first("size").alias("size"), F.collect_list(F.struct("bucket", F.col("size").alias("rest"))).alias("deals"))
    members = staged(dealt, "members")
    hubs = staged(members.select("doc", "hub", "size"), "hubs")
    picked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sets = staged(_shingle_sets(picked.join(hubs, "doc", "left_semi")).dropDuplicates(["doc"]), "shingles")

    klass, links, tested, rounds = None, None, None, 0
    while True:
        rounds += 1
        if klass is None:
            known = members.withColumn("class", F.col("doc"))
        else:  # a row a document, not one a bucket
            known = staged(members.join(klass, members["doc"] == klass["node"], "left").select("doc", "hub", "size", "deals", F.coalesce("root", "doc").alias("class")), "classed")
        now = known.select("doc", "hub", "size", "class", F.explode("deals").alias("deal")).select("deal.bucket", "doc", "hub", "size", "deal.rest", "class")
        spread = now.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"), F.min(F.struct((-F.col("hub")).alias("h"), "doc", "class", "size", "rest")).alias("lead"))
        open_ = staged(now.join(spread.where("lo < hi").select("bucket", "n", "lead"), "bucket"), "open")
        led = open_.where((F.col("n") > small) & (F.col("doc") != F.col("lead.doc")))
        pairs = led.where((F.col("class") != F.col("lead.class")) & _may("lead.size", "lead.rest", similarity)).select("doc", F.col("lead.doc").alias("leader"))
        few = open_.where(F.col("n") <= small).select("bucket", "doc", "class", "size", "rest")
        other = few.select("bucket", F.col("doc").alias("leader"), F.col("class").alias("theirs"), F.col("size").alias("its"), F.col("rest").alias("their_rest"))
        pairs = pairs.union(few.join(other, "bucket").where(F.expr("class <> theirs AND doc > leader") & _may("its", "their_rest", similarity)).select("doc", "leader"))
        most = min(LEADERS, 4 ** (rounds - 2 * refine_after)) if rounds > 2 * refine_after else 0
        if most:
            order = Window.partitionBy("bucket").orderBy(F.desc("hub"), "doc")
            more = led.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("bucket", F.col("doc").alias("leader"), F.col("class").alias("theirs"), F.col("size").alias("its"), F.col("rest").alias("their_rest"))
            pairs = pairs.union(led.join(more, "bucket").where((F.col("class") != F.col("theirs")) & _may("its", "their_rest", similarity)).select("doc", "leader"))
            led = led.join(more.select("bucket", F.col("leader").alias("doc")), ["bucket", "doc"], "left_anti")
        pairs = pairs.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        found = staged(_similar(pairs, sets), "found")
        new = found.where(F.col("similarity") >= similarity).select("a", "b")
        tested = found.select("a", "b") if tested is None else tested.union(found.select("a", "b"))
        links = new if links is None else links.union(new)
        if rounds == refine_after:
            left = staged(_refined(led, sets, similarity), "fine")
            more = left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
            again = left.join(more, "bucket", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("bucket", "rest")).alias("deals")).join(hubs, "doc")
        else:
            again = led.groupBy("doc", "hub", "size").agg(F.collect_list(F.struct("bucket", "rest")).alias("deals"))
        again = staged(again.select("doc", "hub", "size", "deals"), "members")
        free(spark, open_)
        free(spark, members)
        members = again
        if not new.isEmpty():
            klass = _joined(klass, new)
        if members.isEmpty() or (rounds == 2 * refine_after and not exhaustive):
            break
    degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("links"))
    of_text = texts.join(klass, texts["rep"] == klass["node"], "left") if klass is not None else texts.withColumn("root", F.col("rep"))
    of_text = of_text.join(degree, of_text["rep"] == degree["doc"], "left")
    of_text = of_text.select("c1", "c2", F.coalesce("root", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.lit(True).alias("has"))
    out = sig.select("doc_id", "n_words", "c1", "c2").join(of_text, ["c1", "c2"], "left")
    own = F.when(F.col("has") & (F.col("n_words") > 0) & F.col("doc_id").isNotNull(), F.col("class")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_words", own.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "links", "n_words")


def _may(size: str, rest: str, similarity: float):
    """Whether a document and the one with these columns can be so alike, if the bucket's shingle is their first common one:
    they have at most the lesser ``rest`` in common."""
    return F.least("rest", rest) * (1 + similarity) >= similarity * (F.col("size") + F.col(size)) - 1e-6


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity. A document that more than CROWD pairs name (the leader of a large bucket) meets them in parts."""
    pairs = staged(pairs, "pairs")
    crowded = {}
    for side in ("a", "b"):
        many = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
        many = staged(many.select(side, F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowded")
        crowded[side] = F.broadcast(many) if many.count() <= FEW else many
    met = pairs
    for side, other in (("a", "b"), ("b", "a")):
        parts = F.coalesce("parts", F.lit(1))
        mine = sets.select(F.col("doc").alias(side), F.col("set").alias(f"s{side}")).join(crowded[side], side, "left")
        mine = mine.select(side, f"s{side}", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        met = met.join(crowded[side], side, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts").join(mine, [side, "part"]).drop("part")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))


def _ranges(at: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Slots (ascending) and what was counted for them, a row for each range of slots that has any."""
    ends = np.searchsorted(at, np.arange(RANGES + 1) * (SLOTS // RANGES))
    there = np.flatnonzero(np.diff(ends))
    offsets = pa.array(np.append(ends[there], len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (at, *values)]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *lists], ["range", "slot", *(f"v{k}" for k in range(len(values)))])


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy()


def _slots(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall on each of SLOTS counters. A task hands on at most RANGES rows."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy().view(np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield _ranges(at, total[at])

    def added(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            np.add.at(total, _flat(b, "slot"), _flat(b, "v0"))
        at = np.flatnonzero(total)
        yield _ranges(at, total[at])

    kind = "range int, slot array<long>, v0 array<long>"
    got = sets.select("set").mapInArrow(tidy(run), kind).repartition(RANGES, "range").mapInArrow(tidy(added), kind).toArrow()
    out = np.zeros(SLOTS, np.int64)
    for b in got.to_batches():
        out[_flat(b, "slot")] = _flat(b, "v0")
    return out


def _refined(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """bucket, doc, rest: the first shingles of each member's set, and how many of the set there are from that one on. Those
    of which a table of SLOTS entries says that only one class has them could link nothing and are left out. members: doc,
    class."""
    of = members.select("doc", F.xxhash64("class").alias("class")).distinct()
    some = staged(sets.join(of, "doc").select("doc", "set", "class"), "refined")
    context = members.sparkSession.sparkContext
    shared = context.broadcast(_slots(some))  # fixed size, 8 MB

    def first(b):
        n = np.diff(b.column(1).offsets.to_numpy())
        shingle = b.column(1).flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((shingle, shared.value[shingle.view(np.uint64) % np.uint64(SLOTS)], row))
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        on = at < (n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1)[row]
        chosen = shingle[order][on]
        return row[on], chosen, (chosen.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64), (n[row] - at)[on].astype(np.int64)

    def classes(batches):
        big = np.iinfo(np.int64)
        lo, hi = np.full(SLOTS, big.max), np.full(SLOTS, big.min)
        for b in batches:
            row, _, slot, _ = first(b)
            of_row = b.column(2).to_numpy()[row]
            np.minimum.at(lo, slot, of_row)
            np.maximum.at(hi, slot, of_row)
        at = np.flatnonzero(lo <= hi)
        yield _ranges(at, lo[at], hi[at])

    def mixed(batches):
        big = np.iinfo(np.int64)
        lo, hi = np.full(SLOTS, big.max), np.full(SLOTS, big.min)
        for b in batches:
            np.minimum.at(lo, _flat(b, "slot"), _flat(b, "v0"))
            np.maximum.at(hi, _flat(b, "slot"), _flat(b, "v1"))
        yield _ranges(np.flatnonzero(lo < hi))

    kind = "range int, slot array<long>, v0 array<long>, v1 array<long>"
    got = some.mapInArrow(tidy(classes), kind).repartition(RANGES, "range").mapInArrow(tidy(mixed), "range int, slot array<long>").toArrow()
    several = np.zeros(SLOTS, bool)
    for b in got.to_batches():
        several[_flat(b, "slot")] = True
    open_ = context.broadcast(several)  # fixed size, 1 MB

    def run(batches):
        for b in batches:
            row, shingle, slot, rest = first(b)
            on = open_.value[slot]
            yield pa.RecordBatch.from_arrays([pa.array(shingle[on]), b.column(0).take(pa.array(row[on])), pa.array(rest[on])], ["bucket", "doc", "rest"])

    return some.mapInArrow(tidy(run), f"bucket long, doc {some.schema['doc'].dataType.simpleString()}, rest long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns: one of each class."""
    name = unused(docs, "kept_id")
    kept = near_dup_classes(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
