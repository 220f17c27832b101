"""Splits, episodes and negatives in hash order: the same rows whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..functions.vector import dot
from ..sources.staging import cut
from .vectors import products
from .numbering import drawn, hash_number, numbered, running
from .popularity import user_percentile


def ordered_split(users: DataFrame, key: str, ratios: tuple[float, float]) -> DataFrame:
    """train, validation, test by hash order; sizes are floors of the ratios."""
    hashed = users.select(key, sha(F.concat(F.lit("seed:"), F.col(key).cast("string"))).alias("_h"))
    r = numbered(hashed, ["_h", key], "k").crossJoin(F.broadcast(users.agg(F.count("*").alias("n"))))  # one row
    a, b = F.floor(F.col("n") * ratios[0]), F.floor(F.col("n") * ratios[1])
    return r.select(key, F.when(F.col("k") < a, "train").when(F.col("k") < a + b, "validation").otherwise("test").alias("split"))


def group_disjoint_split(x: DataFrame, group: str, share: float) -> DataFrame:
    """Whole groups in hash order until the share of rows is reached; the rest is held."""
    n = x.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", sha(F.col(group)))
    c = running(n, ["_h", group], F.col("n"), "before").crossJoin(F.broadcast(x.agg(F.count("*").alias("total"))))  # one row
    return c.select(group, "n", (F.col("before") >= share * F.col("total")).alias("held"))


def masked_episodes(x: DataFrame, masks: int = 32, least: int = 5, most: int = 30) -> DataFrame:
    """(user, mask, item, positive): per mask, up to ``most`` seeds in hash order and the next item as positive."""
    each = x.select("user", "item").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(masks - 1).cast("long"))))
    w = Window.partitionBy("user", "mask")
    o = each.withColumn("k", F.row_number().over(w.orderBy(sha(F.concat_ws(":", "mask", "user", "item")), "item"))).withColumn("n", F.count("*").over(w))
    last = F.least(F.lit(most), F.col("n") - 1) + 1
    return o.where((F.col("n") > least) & (F.col("k") <= last)).select("user", "mask", "item", (F.col("k") == last).alias("positive"))


def band_items(x: DataFrame) -> DataFrame:
    """pool (popularity band), item, number within the band in item order."""
    bands = user_percentile(x).select(F.col("band").alias("pool"), "item")
    every = numbered(bands, ["pool", "item"], "at")
    first = every.groupBy("pool").agg(F.min("at").alias("first"))
    return every.join(F.broadcast(first), "pool").select("pool", "item", (F.col("at") - F.col("first")).alias("number"))  # ten bands


def band_negatives(x: DataFrame, asked=None, n: int = 1, tries: int = 16) -> DataFrame:
    """(query, positive, negative): for each known item n unknown ones of the same popularity band, by hash draws."""
    asked = F.col("user") % 100 == 0 if asked is None else asked
    items = cut(band_items(x), "bands")
    known = x.where(asked).select(F.col("user").alias("query"), "item").distinct()
    positive = known.join(items, "item").select(F.col("item").alias("positive"), "query", "pool")
    return drawn(positive, items, known, ["positive"], n, tries).select("query", "positive", F.col("item").alias("negative"))


def random_negatives(asked: DataFrame, x: DataFrame, n: int = 99, tries: int = 160) -> DataFrame:
    """(key, query, item): for each asked row n items that its user does not know, by hash draws. asked: key, query."""
    items = numbered(x.select("item").distinct(), ["item"], "number").withColumn("pool", F.lit(0))
    known = x.select(F.col("user").alias("query"), "item").distinct()
    return drawn(asked.withColumn("pool", F.lit(0)), cut(items, "items"), known, ["key"], n, tries).select("key", "query", "item")


def distinct_contexts(x: DataFrame) -> DataFrame:
    """Contexts of a user with the same items count once."""
    c = x.groupBy("user", "ctx").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return c.select("user", "items").distinct().groupBy("user").agg(F.count("*").alias("contexts"))


def first_seen(x: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in input order."""
    w = Window.partitionBy(key).orderBy(order)
    return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def user_weighted(pairs: DataFrame) -> DataFrame:
    """Equal total weight per user."""
    return pairs.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("user")))


def matched_negatives(x: DataFrame, asked=None, tries: int = 32) -> DataFrame:
    """(query, positive, negative, weight): for each known item an unknown one of an artist that the user knows, so that
    both carry the same familiar flag; the weights of a user sum to one. Items are numbered within the lists of a user's
    artists together, and no user's pool is written out."""
    asked = F.col("user") % 100 == 0 if asked is None else asked
    mine = x.where(asked).select(F.col("user").alias("query"), "artist", "item").distinct()
    items = cut(x.select(F.col("artist").alias("list"), "item").distinct(), "familiar")
    lists = cut(mine.select(F.col("query").alias("pool"), F.col("artist").alias("list")).distinct(), "artists")
    known = cut(mine.select("query", "item").distinct(), "known")
    positives = known.select(F.col("item").alias("positive"), "query", F.col("query").alias("pool"))
    found = drawn(positives, items, known, ["positive"], 1, tries, lists)
    return user_weighted(found.select(F.col("query").alias("user"), "positive", F.col("item").alias("negative"))).withColumnRenamed("user", "query")


#: Pairs of a positive that are placed first, for each item that it takes from a pool; positives and items of a block.
PLACED, POSITIVES, ITEM_BLOCK = 160, 1024, 1 << 16


def pooled_negatives(positives: DataFrame, known: DataFrame, items: DataFrame, each: int = 8, placed: int = PLACED) -> DataFrame:
    """(query, positive, item, pool): ``each`` unknown items in hash order from four pools in turn: all, the quarter nearest in
    popularity, the middle third and the top tenth by similarity; an item counts for the first pool that takes it. A pool's
    first items by hash are all that matters: pairs below a bound on the hash, ``placed`` * ``each`` a positive or so, find their
    ranks by counts in blocks, and no other pair is a row. A positive of which a pool holds too few of them, though it has
    more, is done again with a sixteenfold bound, up to all pairs. positives: query, positive, a stated set; known: query,
    item; items: item, users, vec."""
    items, known = cut(items, "valued"), known.distinct()
    p = positives.join(items.select(F.col("item").alias("positive"), F.col("vec").alias("pv"), F.col("users").alias("pu")), "positive")
    mine = known.join(p.select("query").distinct(), "query", "left_semi").join(items.select("item"), "item", "left_semi")
    left = cut(p.join(mine.groupBy("query").agg(F.collect_list("item").alias("mine")), "query", "left"), "positives")
    share, done = each * placed / max(1, items.count()), None
    while True:
        r = _placed(left, known, items, share)
        n, third = F.col("n"), F.floor(F.col("n") / 3)
        middle, tenth = F.greatest(third + 1, F.floor(2 * n / 3)), F.greatest(F.lit(1), F.floor(n / 10))
        quarter = F.greatest(F.lit(1), F.floor(n / 4))
        inside = [F.lit(True), F.col("rf") <= quarter, (F.col("rs") > third) & (F.col("rs") <= middle), n - F.col("rs") < tenth]
        r = cut(r.withColumns({f"in{k}": ok for k, ok in enumerate(inside)}), "ranked")
        short = None
        if share < 1:
            sizes = [n, quarter, F.least(n, middle) - third, tenth]
            counts = r.groupBy("query", "positive").agg(F.first("n").alias("n"), *[F.count_if(f"in{k}").alias(f"c{k}") for k in range(4)])
            enough = [F.col(f"c{k}") >= F.least(F.lit(each * (k + 1)), size) for k, size in enumerate(sizes)]
            whole = counts.where(enough[0] & enough[1] & enough[2] & enough[3]).select("query", "positive")
            short = cut(left.join(whole, ["query", "positive"], "left_anti"), "short")
            if short.isEmpty():
                short = None
            else:
                r = r.join(whole, ["query", "positive"], "left_semi")
        done = r if done is None else done.unionByName(r)
        if short is None:
            break
        left, share = short, share * 16
    r = done.withColumn("taken", F.lit(-1))
    for k in range(4):
        free = F.col(f"in{k}") & (F.col("taken") < 0)
        place = F.row_number().over(Window.partitionBy("query", "positive", free).orderBy("h", "item"))
        r = r.withColumn("taken", F.when(free & (place <= each), k).otherwise(F.col("taken")))
    return r.where("taken >= 0").select("query", "positive", "item", F.col("taken").alias("pool"))


def _placed(positives: DataFrame, known: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """query, positive, item, h, rs, rf, n: unknown pairs whose hash is in the first ``share`` of all, their places among the
    n unknown items by similarity and by distance in popularity."""
    asked = positives.select(F.xxhash64("query", "positive").alias("id"), "query", "positive")
    met = products(items.select(F.xxhash64("item").alias("id"), "item"), asked).select("q.query", "q.positive", "item")  # the stated positives against all items, in blocks
    met = met.withColumn("h", sha(F.concat_ws(":", "positive", "item")))
    if share < 1:
        met = met.where(F.col("h") < f"{int(share * 16**12):012x}")
    met = met.join(known, ["query", "item"], "left_anti").join(items, "item").join(positives.select("query", "positive", "pv", "pu"), ["query", "positive"])
    met = met.select("query", "positive", "item", "h", F.round(dot(F.col("pv"), F.col("vec")), 9).alias("sim"), F.round(F.abs(F.log1p("users") - F.log1p("pu")), 9).alias("far"))
    met = cut(met, "hashed")
    n = positives.count()
    blocks, item_blocks = max(-(-n // POSITIVES), min(n, 16), 1), max(1, -(-items.count() // ITEM_BLOCK))
    of = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = met.groupBy("query", "positive").agg(F.collect_list("item").alias("item"), F.collect_list("sim").alias("sim"), F.collect_list("far").alias("far")).join(positives, ["query", "positive"])
    asked = asked.select(of(blocks, "query", "positive").alias("b"), every(item_blocks).alias("i"), "query", "positive", "pv", "pu", F.coalesce("mine", F.array().cast("array<long>")).alias("mine"), "item", "sim", "far")
    facts = items.select(every(blocks).alias("b"), of(item_blocks, "item").alias("i"), "item", "users", "vec")
    below = asked.groupBy("b", "i").cogroup(facts.groupBy("b", "i")).applyInArrow(_places, "query long, positive long, item long, sims long, fars long, n long")
    below = below.groupBy("query", "positive", "item").agg((F.sum("sims") + 1).alias("rs"), (F.sum("fars") + 1).alias("rf"), F.sum("n").alias("n"))
    return met.select("query", "positive", "item", "h").join(below, ["query", "positive", "item"])


def _below(value: np.ndarray, nth: np.ndarray, asked: np.ndarray, asked_nth: np.ndarray) -> np.ndarray:
    """How many of the pairs (value, nth) are less than each asked pair; nth are whole numbers from 0 to len(value)."""
    level, of = np.unique(value, return_inverse=True)
    at = np.searchsorted(level, asked)
    there = np.append(level, np.inf)[at] == asked
    wide = max(int(nth.max(initial=0)), int(asked_nth.max(initial=0))) + 1
    return np.searchsorted(np.sort(of * wide + nth), at * wide + np.where(there, asked_nth, 0))


def _places(asked: pa.Table, items: pa.Table) -> pa.Table:
    """For each asked pair of a block of positives, how many unknown items of a block of items come before it."""
    out = {c: [np.zeros(0, np.int64)] for c in ("query", "positive", "item", "sims", "fars", "n")}
    if len(asked):
        item = items["item"].to_numpy()
        order = np.argsort(item)
        item, log = item[order], np.log1p(items["users"].to_numpy()[order].astype(np.float64))
        x = items["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(item), -1)[order] if len(item) else np.zeros((0, 1))
        nth = np.arange(len(item))
        for row in range(len(asked)):
            one = {c: asked[c][row] for c in asked.column_names}
            values = {c: one[c].values.to_numpy(zero_copy_only=False) for c in ("pv", "mine", "item", "sim", "far")}
            on = ~np.isin(item, values["mine"])
            sims = np.round(x[on] @ values["pv"].astype(np.float64), 9) if len(item) else np.zeros(0)
            fars = np.round(np.abs(log[on] - np.log1p(float(one["pu"].as_py()))), 9)
            spot = np.searchsorted(item, values["item"])
            for c, got in (("sims", _below(sims, nth[on], values["sim"], spot)), ("fars", _below(fars, nth[on], values["far"], spot))):
                out[c].append(got)
            m = len(spot)
            for c, got in (("query", one["query"].as_py()), ("positive", one["positive"].as_py()), ("n", int(on.sum()))):
                out[c].append(np.full(m, got, np.int64))
            out["item"].append(values["item"])
    return pa.table({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in out.items()})


def cohort_union(old: DataFrame, new: DataFrame, key: str = "user") -> DataFrame:
    """(key, part): old users all train, new ones apart. Raises where a user is in both."""
    both = old.select(key).intersect(new.select(key)).agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.raise_error(F.lit("cohorts overlap"))).alias("e"))
    whole = old.select(key, F.lit("train").alias("part")).unionByName(new.select(key, F.lit("new").alias("part")))
    return whole.crossJoin(F.broadcast(both)).where("e IS NULL").drop("e")  # one row


def family_episodes(x: DataFrame, families: DataFrame, artists: DataFrame, discovery: bool = False, most: int = 2000) -> DataFrame:
    """(user, item, target): families held out whole. Users of fewer than three families have no episode. Without discovery a
    fifth of the families (one at least) is held out, in hash order; with it one artist, the first in hash order among those
    whose families leave two others; families that an artist shares go as a whole. At most ``most`` seeds, by item. x: user,
    item; families: item, family; artists: item, artist."""
    own = x.select("user", "item").distinct().join(families, "item").join(artists, "item")
    fam = own.select("user", "family").distinct().withColumn("n", F.count("*").over(Window.partitionBy("user"))).where("n >= 3")
    if discovery:
        per = own.select("user", "artist", "family").distinct().groupBy("user", "artist").agg(F.count("*").alias("held"))
        ok = per.join(fam.select("user", "n").distinct(), "user").where("n - held >= 2")
        first = F.min(F.struct(sha(F.concat_ws(":", "user", "artist")).alias("h"), "artist")).alias("m")
        pick = ok.groupBy("user").agg(first).select("user", F.col("m.artist").alias("artist"))
        held = own.join(pick, ["user", "artist"], "left_semi").select("user", "family").distinct()
        users = pick.select("user")
    else:
        k = F.row_number().over(Window.partitionBy("user").orderBy(sha(F.concat_ws(":", "user", "family")), "family"))
        held = fam.withColumn("k", k).where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).select("user", "family")
        users = fam.select("user").distinct()
    e = own.join(users, "user", "left_semi").join(held.withColumn("h", F.lit(True)), ["user", "family"], "left").withColumn("target", F.coalesce("h", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("user", "target").orderBy("item"))
    return e.withColumn("nth", nth).where(F.col("target") | (F.col("nth") <= most)).select("user", "item", "target")


def pool_pairs(pool: DataFrame, targets: DataFrame, known: DataFrame, families: DataFrame, most: int = 12, hardest: int = 500) -> DataFrame:
    """(query, positive, negative, hard): up to ``most`` positives in hash order, one a target family, each with three hard
    negatives (hash draws from the ``hardest`` best of the pool) and one from all of it; families of known items are never
    negatives. pool: query, item, score; targets, known: query, item; families: item, family."""
    f = pool.join(families, "item")
    tf = targets.join(families, "item").select("query", "family").distinct()
    kf = known.union(targets).join(families, "item").select("query", "family").distinct()
    one = f.join(tf, ["query", "family"], "left_semi").groupBy("query", "family").agg(F.min("item").alias("positive"))
    w = Window.partitionBy("query")
    positive = one.withColumn("k", F.row_number().over(w.orderBy(sha(F.concat_ws(":", "query", "positive")), "positive"))).where(F.col("k") <= most).select("query", "positive")
    allowed = f.join(kf, ["query", "family"], "left_anti").select("query", "item", "score")
    ranked = cut(allowed.withColumn("number", F.row_number().over(w.orderBy(F.desc("score"), "item")) - 1).withColumn("n", F.count("*").over(w)), "ranked")
    size = ranked.groupBy("query").agg(F.max("n").alias("n"))
    d = positive.join(size, "query").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("hard", F.col("j") < 3)
    number = F.pmod(hash_number(F.col("query"), F.col("positive"), F.col("j")), F.when(F.col("hard"), F.least(F.lit(hardest), F.col("n"))).otherwise(F.col("n")))
    return d.withColumn("number", number).drop("n").join(ranked.select("query", "number", F.col("item").alias("negative")), ["query", "number"]).select("query", "positive", "negative", "hard")


def hard_negatives(drawn_items: DataFrame, scores: DataFrame, k: int = 4) -> DataFrame:
    """(positive, query, item, place): of the drawn items of a positive the k with the largest score. scores: query, item, score."""
    r = drawn_items.join(scores, ["query", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query", "positive").orderBy(F.desc("score"), "item"))
    return r.withColumn("place", place).where(F.col("place") <= k).select("query", "positive", "item", "place")


def bucketed_evaluation(x: DataFrame, sizes: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """(user, size, item, seed): for each size that leaves a target, that many seeds in hash order and all others as targets."""
    w = Window.partitionBy("user")
    o = x.select("user", "item").distinct().withColumn("k", F.row_number().over(w.orderBy(sha(F.concat_ws(":", "user", "item")), "item"))).withColumn("n", F.count("*").over(w))
    each = o.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("n > size")
    return each.select("user", "size", "item", (F.col("k") <= F.col("size")).alias("seed"))
