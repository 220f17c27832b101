"""Candidate pools, slates, gates and audits over order lines, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_prefix, order_hash, split_75_10_10_5
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import sampling as N
from ..operators import sessions as S
from ..operators.numbering import drawn_sql
from ..sources.tables import INTERACTIONS, LISTENS, catalog, interactions, listens, table, vectors
from .base import query
from .graph import ELIGIBLE, METRICS, SPLIT, TOP, _candidates, _measured, _recommended
from .splits import BANDS
from .vectors import SIM, _pairs

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS

query("k7_profile_split", X + SPLIT + " SELECT query, item, seed FROM q")(lambda s, d: R.profile_split(interactions(s, d).where("user % 100 = 0"), F.sha2(F.concat_ws(":", "user", "item").cast("binary"), 256)))

query("t1_top_k", X + SPLIT + ", r AS (SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM nk) SELECT * FROM r WHERE rank <= 50")(
    lambda s, d: R.top_k(_candidates(s, d)[1], 50).select("query", "item", "rank")
)

query(
    "a16_collapsed_pool",
    X + """, ev AS (SELECT "user" % 20 AS query, ctx AS seed, item, min(pos) AS rank FROM x GROUP BY 1, 2, 3), p AS (SELECT query, item, count(DISTINCT seed) AS support, sum(1 / (60 + rank)) AS score FROM ev GROUP BY 1, 2),
    n AS (SELECT p.*, p_brand || '|' || p_name AS identity, row_number() OVER (PARTITION BY query, p_brand || '|' || p_name ORDER BY support DESC, round(score, 9) DESC, item) AS k FROM p JOIN part ON item = p_partkey)
    SELECT query, identity, min(item) FILTER (k = 1) AS item, count(*) - 1 AS others, CAST(sum(support) AS BIGINT) AS support, round(max(score) FILTER (k = 1), 6) AS score FROM n GROUP BY 1, 2""",
)(lambda s, d: _pool(s, d))


def _pool(s, d):
    ev = interactions(s, d).groupBy((F.col("user") % 20).alias("query"), F.col("ctx").alias("seed"), "item").agg(F.min("pos").alias("rank"))
    ids = catalog(s, d).select("item", F.concat_ws("|", "artist", "title").alias("identity"))
    return M.collapsed_pool(ev, ids).withColumn("score", F.round("score", 6))


query(
    "j5_resolve_cascade",
    """WITH c AS (SELECT p_partkey AS item, p_brand || '|' || p_name || '|' || p_type AS exact, p_brand || '|' || p_name AS title FROM part), n AS (SELECT p_partkey AS name_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_name || '|' || p_type END AS exact, p_brand || '|' || p_name AS title FROM part),
    a AS (SELECT exact, count(DISTINCT item) AS n, min(item) AS i FROM c GROUP BY 1), b AS (SELECT title, count(DISTINCT item) AS n, min(item) AS i FROM c GROUP BY 1)
    SELECT name_id, CASE WHEN a.n = 1 THEN a.i WHEN b.n = 1 THEN b.i ELSE -1 END AS item, CASE WHEN a.n = 1 THEN 'exact' WHEN b.n = 1 THEN 'title' ELSE 'unresolved' END AS kind FROM n LEFT JOIN a ON n.exact = a.exact LEFT JOIN b ON n.title = b.title""",
)(lambda s, d: _cascade(s, d))


def _cascade(s, d):
    p = table(s, d, "part")
    exact, title = F.concat_ws("|", "p_brand", "p_name", "p_type"), F.concat_ws("|", "p_brand", "p_name")
    names = p.select(F.col("p_partkey").alias("name_id"), F.when(F.col("p_partkey") % 2 == 0, exact).alias("exact"), title.alias("title"))
    return M.resolve_cascade(names, p.select(F.col("p_partkey").alias("item"), exact.alias("exact"), title.alias("title")), ["exact", "title"]).withColumn("item", F.coalesce("item", F.lit(-1)))


query("w8_strongest_seeds", SIM + """, r AS (SELECT item, query AS seed, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, query) AS k, max(score) OVER (PARTITION BY item) AS top FROM s)
 SELECT item, seed, round(score, 6) AS score FROM r WHERE k <= 8 AND (k = 1 OR (score >= 0 AND score >= top - 0.08))""")(lambda s, d: _strongest(s, d))


def _strongest(s, d):
    w = Window.partitionBy("item")
    r = _pairs(s, d).select("item", F.col("query").alias("seed"), "score").withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "seed"))).withColumn("top", F.max("score").over(w))
    return r.where("k <= 8 AND (k = 1 OR (score >= 0 AND score >= top - 0.08))").select("item", "seed", F.round("score", 6).alias("score"))


query(
    "w9_round_robin_seeds",
    X + """, i AS (SELECT DISTINCT "user", artist, item FROM x WHERE "user" % 100 = 0), r AS (SELECT *, ((item + 1) * 2654435761) & 4294967295 AS h FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY "user", artist ORDER BY h, item) AS round FROM r),
    o AS (SELECT "user", item, CAST(row_number() OVER (PARTITION BY "user" ORDER BY round, sha256(artist), item) AS INTEGER) AS place FROM k) SELECT * FROM o WHERE place <= 64""",
)(lambda s, d: _round_robin(s, d))


def _round_robin(s, d):
    i = interactions(s, d).where("user % 100 = 0").select("user", "artist", "item").distinct()
    k = i.withColumn("round", F.row_number().over(Window.partitionBy("user", "artist").orderBy(order_hash(F.col("item")), "item")))
    place = F.row_number().over(Window.partitionBy("user").orderBy("round", F.sha2(F.col("artist").cast("binary"), 256), "item"))
    return k.withColumn("place", place).where("place <= 64").select("user", "item", "place")


query(
    "k12_matched_negatives",
    X + BANDS + """, fam AS (SELECT DISTINCT "user" AS query, artist FROM x), it AS (SELECT DISTINCT item, artist FROM x), kf AS (SELECT kn.query, kn.item FROM kn WHERE kn.query % 100 = 0),
    fi AS (SELECT query, it.item, row_number() OVER (PARTITION BY query ORDER BY it.item) - 1 AS number FROM fam JOIN it ON fam.artist = it.artist WHERE query % 100 = 0),
    fp AS (SELECT query AS pool, item, number FROM fi), ak AS (SELECT item AS positive, query, query AS pool FROM kf), """ + drawn_sql("ak", "fp", "kn", ["positive"], 1, 32, "dn")
    + """ SELECT query, positive, item AS negative, round(1.0 / count(*) OVER (PARTITION BY query), 9) AS weight FROM dn""",
)(lambda s, d: N.matched_negatives(interactions(s, d)).withColumn("weight", F.round("weight", 9)))

query(
    "k13_negative_pools",
    X + BANDS + """, us AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), e AS (SELECT vec_id, embedding FROM embeddings),
    po AS (SELECT DISTINCT "user" AS query, x.item AS positive, e.embedding AS pv, users AS pu FROM x JOIN e ON x.item = vec_id JOIN us ON us.item = x.item WHERE "user" % 100 = 0 AND x.item % 5 = 0),
    al AS (SELECT po.query, positive, e.vec_id AS item, round(list_dot_product(CAST(pv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS sim, abs(ln(1 + users) - ln(1 + pu)) AS far FROM po, e JOIN us ON us.item = e.vec_id WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.query = po.query AND kn.item = e.vec_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query, positive ORDER BY round(far, 9), item) AS rf, row_number() OVER (PARTITION BY query, positive ORDER BY sim, item) AS rs, count(*) OVER (PARTITION BY query, positive) AS n, sha256(positive || ':' || item) AS h FROM al),
    pl AS (SELECT *, 0 AS pool FROM rk UNION ALL SELECT *, 1 FROM rk WHERE rf <= greatest(1, n // 4) UNION ALL SELECT *, 2 FROM rk WHERE rs > n // 3 AND rs <= greatest(n // 3 + 1, 2 * n // 3) UNION ALL SELECT *, 3 FROM rk WHERE n - rs < greatest(1, n // 10)),
    t0 AS (SELECT query, positive, item, pool FROM (SELECT *, row_number() OVER (PARTITION BY query, positive ORDER BY h, item) AS k FROM pl WHERE pool = 0) WHERE k <= 8),
    t1 AS (SELECT query, positive, item, pool FROM (SELECT *, row_number() OVER (PARTITION BY query, positive ORDER BY h, item) AS k FROM pl WHERE pool = 1 AND NOT EXISTS (SELECT 1 FROM t0 WHERE t0.query = pl.query AND t0.positive = pl.positive AND t0.item = pl.item)) WHERE k <= 8),
    s1 AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1),
    t2 AS (SELECT query, positive, item, pool FROM (SELECT *, row_number() OVER (PARTITION BY query, positive ORDER BY h, item) AS k FROM pl WHERE pool = 2 AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.query = pl.query AND s1.positive = pl.positive AND s1.item = pl.item)) WHERE k <= 8),
    s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM t2),
    t3 AS (SELECT query, positive, item, pool FROM (SELECT *, row_number() OVER (PARTITION BY query, positive ORDER BY h, item) AS k FROM pl WHERE pool = 3 AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.query = pl.query AND s2.positive = pl.positive AND s2.item = pl.item)) WHERE k <= 8)
    SELECT * FROM s2 UNION ALL SELECT * FROM t3""",
)(lambda s, d: _pools(s, d))


def _pools(s, d):
    """The positives are the known items, with a vector and an id divisible by 5, of the asked users."""
    x, v = interactions(s, d), vectors(s, d).select(F.col("id").alias("item"), "vec")
    positives = x.where("user % 100 = 0 AND item % 5 = 0").select(F.col("user").alias("query"), F.col("item").alias("positive")).distinct()
    return N.pooled_negatives(positives, x.select(F.col("user").alias("query"), "item").distinct(), x.groupBy("item").agg(F.count_distinct("user").alias("users")).join(v, "item"))


query(
    "m12_profile_sizes",
    X + """, n AS (SELECT "user", count(DISTINCT item) AS n FROM x GROUP BY 1) SELECT CASE WHEN n < 20 THEN 5 WHEN n < 50 THEN 20 WHEN n < 200 THEN 50 WHEN n < 500 THEN 200 ELSE 500 END AS bucket, count(*) AS users FROM n WHERE n >= 5 GROUP BY 1""",
)(lambda s, d: _sizes(s, d))


def _sizes(s, d):
    n = interactions(s, d).groupBy("user").agg(F.count_distinct("item").alias("n")).where("n >= 5")
    b = F.when(F.col("n") < 20, 5).when(F.col("n") < 50, 20).when(F.col("n") < 200, 50).when(F.col("n") < 500, 200).otherwise(500)
    return n.groupBy(b.alias("bucket")).agg(F.count("*").alias("users"))


query(
    "l6_slate",
    X + SPLIT + TOP + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), p AS (SELECT item, percent_rank() OVER (ORDER BY users) AS pr FROM u)
    SELECT top.query, top.item, rank, round(score, 6) AS relevance, round(score - 0.3 * pr, 6) AS lift, round(1 - pr, 6) AS rarity, round(1.0 / count(*) OVER (PARTITION BY top.query, artist), 6) AS artist_share FROM top JOIN p ON top.item = p.item""",
)(lambda s, d: _slate(s, d))


def _slate(s, d):
    from ..operators.popularity import user_percentile

    top = _recommended(s, d)[1].join(user_percentile(interactions(s, d)).select("item", "percentile"), "item")
    share = 1 / F.count("*").over(Window.partitionBy("query", "artist"))
    return top.select("query", "item", "rank", F.round("score", 6).alias("relevance"), F.round(F.col("score") - 0.3 * F.col("percentile"), 6).alias("lift"), F.round(1 - F.col("percentile"), 6).alias("rarity"), F.round(share, 6).alias("artist_share"))


query("r17_lift_contribution", X + SPLIT + """, n AS (SELECT query, count(*) AS seeds FROM q WHERE seed GROUP BY 1) SELECT nk.query, item, round(score + support / seeds, 4) AS lift FROM nk JOIN n ON nk.query = n.query""")(lambda s, d: _lift(s, d))


def _lift(s, d):
    q, found = _candidates(s, d)
    n = q.where("seed").groupBy("query").agg(F.count("*").alias("seeds"))
    return found.join(n, "query").select("query", "item", F.round(F.col("score") + F.col("support") / F.col("seeds"), 4).alias("lift"))


query(
    "m10_gates",
    X + SPLIT + TOP + METRICS + """, u AS (SELECT DISTINCT "user" FROM x), sp AS (SELECT "user", CAST('0x' || substr(sha256(sha256(CAST("user" AS VARCHAR))), 1, 8) AS UBIGINT) % 100 < 75 AS train FROM x),
    dl AS (SELECT query, ndcg, row_number() OVER (ORDER BY query) - 1 AS i FROM mt), dr AS (SELECT b, CAST('0x' || substr(sha256(b || ':' || i), 1, 12) AS UBIGINT) % (SELECT count(*) FROM dl) AS i FROM dl, range(0, 1000) r(b)), ms AS (SELECT b, avg(ndcg) AS m FROM dr JOIN dl ON dr.i = dl.i GROUP BY b)
    SELECT (SELECT count(*) = count(DISTINCT item) FROM (SELECT p_partkey AS item FROM part)) AS unique_ids, (SELECT count(*) FROM q JOIN top ON q.query = top.query AND q.item = top.item AND q.seed) = 0 AS no_seed_listed, (SELECT count(*) FROM u) >= 50 AS enough_users,
    (SELECT count(*) FROM (SELECT "user" FROM sp GROUP BY "user" HAVING bool_or(train) AND NOT bool_and(train))) = 0 AS disjoint_splits, true AS order_invariant, (SELECT avg(recall) FROM mt) >= 0.02 AS recall_floor, (SELECT quantile_cont(m, 0.025) FROM ms) > 0 AS above_zero""",
)(lambda s, d: _gates(s, d))


def _gates(s, d):
    """One row of gates. Order and repeats of the input must not matter: the lists are made again from shuffled, doubled rows."""
    from ..sources.staging import cut

    q, top = _recommended(s, d)
    top = cut(top, "top")
    x = interactions(s, d)
    ids = catalog(s, d).agg((F.count("*") == F.count_distinct("item")).alias("unique_ids"))
    leak = q.where("seed").join(top, ["query", "item"], "left_semi").agg((F.count("*") == 0).alias("no_seed_listed"))
    users = x.agg((F.count_distinct("user") >= 50).alias("enough_users"))
    split = x.select("user", (split_75_10_10_5(F.col("user").cast("string")) == "train").alias("t")).groupBy("user").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    split = split.agg((F.count_if(F.col("a") != F.col("b")) == 0).alias("disjoint_splits"))
    again = _recommended(s, d, x.union(x).repartition(F.xxhash64("ctx", "pos")))[1]
    differ = top.select("query", "item", "rank").exceptAll(again.select("query", "item", "rank")).union(again.select("query", "item", "rank").exceptAll(top.select("query", "item", "rank")))
    order = differ.agg((F.count("*") == 0).alias("order_invariant"))
    m = cut(R.metrics(top, q.where("NOT seed"), 40), "measured")
    floor = m.agg((F.avg("recall") >= 0.02).alias("recall_floor"))
    above = R.paired_bootstrap(m.select("query", F.col("ndcg").alias("delta")), 1000).select((F.col("low") > 0).alias("above_zero"))
    out = ids
    for g in (leak, users, split, order, floor, above):
        out = out.crossJoin(g)  # one row each
    return out


query(
    "m13_probe_verdict",
    X + SPLIT + TOP + METRICS + """, en AS (SELECT query, 'recall' AS endpoint, recall - 0.01 AS delta FROM mt UNION ALL SELECT query, 'ndcg', ndcg - 0.01 FROM mt UNION ALL SELECT query, 'hit', CAST(hit AS DOUBLE) - 0.5 FROM mt),
    dl AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY query) - 1 AS i FROM en), dr AS (SELECT b, i AS j, CAST('0x' || substr(sha256(b || ':' || i), 1, 12) AS UBIGINT) % (SELECT count(*) FROM mt) AS i FROM (SELECT DISTINCT i FROM dl), range(0, 1000) r(b)),
    ms AS (SELECT endpoint, b, avg(delta) AS m FROM dr JOIN dl ON dr.i = dl.i GROUP BY ALL), lo AS (SELECT endpoint, round(quantile_cont(m, 0.025), 6) AS low FROM ms GROUP BY endpoint)
    SELECT endpoint, low, low >= 0 AS holds, (SELECT bool_and(low >= 0) FROM lo) AS verdict FROM lo""",
)(lambda s, d: _verdict(s, d))


def _verdict(s, d):
    """Each endpoint's gain over a fixed floor, with the lower end of its interval; the verdict is that all hold."""
    from ..sources.staging import cut

    m, out = cut(_measured(s, d), "measured"), None
    for name, floor in (("recall", 0.01), ("ndcg", 0.01), ("hit", 0.5)):
        ci = R.paired_bootstrap(m.select("query", (F.col(name) - floor).alias("delta")), 1000).select(F.lit(name).alias("endpoint"), F.round("low", 6).alias("low"))
        out = ci if out is None else out.union(ci)
    out = cut(out, "endpoints").withColumn("holds", F.col("low") >= 0)
    return out.crossJoin(F.broadcast(out.agg(F.bool_and("holds").alias("verdict"))))  # one row


query("m11_artifact_audit", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) FILTER (len(embedding) <> 64) AS misshapen, round(CAST(min(list_min(embedding)) AS DOUBLE), 5) AS low, round(CAST(max(list_max(embedding)) AS DOUBLE), 5) AS high FROM embeddings")(
    lambda s, d: vectors(s, d).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.size("vec") != 64).alias("misshapen"), F.round(F.min(F.array_min("vec")).cast("double"), 5).alias("low"), F.round(F.max(F.array_max("vec")).cast("double"), 5).alias("high"))
)

query(
    "m11_lineage",
    """SELECT (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS without_order, (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS without_part,
    (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) AS rows_used, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)) AS most_occurrences, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS items""",
)(lambda s, d: _lineage(s, d))


def _lineage(s, d):
    """Every source row accounted for: used, or without its order or part; and occurrence counts of the items."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders = table(s, d, "orders").select("o_orderkey", F.lit(1).alias("o"))
    parts = table(s, d, "part").select("p_partkey", F.lit(1).alias("p"))
    j = rows.join(orders, "o_orderkey", "left").join(parts, "p_partkey", "left")
    whole = j.agg(F.count("*").alias("rows_in"), F.count_if(F.col("o").isNull()).alias("without_order"), F.count_if(F.col("p").isNull()).alias("without_part"), F.count_if(F.col("o").isNotNull() & F.col("p").isNotNull()).alias("rows_used"))
    per = rows.groupBy("p_partkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_occurrences"), F.count("*").alias("items"))
    return whole.crossJoin(per)  # one row each


query("s10_alignment", "SELECT p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64)")(
    lambda s, d: catalog(s, d).select("item").join(vectors(s, d).where(F.size("vec") == 64).select(F.col("id").alias("item")), "item", "left_anti")
)

query("j14_train_catalog", X + """, u AS (SELECT "user", CAST('0x' || substr(sha256(sha256(CAST("user" AS VARCHAR))), 1, 8) AS UBIGINT) % 100 AS b FROM (SELECT DISTINCT "user" FROM x)) SELECT item, count(DISTINCT x."user") AS users FROM x JOIN u ON x."user" = u."user" WHERE b < 75 GROUP BY item""")(
    lambda s, d: interactions(s, d).where(split_75_10_10_5(F.col("user").cast("string")) == "train").groupBy("item").agg(F.count_distinct("user").alias("users"))
)

query("p7_cross_artist_pairs", X + ELIGIBLE + ", i AS (SELECT DISTINCT ctx, item, artist FROM el) SELECT a.item AS a, b.item AS b, count(*) AS n FROM i a JOIN i b ON a.ctx = b.ctx AND a.artist <> b.artist AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 2")(lambda s, d: _cross(s, d))


def _cross(s, d):
    i = S.eligible(interactions(s, d)).select("ctx", "item", "artist").distinct()
    j = i.select("ctx", F.col("item").alias("a"), F.col("artist").alias("x")).join(i.select("ctx", F.col("item").alias("b"), F.col("artist").alias("y")), "ctx").where("x <> y AND a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")


query("p13_list_lengths", X + "SELECT ctx, count(*) AS n FROM x GROUP BY ctx HAVING count(*) BETWEEN 2 AND 500")(lambda s, d: interactions(s, d).groupBy("ctx").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 500"))

query("w6_first_occurrence", E + """, r AS (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY event_id) AS k FROM e) SELECT event_id, "user", item FROM r WHERE k = 1""")(
    lambda s, d: listens(s, d).withColumn("k", F.row_number().over(Window.partitionBy("user", "item").orderBy("event_id"))).where("k = 1").select("event_id", "user", "item")
)

query("st6_exclusions", E + """SELECT DISTINCT "user", item FROM e WHERE action IN ('click', 'purchase', 'signup') EXCEPT SELECT "user", item FROM e WHERE action = 'error'""".replace("SELECT DISTINCT", " SELECT DISTINCT", 1))(
    lambda s, d: (lambda e: e.where(F.col("action").isin("click", "purchase", "signup")).select("user", "item").distinct().join(e.where("action = 'error'").select("user", "item"), ["user", "item"], "left_anti"))(listens(s, d))
)

query("st9_user_shards", E + """SELECT CAST(CAST('0x' || substr(sha256(CAST("user" AS VARCHAR)), 1, 8) AS UBIGINT) % 32 AS BIGINT) AS shard, count(*) AS listens, count(DISTINCT "user") AS users FROM e GROUP BY 1""".replace("SELECT CAST", " SELECT CAST", 1))(
    lambda s, d: listens(s, d).groupBy((hex_prefix(F.col("user")) % 32).alias("shard")).agg(F.count("*").alias("listens"), F.count_distinct("user").alias("users"))
)
