"""Resolution, fusion, targeted retrieval and controls over order lines, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import token_text
from ..operators import graph as G
from ..operators import matching as M
from ..operators import popularity as P
from ..operators import ranking as R
from ..operators import sampling as N
from ..sources.tables import INTERACTIONS, catalog, interactions, table, vectors
from ..operators.sessions import eligible
from .base import query
from ..sources.staging import cut
from .graph import ASSOC, ELIGIBLE, PPR, _confident, METRICS, SPLIT, TOP, _candidates, _graph, _measured, _queries

X = "WITH " + INTERACTIONS

query("j1_dense_index", X + ', u AS (SELECT DISTINCT "user" FROM x) SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS index FROM u')(lambda s, d: M.dense_index(interactions(s, d), "user"))

query("j3_lowest_id", "SELECT lower(p_brand || ' ' || p_name) AS key, min(p_partkey) AS item FROM part GROUP BY 1")(
    lambda s, d: catalog(s, d).groupBy(F.lower(F.concat_ws(" ", "artist", "title")).alias("key")).agg(F.min("item").alias("item"))
)

query(
    "j4_resolve_unique",
    """WITH h AS (SELECT p_brand || '|' || p_name AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS item FROM part GROUP BY 1)
    SELECT c_custkey AS name_id, CASE WHEN n = 1 THEN item ELSE -1 END AS item, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
    FROM (SELECT c_custkey, 'Brand#' || (c_custkey % 27) || '|' || (SELECT min(p_name) FROM part p WHERE p.p_partkey = c_custkey) AS key FROM customer) LEFT JOIN h USING (key)""",
)(lambda s, d: _resolved(s, d))


def _resolved(s, d):
    c = catalog(s, d)
    names = table(s, d, "customer").select(F.col("c_custkey").alias("name_id")).join(c.select(F.col("item").alias("name_id"), "title"), "name_id", "left")
    names = names.select("name_id", F.concat(F.lit("Brand#"), (F.col("name_id") % 27).cast("string"), F.lit("|"), "title").alias("key"))
    return M.resolve_unique(names, c.select("item", F.concat_ws("|", "artist", "title").alias("key"))).withColumn("item", F.coalesce("item", F.lit(-1)))


query(
    "j10_list_neighbours",
    X + ELIGIBLE + """, p AS (SELECT DISTINCT a.item, b.item AS other FROM el a JOIN el b ON a.ctx = b.ctx AND a.item <> b.item), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY other) AS k FROM p)
    SELECT item, count(*) AS n, CAST(sum(other) AS BIGINT) AS total, max(other) AS last FROM r WHERE k <= 200 GROUP BY item""",
)(lambda s, d: M.list_neighbours(eligible(interactions(s, d))).select("item", F.size("neighbours").cast("long").alias("n"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.array_max("neighbours").alias("last")))

query("j13_side_features", "SELECT p_partkey AS item, CAST(e.vec_id IS NOT NULL AS INTEGER) AS mask, round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0), 5) AS total FROM part LEFT JOIN embeddings e ON p_partkey = vec_id")(
    lambda s, d: M.side_features(catalog(s, d).select("item"), vectors(s, d).select(F.col("id").alias("item"), "vec"), 64).select("item", "mask", F.round(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))
)

query("j20_missing_evidence", "SELECT p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")(
    lambda s, d: catalog(s, d).select("item").join(vectors(s, d).select(F.col("id").alias("item")), "item", "left_anti").join(table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("item")), "item", "left_anti")
)

query(
    "j11_rare_token_match",
    """WITH r AS (SELECT p_partkey AS row_id, lower(p_type || ' ' || replace(p_brand, '#', ' ') || ' ' || p_name) AS text FROM part), t AS (SELECT min(p_partkey) AS item, lower(replace(p_brand, '#', ' ')) AS artist, lower(p_name) AS title FROM part GROUP BY 2, 3)
    SELECT row_id, item FROM r JOIN t ON contains(' ' || text || ' ', ' ' || artist || ' ') AND contains(' ' || text || ' ', ' ' || title || ' ')""",
)(lambda s, d: _rare(s, d))


def _rare(s, d):
    p = table(s, d, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), token_text(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("text"))
    tracks = p.groupBy(token_text(F.col("p_brand")).alias("artist"), token_text(F.col("p_name")).alias("title")).agg(F.min("p_partkey").alias("item"))
    return M.rare_token_match(rows, tracks)


query(
    "a17_fused_sources",
    X + """, g AS (SELECT "user" % 50 AS query, CASE ctx % 3 WHEN 0 THEN 'similar' WHEN 1 THEN 'catalog' ELSE 'history' END AS source, item, sum(weight) AS w FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY w DESC, item) AS rank FROM g)
    SELECT query, item, round(sum(CASE source WHEN 'catalog' THEN 1.2 ELSE 1 END / (60 + rank)), 9) AS score, count(DISTINCT source) AS sources FROM r GROUP BY 1, 2""",
)(lambda s, d: _fused(s, d))


def _fused(s, d):
    source = F.element_at(F.array(F.lit("similar"), F.lit("catalog"), F.lit("history")), (F.col("ctx") % 3 + 1).cast("int"))
    g = interactions(s, d).groupBy((F.col("user") % 50).alias("query"), source.alias("source"), "item").agg(F.sum("weight").alias("w"))
    r = g.withColumn("rank", F.row_number().over(Window.partitionBy("query", "source").orderBy(F.desc("w"), "item")))
    return M.fused_sources(r, {"similar": 1.0, "catalog": 1.2, "history": 1.0}).withColumn("score", F.round("score", 9))


query("w12_relative_floor", X + ASSOC + ", b AS (SELECT src, dst % 2 AS bucket, dst, affinity AS value FROM g), m AS (SELECT *, max(value) OVER (PARTITION BY src, bucket) AS top FROM b) SELECT src, bucket, dst FROM m WHERE value >= 0.25 * top + 1e-12")(
    lambda s, d: M.relative_floor(_graph(s, d)[1].select("src", (F.col("dst") % 2).alias("bucket"), "dst", (F.col("affinity") - 1e-12).alias("value"))).select("src", "bucket", "dst")
)

query(
    "t3_candidate_union",
    X + SPLIT + ", ow2 AS (SELECT item, count(*) AS owners FROM hs GROUP BY item), a AS (SELECT query, nk.item, row_number() OVER (PARTITION BY query ORDER BY score DESC, nk.item) AS i, row_number() OVER (PARTITION BY query ORDER BY support DESC, nk.item) AS j, row_number() OVER (PARTITION BY query ORDER BY round(score / sqrt(owners), 9) DESC, nk.item) AS l FROM nk JOIN ow2 ON nk.item = ow2.item) SELECT query, item FROM a WHERE i <= 2000 OR j <= 2000 OR l <= 2000",
)(lambda s, d: _union(s, d))


def _union(s, d):
    """By score, by support, and by score over the root of the item's owners."""
    owners = _queries(s, d)[1].groupBy("item").agg(F.count("*").alias("owners"))
    found = _candidates(s, d, items=owners, carry=("owners",))[1]
    return M.candidate_union(found.withColumn("rare", F.round(F.col("score") / F.sqrt("owners"), 9)), ["score", "support", "rare"], 2000)


query("t4_hash_sample", X + "SELECT DISTINCT item, item % 97 = 0 AS priority FROM x ORDER BY item % 97 = 0 DESC, sha256(CAST(item AS VARCHAR)) LIMIT 100".replace("SELECT DISTINCT item, item % 97 = 0 AS priority FROM x", " SELECT item, item % 97 = 0 AS priority FROM (SELECT DISTINCT item FROM x)", 1))(
    lambda s, d: interactions(s, d).select("item").distinct().withColumn("priority", F.col("item") % 97 == 0).orderBy(F.desc("priority"), F.sha2(F.col("item").cast("string").cast("binary"), 256)).limit(100)
)

query(
    "t6_targeted_users",
    X + """, i AS (SELECT DISTINCT "user", item FROM x), l AS (SELECT "user", count(*) AS n FROM i GROUP BY 1), w AS (SELECT item, 1.0 / count(*) AS value FROM i GROUP BY item)
    SELECT i."user", round(sum(value) / sqrt(max(n)), 9) AS score FROM i JOIN w ON i.item = w.item JOIN l ON i."user" = l."user" WHERE i.item % 7 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)(lambda s, d: _targeted(s, d))


def _targeted(s, d):
    x = interactions(s, d)
    wanted = x.select("user", "item").distinct().groupBy("item").agg((1.0 / F.count("*")).alias("value")).where("item % 7 = 0")
    return M.targeted_users(x, wanted, 50)


query("t5_search", "SELECT p_partkey AS item, CASE WHEN lower(p_name) = 'red widget' THEN 10 ELSE 0 END + CASE WHEN starts_with(lower(p_name), 'red widget') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_name), 'red') THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_name), 'widget') THEN 2 ELSE 0 END AS score FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'widget') ORDER BY 2 DESC, 1 LIMIT 25")(
    lambda s, d: M.search(catalog(s, d), "red widget")
)

query("u4_target_overlap", X + SPLIT + TOP + ", tg AS (SELECT query, item FROM q WHERE NOT seed) SELECT query, item FROM top INTERSECT SELECT query, item FROM tg")(
    lambda s, d: (lambda q, top: top.select("query", "item").intersect(q.where("NOT seed").select("query", "item")))(*_top(s, d))
)

query("u5_negatives", X + SPLIT + TOP + " SELECT top.query, top.item, top.rank FROM top WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query = top.query AND q.item = top.item)")(
    lambda s, d: (lambda q, top: top.join(q.select("query", "item"), ["query", "item"], "left_anti").select("query", "item", "rank"))(*_top(s, d))
)


def _top(s, d):
    q, found = _candidates(s, d)
    return q, R.diversified(found, catalog(s, d).select("item", "artist", F.concat_ws("|", "artist", "title").alias("identity")))


query("u1_cohort_union", X + """SELECT "user", CASE WHEN ts < DATE '1995-06-01' THEN 'train' ELSE 'new' END AS part FROM (SELECT "user", min(ts) AS ts FROM x GROUP BY "user")""")(
    lambda s, d: (lambda u: N.cohort_union(u.where("ts < DATE '1995-06-01'").select("user"), u.where("ts >= DATE '1995-06-01'").select("user")))(interactions(s, d).groupBy("user").agg(F.min("ts").alias("ts")))
)

query(
    "a19_popularity_terciles",
    X + SPLIT + TOP + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), c AS (SELECT quantile_cont(users, 1.0 / 3) AS a, quantile_cont(users, 2.0 / 3) AS b FROM u)
    SELECT CASE WHEN users <= a THEN 'low' WHEN users <= b THEN 'middle' ELSE 'high' END AS tercile, count(*) AS listed FROM top JOIN u ON top.item = u.item, c GROUP BY 1""",
)(lambda s, d: _terciles(s, d))


def _terciles(s, d):
    u = interactions(s, d).groupBy("item").agg(F.count_distinct("user").alias("users"))
    c = u.agg(F.percentile("users", F.lit(1.0 / 3)).alias("a"), F.percentile("users", F.lit(2.0 / 3)).alias("b"))
    j = _top(s, d)[1].join(u, "item").crossJoin(F.broadcast(c))  # one row
    return j.groupBy(F.when(F.col("users") <= F.col("a"), "low").when(F.col("users") <= F.col("b"), "middle").otherwise("high").alias("tercile")).agg(F.count("*").alias("listed"))


query(
    "m6_methods",
    X + SPLIT + ASSOC + ", sd AS (SELECT query, item FROM q WHERE seed)" + PPR + """, u AS (SELECT item, count(*) AS pop FROM hs GROUP BY item), cd AS (SELECT query, item FROM nk),
    li AS (SELECT DISTINCT "user" AS ctx, item FROM x), lz AS (SELECT ctx, count(*) AS size FROM li GROUP BY ctx), lp AS (SELECT item, count(*) AS pop FROM li GROUP BY item), lh AS (SELECT query, ctx, count(*) AS hits FROM sd JOIN li ON sd.item = li.item WHERE ctx <> query GROUP BY 1, 2),
    ls AS (SELECT query, li.item, sum(hits / sqrt(size)) AS s FROM lh JOIN lz ON lh.ctx = lz.ctx JOIN li ON lh.ctx = li.ctx GROUP BY 1, 2), dg2 AS (SELECT query, dst AS item, sum(affinity * confidence) AS s FROM sd JOIN cf ON item = src GROUP BY 1, 2),
    sc2 AS (SELECT query, item, 'co_listen' AS method, score AS s FROM nk UNION ALL SELECT query, cd.item, 'popularity', CAST(pop AS DOUBLE) FROM cd JOIN u ON cd.item = u.item UNION ALL SELECT cd.query, cd.item, 'listeners', s / sqrt(lp.pop) FROM cd JOIN ls ON cd.query = ls.query AND cd.item = ls.item JOIN lp ON lp.item = cd.item
      UNION ALL SELECT cd.query, cd.item, 'graph', s FROM cd JOIN dg2 ON cd.query = dg2.query AND cd.item = dg2.item UNION ALL SELECT cd.query, cd.item, 'walk', p FROM cd JOIN p12 ON cd.query = p12.query AND cd.item = p12.item),
    al AS (SELECT cd.query, cd.item, m.method, round(coalesce(s, 0), 6) AS s FROM cd CROSS JOIN (SELECT DISTINCT method FROM sc2) m LEFT JOIN sc2 ON sc2.query = cd.query AND sc2.item = cd.item AND sc2.method = m.method),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY s DESC, item) AS k FROM al), tg AS (SELECT query, item FROM q WHERE NOT seed), tn AS (SELECT query, count(*) AS n FROM tg GROUP BY 1)
    SELECT method, rk.query, round(count(*) / max(n), 6) AS recall FROM rk JOIN tg ON rk.query = tg.query AND rk.item = tg.item JOIN tn ON rk.query = tn.query WHERE k <= 100 GROUP BY 1, 2""",
)(lambda s, d: _methods(s, d))


def _methods(s, d):
    """Recall at 100 of five methods on the same candidates; what a method does not score counts as 0."""
    q = _queries(s, d)[0]
    seeds, targets = q.where("seed").select("query", "item"), q.where("NOT seed").select("query", "item")
    inc = cut(G.incidence(interactions(s, d), "user"), "incidence")
    owners = inc.groupBy("item").agg(F.count_if(F.col("ctx") % 100 != 0).cast("int").alias("pop"), F.count("*").cast("int").alias("all_pop"))
    known = inc.withColumnRenamed("ctx", "user").join(owners, "item")
    found = R.co_listen(seeds, known.where("user % 100 <> 0"), seeds, ("pop", "all_pop"), known.where("user % 100 = 0"))
    edges = cut(_confident(s, d), "confident")
    valued = edges.select("src", "dst", (F.col("affinity") * F.col("confidence")).alias("value")).where("value > 0")
    signals = {"co_listen": F.round("score", 9), "popularity": F.col("pop"), "listeners": F.col("listeners") / F.sqrt("all_pop")}
    other = {"graph": G.direct_scores(seeds, edges), "walk": G.personalized_pagerank(seeds, valued)}
    graph, walk = (df.select("query", "item", F.lit(name).alias("method"), "score") for name, df in other.items())
    out = R.recalls(found, graph.unionByName(walk), targets, signals, list(other), 100)
    return out.select("method", "query", F.round(F.col("hits") / F.col("targets"), 6).alias("recall"))


query("f20_band_default", X + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), p AS (SELECT item, percent_rank() OVER (ORDER BY users) AS pr FROM u)
 SELECT p_partkey + 0 AS item, CAST(least(9, floor(coalesce(pr, 0.5) * 10)) AS INTEGER) AS band FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 1000000 FROM part WHERE p_partkey < 5) LEFT JOIN p ON item = p_partkey""")(
    lambda s, d: catalog(s, d).select("item").union(catalog(s, d).where("item < 5").select(F.col("item") + 1000000)).join(P.user_percentile(interactions(s, d)), "item", "left").select("item", F.least(F.lit(9), F.floor(F.coalesce("percentile", F.lit(0.5)) * 10)).cast("int").alias("band"))
)


@query("g11_token_shuffle")
def _tokens(s, d):
    return M.token_shuffle(interactions(s, d))


query(
    "g11_kept_counts",
    X + """ SELECT 'item' AS kind, item AS key, count(*) AS n FROM x GROUP BY item UNION ALL SELECT 'context', ctx, count(*) FROM x GROUP BY ctx UNION ALL SELECT 'moved', 1, 1""",
)(lambda s, d: _kept_counts(s, d))


def _kept_counts(s, d):
    """What a shuffle must keep: how often each item occurs, and the length of each context; and that most slots change."""
    x = interactions(s, d).select("ctx", "pos", "item")
    out = cut(M.token_shuffle(x), "shuffled")
    of = lambda kind, c: out.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    same = out.join(x.withColumnRenamed("item", "was"), ["ctx", "pos"]).agg(F.avg((F.col("item") == F.col("was")).cast("double")).alias("share"))
    moved = same.select(F.lit("moved").alias("kind"), F.lit(1).cast("long").alias("key"), (F.col("share") < 0.1).cast("long").alias("n"))
    return of("item", "item").union(of("context", "ctx")).union(moved)


query("g13_canaries", X + ASSOC + """, a AS (SELECT item, artist, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT item, row_number() OVER (PARTITION BY artist ORDER BY n DESC, item) AS k FROM a WHERE artist IN ('Brand#1', 'Brand#2', 'Brand#3')),
 r AS (SELECT src, dst, support, row_number() OVER (PARTITION BY src ORDER BY round(affinity, 9) DESC, dst) AS place FROM g JOIN t ON src = item WHERE k <= 2) SELECT src, dst, support, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")(lambda s, d: _canaries(s, d))


def _canaries(s, d):
    x = interactions(s, d).where(F.col("artist").isin("Brand#1", "Brand#2", "Brand#3")).groupBy("item", "artist").agg(F.count("*").alias("n"))
    top = x.withColumn("k", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("n"), "item"))).where("k <= 2").select(F.col("item").alias("src"))
    e = _graph(s, d)[1].join(top, "src", "left_semi")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("affinity", 9)), "dst"))).where("place <= 10").select("src", "dst", "support", "place")


@query(
    "g7_propagation",
    X + ASSOC + """, t AS (SELECT src, sum(affinity) AS d FROM g GROUP BY src), w AS (SELECT g.src, g.dst, affinity / sqrt(a.d * b.d) AS w FROM g JOIN t a ON g.src = a.src JOIN t b ON g.dst = b.src),
    v0 AS (SELECT p_partkey AS id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM part JOIN embeddings ON p_partkey % 500 = vec_id), h1 AS (SELECT src AS id, d, sum(w * x) AS x FROM w JOIN v0 ON dst = id GROUP BY ALL), h2 AS (SELECT src AS id, d, sum(w * x) AS x FROM w JOIN h1 ON dst = id GROUP BY ALL),
    m AS (SELECT id, d, sum(x) / 3 AS x FROM (SELECT * FROM v0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL) SELECT id, round(max(x) / sqrt(sum(x * x)), 6) AS top FROM m GROUP BY id""",
)
def _propagated(s, d):
    adj = G.adjacency(_graph(s, d)[1])
    v = catalog(s, d).select(F.col("item").alias("id")).join(vectors(s, d).select(F.col("id").alias("v"), "vec"), F.col("id") % 500 == F.col("v")).select("id", "vec")
    return G.propagate(adj, v).select("id", F.round(F.array_max("vec"), 6).alias("top"))
