"""Item graphs over the order lines; flagship recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hex_prefix
from ..operators import graph as G
from ..operators import ranking as R
from ..operators.sessions import eligible
from ..sources.staging import cut
from ..sources.tables import INTERACTIONS, catalog, interactions
from .base import query

X = "WITH " + INTERACTIONS

#: Users and contexts whose distinct items are within bounds, before any pairing.
ELIGIBLE = """, el AS (SELECT * FROM x WHERE "user" IN (SELECT "user" FROM x GROUP BY "user" HAVING count(DISTINCT item) BETWEEN 5 AND 2000) AND ctx IN (SELECT ctx FROM x GROUP BY ctx HAVING count(DISTINCT item) BETWEEN 2 AND 80))"""

ASSOC = ELIGIBLE + """, i AS (SELECT DISTINCT "user" AS ctx, item FROM el),
z AS (SELECT ctx, 1.0 / greatest(count(*) - 1, 1) AS c FROM i GROUP BY ctx), wi AS (SELECT i.ctx, item, CAST(c AS DOUBLE) AS c FROM i JOIN z ON i.ctx = z.ctx),
nn AS (SELECT item, sum(c) AS n FROM wi GROUP BY item),
h AS (SELECT a.item AS src, b.item AS dst, count(*) AS support, sum(a.c) AS s FROM wi a JOIN wi b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY 1, 2 HAVING count(*) >= 3),
g AS (SELECT src, dst, support, s / sqrt(p.n * q.n) AS affinity FROM h JOIN nn p ON src = p.item JOIN nn q ON dst = q.item),
dg AS (SELECT item, count(*) AS deg FROM i GROUP BY item),
cf0 AS (SELECT g.*, p.deg * q.deg / (SELECT count(DISTINCT ctx) FROM i) AS ex FROM g JOIN dg p ON src = p.item JOIN dg q ON dst = q.item),
cf AS (SELECT src, dst, support, affinity, greatest(0, (support - ex) / (support + ex)) * support / (support + 10) AS confidence FROM cf0)
"""


def _graph(s, d):
    """Incidence of users and items, and the associations; both written once, as most queries read them more than once."""
    inc = cut(G.incidence(eligible(interactions(s, d)), "user"), "incidence")
    return inc, cut(G.association(inc), "associations")


def _confident(s, d):
    inc, edges = _graph(s, d)
    return G.confidence(edges, inc)


query("g2_association", X + ASSOC + "SELECT src, dst, support, round(affinity, 6) AS affinity FROM g")(lambda s, d: _graph(s, d)[1].withColumn("affinity", F.round("affinity", 6)))

query("g3_confidence", X + ASSOC + "SELECT src, dst, support, round(confidence, 6) AS confidence FROM cf")(
    lambda s, d: _confident(s, d).select("src", "dst", "support", F.round("confidence", 6).alias("confidence"))
)

query("g1_incidence", X + "SELECT DISTINCT ctx, item FROM x")(lambda s, d: G.incidence(interactions(s, d)))

query(
    "g5_adjacency",
    X + ASSOC + """, t AS (SELECT src, sum(affinity) AS d FROM g GROUP BY src) SELECT g.src, g.dst, round(affinity / sqrt(a.d * b.d), 6) AS weight FROM g JOIN t a ON g.src = a.src JOIN t b ON g.dst = b.src""",
)(lambda s, d: G.adjacency(_graph(s, d)[1]).withColumn("weight", F.round("weight", 6)))


def _core_sql(rounds: int = 12) -> str:
    out, last = ", k0 AS (SELECT DISTINCT ctx, item FROM x)", "k0"
    for r in range(1, rounds + 1):
        out += f", m{r} AS (SELECT * FROM {last} WHERE item IN (SELECT item FROM {last} GROUP BY item HAVING count(*) >= 12)), k{r} AS (SELECT * FROM m{r} WHERE ctx IN (SELECT ctx FROM m{r} GROUP BY ctx HAVING count(*) >= 4))"
        last = f"k{r}"
    return out + f" SELECT ctx, item FROM {last}"


query("g4_supported_core", X + _core_sql(40))(lambda s, d: G.supported_core(G.incidence(interactions(s, d)), 4, 12))


def _seeds(s, d):
    """Half of the items of each user whose id is divisible by 100."""
    x = interactions(s, d).where(F.col("user") % 100 == 0).select(F.col("user").alias("query"), "item").distinct()
    return x.where(hex_prefix(F.col("item")) % 2 == 0)


SEEDS = """, sd AS (SELECT DISTINCT "user" AS query, item FROM x WHERE "user" % 100 = 0 AND CAST('0x' || substr(sha256(CAST(item AS VARCHAR)), 1, 8) AS UBIGINT) % 2 = 0)"""


def _ppr_sql(n: int = 12) -> str:
    out = ", t AS (SELECT src, sum(affinity * confidence) AS t FROM cf GROUP BY src HAVING sum(affinity * confidence) > 0), st AS (SELECT cf.src, dst, affinity * confidence / t AS w FROM cf JOIN t ON cf.src = t.src), s0 AS (SELECT query, item, 1.0 / count(*) OVER (PARTITION BY query) AS p0 FROM sd), p0 AS (SELECT query, item, p0 AS p FROM s0)"
    for i in range(1, n + 1):
        out += f""", b{i} AS MATERIALIZED (SELECT query, sum(p) AS stuck FROM p{i - 1} WHERE item NOT IN (SELECT src FROM st) GROUP BY query),
        p{i} AS MATERIALIZED (SELECT query, item, sum(m) AS p FROM (SELECT query, dst AS item, 0.65 * p * w AS m FROM p{i - 1} JOIN st ON item = src
          UNION ALL SELECT s0.query, item, p0 * (0.35 + 0.65 * coalesce(stuck, 0)) FROM s0 LEFT JOIN b{i} ON s0.query = b{i}.query) GROUP BY query, item)"""
    return out + f" SELECT query, item, round(p, 6) AS score FROM p{n}"


#: The walk's tables up to the last step, p12; needs seeds ``sd`` and the graph.
PPR = _ppr_sql().replace("JOIN t ON cf.src = t.src)", "JOIN t ON cf.src = t.src WHERE affinity * confidence > 0)").rsplit(" SELECT query, item, round(p", 1)[0]


def _ppr(s, d):
    inc, edges = _graph(s, d)
    e = cut(G.confidence(edges, inc)).select("src", "dst", (F.col("affinity") * F.col("confidence")).alias("value")).where("value > 0")
    return G.personalized_pagerank(_seeds(s, d), e).withColumn("score", F.round("score", 6))


query("g6_personalized_pagerank", X + ASSOC + SEEDS + _ppr_sql().replace("JOIN t ON cf.src = t.src)", "JOIN t ON cf.src = t.src WHERE affinity * confidence > 0)"))(_ppr)

query(
    "g9_listener_scores",
    X + SEEDS + """, i AS (SELECT DISTINCT "user" AS ctx, item FROM x), l AS (SELECT ctx, count(*) AS size FROM i GROUP BY ctx), pp AS (SELECT item, count(*) AS pop FROM i GROUP BY item),
    h AS (SELECT query, ctx, count(*) AS hits FROM sd JOIN i ON sd.item = i.item WHERE ctx <> query GROUP BY 1, 2),
    r AS (SELECT query, i.item, sum(hits / sqrt(size)) AS s, count(*) AS support FROM h JOIN l ON h.ctx = l.ctx JOIN i ON h.ctx = i.ctx GROUP BY 1, 2)
    SELECT query, r.item, round(s / sqrt(pop), 6) AS score, support FROM r JOIN pp ON r.item = pp.item""",
)(lambda s, d: G.listener_scores(G.incidence(interactions(s, d), "user"), _seeds(s, d)).withColumn("score", F.round("score", 6)))

query(
    "g12_protected",
    X + ASSOC + SEEDS + """, o AS (SELECT src, dst FROM cf WHERE confidence >= 0.1), f AS (SELECT src, dst FROM cf WHERE confidence >= 0.35)
    SELECT query, dst AS item FROM sd JOIN o ON item = src UNION SELECT query, b.dst FROM sd JOIN f a ON item = a.src JOIN f b ON a.dst = b.src""",
)(lambda s, d: G.protected(_seeds(s, d), cut(_confident(s, d))))

query(
    "g14_direct_scores",
    X + ASSOC + SEEDS + " SELECT query, dst AS item, round(sum(affinity * confidence), 6) AS score, round(max(confidence), 6) AS best, count(*) AS links FROM sd JOIN cf ON item = src GROUP BY 1, 2",
)(lambda s, d: G.direct_scores(_seeds(s, d), _confident(s, d)).withColumn("score", F.round("score", 6)).withColumn("best", F.round("best", 6)))

query("g15_recommendable", X + ASSOC + " SELECT src AS item, round(max(confidence), 6) AS best, max(confidence) >= 0.35 AS recommendable FROM cf GROUP BY src")(
    lambda s, d: _confident(s, d).groupBy(F.col("src").alias("item")).agg(F.max("confidence").alias("best")).select("item", F.round("best", 6).alias("best"), (F.col("best") >= 0.35).alias("recommendable"))
)

query(
    "t2_neighbour_lists",
    X + ASSOC + """, a AS (SELECT p_partkey AS item, p_brand AS artist FROM part), e AS (SELECT src, dst, a.artist = b.artist AS same_artist, affinity FROM g JOIN a ON src = a.item JOIN a b ON dst = b.item),
    r AS (SELECT src, dst, same_artist, CAST(row_number() OVER (PARTITION BY src, same_artist ORDER BY round(affinity, 9) DESC, dst) AS INTEGER) AS place FROM e)
    SELECT * FROM r WHERE place <= CASE WHEN same_artist THEN 8 ELSE 16 END""",
)(lambda s, d: G.neighbour_lists(_graph(s, d)[1].withColumn("affinity", F.round("affinity", 9)), catalog(s, d)))

query(
    "g8_families",
    """WITH RECURSIVE k AS (SELECT p_partkey AS item, p_brand || '|' || p_name AS key FROM part UNION ALL SELECT p_partkey, p_brand || '#' || p_size || '#' || p_type FROM part),
    l AS (SELECT DISTINCT a.item AS a, b.item AS b FROM k a JOIN k b ON a.key = b.key),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT a AS item, min(b) AS family FROM r GROUP BY a""",
)(lambda s, d: _families(s, d))


def _families(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    keys = p.select(F.col("p_partkey").alias("item"), F.explode(F.array(F.concat_ws("|", "p_brand", "p_name"), F.concat_ws("#", "p_brand", F.col("p_size").cast("string"), "p_type"))).alias("key"))
    return G.families(keys)


@query("g10_edge_shuffle")
def _shuffled(s, d):
    e = _graph(s, d)[1].where("src < dst").select("src", "dst")
    return G.shuffled_edges(e)


query(
    "g10_degrees",
    X + ASSOC + """, ed AS (SELECT src, dst FROM g WHERE src < dst), en AS (SELECT src AS item FROM ed UNION ALL SELECT dst FROM ed), dg2 AS (SELECT item, count(*) AS degree FROM en GROUP BY item)
    SELECT item, degree, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM ed) AS distinct_edges, true AS moved FROM dg2""",
)(lambda s, d: _degrees(s, d))


def _degrees(s, d):
    """What a shuffle must keep: each degree, the number of edges, and no edge twice; and that most edges are new."""
    e = cut(_graph(s, d)[1].where("src < dst").select("src", "dst"), "edges")
    out = cut(G.shuffled_edges(e, rounds=8), "shuffled")
    stayed = out.join(e, ["src", "dst"], "left_semi").agg(F.count("*").alias("stayed"))
    whole = out.agg(F.count("*").alias("edges"), F.count_distinct("src", "dst").alias("distinct_edges")).crossJoin(stayed)  # one row each
    whole = whole.select("edges", "distinct_edges", (F.col("stayed") < F.col("edges") / 2).alias("moved"))
    ends = out.select(F.col("src").alias("item")).union(out.select("dst")).groupBy("item").agg(F.count("*").alias("degree"))
    return ends.crossJoin(F.broadcast(whole))  # one row


SPLIT = """, q0 AS (SELECT DISTINCT "user" AS query, item FROM x WHERE "user" % 100 = 0),
q1 AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY sha256(query || ':' || item), item) AS k, count(*) OVER (PARTITION BY query) AS n FROM q0),
q AS (SELECT query, item, k <= floor(n * 0.8) AS seed FROM q1 WHERE n >= 5),
hs AS (SELECT DISTINCT "user", item FROM x WHERE "user" % 100 <> 0), ow AS (SELECT item, count(*) AS owners FROM hs GROUP BY item),
sw AS (SELECT query, q.item AS seed, 1 / sqrt(owners) AS w FROM q JOIN ow ON q.item = ow.item WHERE q.seed),
ev AS (SELECT query, sw.seed, w, hs."user" FROM sw JOIN hs ON sw.seed = hs.item),
sc AS (SELECT query, hs.item, sum(w) AS score, count(DISTINCT seed) AS support FROM ev JOIN hs ON ev."user" = hs."user" GROUP BY 1, 2),
nk AS (SELECT sc.query, sc.item, round(score, 9) AS score, support FROM sc LEFT JOIN q ON q.query = sc.query AND q.item = sc.item AND q.seed WHERE q.item IS NULL)
"""


def _queries(s, d, x=None):
    x = interactions(s, d) if x is None else x
    asked = x.where(F.col("user") % 100 == 0)
    q = R.profile_split(asked, F.sha2(F.concat_ws(":", "user", "item").cast("binary"), 256))
    return q, x.where(F.col("user") % 100 != 0).select("user", "item").distinct()


def _candidates(s, d, x=None, items=None, carry=()):
    """The split and the co-listened items that are no seeds; with ``carry`` columns of ``items``, which the item fixes."""
    q, history = _queries(s, d, x)
    if items is not None:
        history = history.join(items.select("item", *carry), "item")
    seeds = q.where("seed").select("query", "item")
    return q, R.co_listen(seeds, history, seeds, carry).withColumn("score", F.round("score", 9))


query("j8_co_listen", X + SPLIT + "SELECT query, item, round(score, 6) AS score, support FROM nk")(lambda s, d: _candidates(s, d)[1].withColumn("score", F.round("score", 6)))

TOP = """, it AS (SELECT p_partkey AS item, p_brand AS artist, p_brand || '|' || p_name AS identity FROM part),
o1 AS (SELECT nk.*, artist, row_number() OVER (PARTITION BY query, identity ORDER BY score DESC, nk.item) AS k FROM nk JOIN it ON nk.item = it.item),
o2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY query, artist ORDER BY score DESC, item) AS k FROM o1 WHERE k = 1),
o3 AS (SELECT query, item, artist, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM o2 WHERE k <= 2),
top AS (SELECT * FROM o3 WHERE rank <= 40)
"""


def _recommended(s, d, x=None):
    q, found = _candidates(s, d, x)
    items = catalog(s, d).select("item", "artist", F.concat_ws("|", "artist", "title").alias("identity"))
    return q, R.diversified(found, items)


query("flagship_recommendations", X + SPLIT + TOP + "SELECT query, item, artist, round(score, 6) AS score, rank FROM top")(lambda s, d: _recommended(s, d)[1].withColumn("score", F.round("score", 6)))

METRICS = """, tg AS (SELECT query, item FROM q WHERE NOT seed), tn AS (SELECT query, count(*) AS n FROM tg GROUP BY query),
hi AS (SELECT top.query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM top JOIN tg ON top.query = tg.query AND top.item = tg.item GROUP BY 1),
mt AS (SELECT tn.query, coalesce(hits / n, 0) AS recall, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 41) r(i) WHERE i <= n), 0) AS ndcg, coalesce(1 / first, 0) AS mrr, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit FROM tn LEFT JOIN hi ON tn.query = hi.query)
"""


def _measured(s, d):
    q, top = _recommended(s, d)
    return R.metrics(top, q.where("NOT seed"), 40)


query("m1_metrics", X + SPLIT + TOP + METRICS + "SELECT query, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, CAST(hit AS DOUBLE) AS hit FROM mt")(
    lambda s, d: _measured(s, d).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")], "hit")
)

query(
    "m2_candidate_recall",
    X + SPLIT + ", r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS k FROM nk), t AS (SELECT q.query, count(*) AS n, count(*) FILTER (k <= 100) AS a, count(*) FILTER (k <= 500) AS b, count(*) FILTER (k <= 1000) AS c, count(*) FILTER (k <= 2000) AS d FROM q LEFT JOIN r ON q.query = r.query AND q.item = r.item WHERE NOT q.seed GROUP BY 1) SELECT query, n AS targets, a AS at100, b AS at500, c AS at1000, d AS at2000 FROM t",
)(lambda s, d: _recall(s, d))


def _recall(s, d):
    q, found = _candidates(s, d)
    ranked = R.top_k(found, 2000).select("query", "item", "rank")
    j = q.where("NOT seed").select("query", "item").join(ranked, ["query", "item"], "left")
    return j.groupBy("query").agg(F.count("*").alias("targets"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in (100, 500, 1000, 2000)])


query(
    "m5_paired_bootstrap",
    X + SPLIT + TOP + METRICS + """, dl AS (SELECT query, ndcg - recall AS delta, row_number() OVER (ORDER BY query) - 1 AS i FROM mt),
    dr AS (SELECT b, CAST('0x' || substr(sha256(b || ':' || i), 1, 12) AS UBIGINT) % (SELECT count(*) FROM dl) AS i FROM dl, range(0, 2000) r(b)),
    ms AS (SELECT b, avg(delta) AS m FROM dr JOIN dl ON dr.i = dl.i GROUP BY b)
    SELECT round((SELECT avg(delta) FROM dl), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM ms""",
)(lambda s, d: R.paired_bootstrap(_measured(s, d).select("query", (F.col("ndcg") - F.col("recall")).alias("delta"))).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")]))
