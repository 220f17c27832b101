"""Vector queries over the embeddings; queries are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as Q
from ..operators import embeddings as E
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import vectors as V
from ..operators.sessions import window_pairs
from ..sources.staging import cut
from ..sources.tables import INTERACTIONS, interactions, vectors
from .base import query
from .text import FNV

DOT = "(SELECT sum(CAST(u.a AS DOUBLE) * CAST(u.b AS DOUBLE)) FROM (SELECT unnest(q.embedding) AS a, unnest(i.embedding) AS b) u)"
SIM = "WITH s AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)"


def _asked(s, d):
    return vectors(s, d).where(F.col("id") % 100 == 0)


query("v1_nearest", SIM + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM s) SELECT query, item, round(score, 6) AS score, rank FROM r WHERE rank <= 20")(
    lambda s, d: V.nearest(vectors(s, d), _asked(s, d), 20).withColumn("score", F.round("score", 6))
)

query("f13_norms", "SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")(
    lambda s, d: vectors(s, d).select("id", F.round(Q.norm(F.col("vec")), 6).alias("norm"))
)

query(
    "f14_quantize",
    "SELECT vec_id AS id, CAST(sum(q) AS BIGINT) AS total, round(max(abs(q / 127.0 - v)), 6) AS worst FROM (SELECT vec_id, v, round_even(greatest(-1.0, least(1.0, v)) * 127, 0) AS q FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)) GROUP BY 1",
)(
    lambda s, d: vectors(s, d).select("id", "vec", Q.quantize(F.col("vec")).alias("q")).select(
        "id",
        F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.round(F.array_max(F.zip_with(Q.dequantize(F.col("q")), F.col("vec").cast("array<double>"), lambda a, b: F.abs(a - b))), 6).alias("worst"),
    )
)

query(
    "f17_standardized",
    """WITH l AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY d),
    z AS (SELECT id, greatest(-5, least(5, (x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END)) AS x FROM l JOIN m ON l.d = m.d)
    SELECT id, round(max(x) / sqrt(sum(x * x)), 5) AS top FROM z GROUP BY id""",
)(lambda s, d: V.standardized(vectors(s, d)).select("id", F.round(F.array_max("vec"), 5).alias("top")))

query(
    "d6_group_means",
    """WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM l GROUP BY 1, 2)
    SELECT label, round(max(x) / sqrt(sum(x * x)), 5) AS top FROM m GROUP BY label""",
)(lambda s, d: V.group_means(vectors(s, d), "label").select("label", F.round(F.array_max("vec"), 5).alias("top")))

query(
    "v8_collapse_check",
    "SELECT d - 1 AS dim, round(stddev_pop(x), 6) AS std FROM (SELECT generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d",
)(lambda s, d: V.collapse_check(vectors(s, d)).withColumn("std", F.round("std", 6)))

query(
    "v9_same_label_rank",
    SIM + """, r AS (SELECT s.query, item, score, e.label = f.label AS same, row_number() OVER (PARTITION BY s.query ORDER BY score DESC, item) AS rank FROM s JOIN embeddings e ON s.query = e.vec_id JOIN embeddings f ON s.item = f.vec_id WHERE s.query <> item)
    SELECT query, min(rank) AS first_rank, min(rank) <= 1 AS at1, min(rank) <= 5 AS at5 FROM r WHERE same GROUP BY query""",
)(lambda s, d: _same_label(s, d))


def _pairs(s, d):
    """The stated query set against all rows."""
    met = V.products(vectors(s, d), _asked(s, d))
    return met.select(F.col("q.id").alias("query"), F.col("id").alias("item"), F.col("q.label").alias("ql"), "label", F.round(Q.dot(F.col("q.vec"), F.col("vec")), 9).alias("score"))


def _same_label(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    r = _pairs(s, d).where("query <> item").withColumn("rank", F.row_number().over(w)).where("ql = label")
    return r.groupBy("query").agg(F.min("rank").alias("first_rank")).select("query", F.col("first_rank").cast("long").alias("first_rank"), (F.col("first_rank") <= 1).alias("at1"), (F.col("first_rank") <= 5).alias("at5"))


query(
    "v10_weakest_dropped",
    SIM + ", c AS (SELECT query, quantile_cont(score, 0.2) AS cut FROM s GROUP BY query) SELECT s.query, item, round(score, 6) AS sim FROM s JOIN c ON s.query = c.query WHERE score >= cut",
)(lambda s, d: V.weakest_left_out(vectors(s, d), _asked(s, d)).withColumn("sim", F.round("sim", 6)))

query(
    "r5_target_relevance",
    """WITH s AS (SELECT i.label AS query, q.vec_id AS seed, i.vec_id AS item, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) AS sim FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY sim DESC, seed) AS k FROM s), b AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY query, item)) / 0.12) AS e FROM r WHERE k <= 8)
    SELECT query, item, round(sum(e * sim) / sum(e), 6) AS relevance FROM b GROUP BY 1, 2""",
)(lambda s, d: _relevance(s, d))


def _relevance(s, d):
    """Every row as a query for its most similar seeds, so that only those are rows."""
    v = vectors(s, d)
    best = V.nearest(_asked(s, d), v, 8).select(F.col("query").alias("id"), F.col("item").alias("seed"), F.col("score").alias("sim"))
    pairs = best.join(v.select("id", F.col("label").alias("query")), "id").select("query", "seed", F.col("id").alias("item"), "sim")
    return V.target_relevance(pairs).withColumn("relevance", F.round("relevance", 6))


def _members(s, d):
    return vectors(s, d).select(F.col("label").cast("long").alias("query"), "id", "vec")


@query("v3_interest_heads")
def _heads(s, d):
    return V.interest_heads(_members(s, d)).select("query", "head", "size", F.round(Q.norm(F.col("vec")), 6).alias("norm"))


query(
    "v3_head_sizes",
    """WITH n AS (SELECT CAST(label AS BIGINT) AS query, count(*) AS n FROM embeddings GROUP BY 1) SELECT query, n AS members, CAST(least(n, greatest(2, least(12, ceil(sqrt(n))))) AS BIGINT) AS heads, true AS unit FROM n""",
)(lambda s, d: V.interest_heads(_members(s, d)).groupBy("query").agg(F.sum("size").cast("long").alias("members"), F.count_distinct("head").alias("heads"), F.bool_and(F.abs(Q.norm(F.col("vec")) - 1) < 1e-9).alias("unit")))


@query("v11_head_checks")
def _checks(s, d):
    return V.head_checks(_members(s, d), V.interest_heads).select("query", "same", (F.col("separation") < 0.95).alias("apart"), F.round("matched", 4).alias("matched"))


query(
    "v2_attention_pool",
    """WITH h AS (SELECT vec_id AS head, CAST(embedding AS DOUBLE[]) AS h FROM embeddings WHERE vec_id < 4), s AS (SELECT label AS query, head, CAST(embedding AS DOUBLE[]) AS v, list_dot_product(h, CAST(embedding AS DOUBLE[])) / 8 AS s FROM embeddings, h),
    e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY query, head)) AS e FROM s), l AS (SELECT query, head, generate_subscripts(v, 1) AS d, unnest(v) * e AS x, e FROM e), m AS (SELECT query, head, d, sum(x) / sum(e) AS x FROM l GROUP BY ALL) SELECT query, head, round(max(x) / sqrt(sum(x * x)), 6) AS top FROM m GROUP BY 1, 2""",
)(lambda s, d: V.attention_pool(vectors(s, d).select(F.col("label").alias("query"), "id", "vec"), vectors(s, d).where("id < 4").select(F.col("id").alias("head"), "vec")).select("query", "head", F.round(F.array_max("vec"), 6).alias("top")))

#: Sixteen centers of a routing model, by rule: center i has 1 at place i and 0.5 at place 2 i + 16.
CENTERS = [[1.0 if k == i else 0.5 if k == 2 * i + 16 else 0.0 for k in range(64)] for i in range(16)]


def _routing_sql() -> str:
    out = f"""WITH c0 AS (SELECT generate_subscripts(c, 1) - 1 AS head, unnest(c) AS c FROM (SELECT {CENTERS} AS c)), cn AS (SELECT head, c, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM c0),
    m AS (SELECT label AS query, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v0 FROM embeddings), mu AS (SELECT query, id, list_transform(v0, lambda x: x / sqrt(list_dot_product(v0, v0))) AS v FROM m), k0 AS (SELECT DISTINCT query, head, u FROM mu, cn)"""
    for r in range(3):
        out += f""", s{r} AS (SELECT mu.query, id, head, v, list_dot_product(u, v) / 0.1 AS s FROM mu JOIN k{r} k ON mu.query = k.query), e{r} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM s{r}), p{r} AS (SELECT query, id, head, v, e / sum(e) OVER (PARTITION BY id) AS p FROM e{r})"""
        if r < 2:
            out += f""", t{r} AS (SELECT query, head, d, sum(x) AS x FROM (SELECT query, head, generate_subscripts(v, 1) AS d, unnest(v) * p AS x FROM p{r}) GROUP BY ALL), z{r} AS (SELECT query, t.head, list(x + 0.1 * c[d] ORDER BY d) AS z FROM t{r} t JOIN cn ON t.head = cn.head GROUP BY ALL),
    k{r + 1} AS (SELECT query, head, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS u FROM z{r})"""
    return out + """, tp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, head) AS k FROM p2), ms AS (SELECT query, CAST(head AS INTEGER) AS head, round(avg(p), 6) AS mass, bool_or(k = 1) AS active FROM tp GROUP BY ALL),
    l AS (SELECT query, head, d, sum(x) AS x FROM (SELECT query, head, generate_subscripts(v, 1) AS d, unnest(v) * p AS x FROM p2) GROUP BY ALL), tt AS (SELECT query, head, round(max(x) / sqrt(sum(x * x)), 5) AS top FROM l GROUP BY 1, 2)
    SELECT ms.query, ms.head, mass, active, top FROM ms JOIN tt ON ms.query = tt.query AND ms.head = tt.head"""


query("v4_interest_routing", _routing_sql())(lambda s, d: V.interest_routing(vectors(s, d).select(F.col("label").alias("query"), "id", "vec"), CENTERS).select("query", "head", F.round("mass", 6).alias("mass"), "active", F.round(F.array_max("vec"), 5).alias("top")))

_P1 = [[((i * 3 + o * 5) % 13 - 6) / 20 for i in range(65)] for o in range(32)]
_P2 = [[((i * 7 + o) % 11 - 5) / 10 for i in range(32)] for o in range(16)]
_GELU = "0.5 * {0} * (1 + tanh(0.7978845608028654 * ({0} + 0.044715 * {0} * {0} * {0})))"
query(
    "v6_projected",
    f"""WITH v AS (SELECT vec_id AS id, list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), label / 10.0) AS v FROM embeddings), a AS (SELECT id, list_transform({_P1}, lambda w: list_dot_product(w, v)) AS a FROM v), b AS (SELECT id, list_transform(a, lambda x: {_GELU.format("x")}) AS b FROM a),
    c AS (SELECT id, list_transform(list_transform({_P2}, lambda w: list_dot_product(w, b)), lambda x: {_GELU.format("x")}) AS c FROM b) SELECT id, round(list_max(c) / sqrt(list_dot_product(c, c)), 5) AS top, round(c[1] / sqrt(list_dot_product(c, c)), 5) AS first FROM c""",
)(lambda s, d: _projected(s, d))


def _projected(s, d):
    from ..operators.discovery import projected

    v = vectors(s, d).select("id", F.array_append(F.col("vec").cast("array<double>"), F.col("label") / 10.0).alias("v"))
    return v.select("id", projected(F.col("v"), [(_P1, [0.0] * 32), (_P2, [0.0] * 16)]).alias("p")).select("id", F.round(F.array_max("p"), 5).alias("top"), F.round(F.col("p")[0], 5).alias("first"))


@query("v8_covariance_rank")
def _rank(s, d):
    v = vectors(s, d)
    return v.agg(F.count("*").alias("rows")).withColumn("rank", F.lit(V.covariance_rank(v)))


_W = (
    "WITH "
    + INTERACTIONS
    + """, o AS (SELECT ctx, item, row_number() OVER (PARTITION BY ctx ORDER BY pos, item) AS k FROM x), p AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM o a JOIN o b ON a.ctx = b.ctx AND a.k <> b.k AND abs(a.k - b.k) <= 5 GROUP BY 1, 2),
    m AS (SELECT a, sum(n) AS n FROM p GROUP BY a) SELECT p.a, p.b, round(ln(p.n * (SELECT sum(n) FROM p) / (ma.n * mb.n)), 6) AS value FROM p JOIN m ma ON p.a = ma.a JOIN m mb ON p.b = mb.a WHERE p.n * (SELECT sum(n) FROM p) > ma.n * mb.n"""
)
query("v7_ppmi", _W)(lambda s, d: E.ppmi(window_pairs(interactions(s, d))).withColumn("value", F.round("value", 6)))


@query("v7_session_embeddings")
def _embedded(s, d):
    vec, _ = E.factored(E.ppmi(window_pairs(interactions(s, d))))
    return vec.select(F.col("id").alias("item"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("v7_embedding_metrics")
def _embedding_metrics(s, d):
    """Vectors of sessions, and of sessions with their items shuffled, by what they find of withheld items: per query of users
    whose id is divisible by 100, the 40 items nearest to the mean of its seeds that are not among them."""
    x = interactions(s, d)
    q = R.profile_split(x.where(F.col("user") % 100 == 0), F.sha2(F.concat_ws(":", "user", "item").cast("binary"), 256))
    seeds, targets = q.where("seed").select("query", "item"), q.where("NOT seed").select("query", "item")
    seen = cut(x.join(targets.select(F.col("query").alias("user"), "item"), ["user", "item"], "left_anti").select("ctx", "pos", "item"), "seen")
    return E.retrieval(seen, seeds, targets, 40).unionByName(E.retrieval(M.token_shuffle(seen), seeds, targets, 40).withColumn("shuffled", F.lit(True)))


_W5 = [[((i * 5 + o * 3) % 17 - 8) / 10 for i in range(32)] for o in range(8)]
_RULE = "list_transform(range(8), lambda k: ({0} * (k + 3) * 7919) % 1000 / 500.0 - 1)"
query(
    "v5_encoded_tracks",
    f"""WITH g AS (SELECT DISTINCT item, field, substr(t, i, n) AS gram FROM (SELECT p_partkey AS item, 'a' AS field, '^' || p_brand || '$' AS t FROM part UNION ALL SELECT p_partkey, 't', '^' || p_name || '$' FROM part), range(3, 6) r(n), range(1, 200) s(i) WHERE i + n - 1 <= len(t)),
    b AS (SELECT DISTINCT item, field, CAST({FNV.format('gram')} % 4096 AS BIGINT) AS bucket FROM g), x AS (SELECT item, field, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM (SELECT item, field, {_RULE.format('bucket')} AS v FROM b)),
    m AS (SELECT item, field, list(x ORDER BY d) AS v FROM (SELECT item, field, d, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL), ar AS (SELECT p_brand AS key, row_number() OVER (ORDER BY p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part)), ti AS (SELECT p_name AS key, row_number() OVER (ORDER BY p_name) AS n FROM (SELECT DISTINCT p_name FROM part)),
    f AS (SELECT p_partkey AS item, list_concat(list_concat({_RULE.format('ar.n')}, CASE WHEN ti.n % 3 = 0 THEN list_transform(range(8), lambda k: 0.0) ELSE {_RULE.format('ti.n')} END), list_concat(ma.v, mt.v)) AS f FROM part JOIN ar ON ar.key = p_brand JOIN ti ON ti.key = p_name JOIN m ma ON ma.item = p_partkey AND ma.field = 'a' JOIN m mt ON mt.item = p_partkey AND mt.field = 't'),
    z AS (SELECT item, list_transform({_W5}, lambda w: tanh(list_dot_product(CAST(w AS DOUBLE[]), CAST(f AS DOUBLE[])))) AS z FROM f) SELECT item, round(list_max(z) / sqrt(list_dot_product(z, z)), 5) AS top, round(z[1] / sqrt(list_dot_product(z, z)), 5) AS first FROM z""",
)(lambda s, d: _encoded(s, d))


def _encoded(s, d):
    """A model's tables by rule; every third title is outside its vocabulary."""
    from ..functions.hashing import subword_ids
    from ..operators.discovery import encoded_tracks
    from ..operators.numbering import numbered
    from ..sources.tables import catalog

    c = catalog(s, d)
    rule = lambda n: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (n * (k + 3) * 7919) % 1000 / 500.0 - 1)
    table_of = lambda name: numbered(c.select(F.col(name).alias("key")).distinct(), ["key"], "n").select("key", F.col("n") + 1)
    artists = table_of("artist").toDF("key", "n").select("key", rule(F.col("n")).alias("vec"))
    titles = table_of("title").toDF("key", "n").where("n % 3 <> 0").select("key", rule(F.col("n")).alias("vec"))
    grams = s.range(4096).select(F.col("id").alias("bucket"), rule(F.col("id")).alias("vec"))
    rows = c.select("item", "artist", "title", subword_ids(F.col("artist")).alias("artist_grams"), subword_ids(F.col("title")).alias("title_grams"))
    return encoded_tracks(rows, artists, titles, grams, _W5, [0.0] * 8).select("item", F.round(F.array_max("vec"), 5).alias("top"), F.round(F.col("vec")[0], 5).alias("first"))
