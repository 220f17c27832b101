"""Fits, blends and evaluation over order lines and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import dot, unit
from ..operators import ranking as R
from ..operators.vectors import products
from ..sources.staging import cut
from ..operators import scoring as S
from ..sources.tables import INTERACTIONS, LISTENS, interactions, vectors
from .base import query
from .graph import ASSOC, SPLIT, _candidates

X = "WITH " + INTERACTIONS


def _blend_input(s, d):
    from pyspark.sql import Window

    q, found = _candidates(s, d)
    w = Window.partitionBy("query")
    pr = lambda c: 1 - (F.row_number().over(w.orderBy(F.desc(c), "item")) - 1) / (F.count("*").over(w) - 1)
    return q.where("NOT seed").select("query", "item"), found.select("query", "item", pr("score").alias("a"), pr("support").alias("b"))


_BLEND = X + SPLIT + """, p AS (SELECT query, item, 1 - (row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1) / (count(*) OVER (PARTITION BY query) - 1) AS a, 1 - (row_number() OVER (PARTITION BY query ORDER BY support DESC, item) - 1) / (count(*) OVER (PARTITION BY query) - 1) AS b FROM nk),
tg AS (SELECT query, item FROM q WHERE NOT seed), tn AS (SELECT query, count(*) AS n FROM tg GROUP BY 1)"""


@query(
    "r14_best_alpha",
    _BLEND + """, al AS (SELECT z / 10.0 AS alpha FROM range(1, 10) r(z)), rk AS (SELECT alpha, query, item, row_number() OVER (PARTITION BY alpha, query ORDER BY round(alpha * a + (1 - alpha) * b, 9) DESC, item) AS k FROM p, al),
    dc AS (SELECT alpha, rk.query, sum(1 / log2(k + 1)) AS dcg FROM rk JOIN tg ON rk.query = tg.query AND rk.item = tg.item WHERE k <= 20 GROUP BY 1, 2), nd AS (SELECT al.alpha, avg(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) r(i) WHERE i <= n), 0)) AS ndcg FROM tn CROSS JOIN al LEFT JOIN dc ON dc.query = tn.query AND dc.alpha = al.alpha GROUP BY 1)
    SELECT CAST(alpha AS DOUBLE) AS alpha, round(ndcg, 6) AS ndcg FROM nd ORDER BY round(ndcg, 9) DESC, alpha LIMIT 1""",
)
def _alpha(s, d):
    targets, scored = _blend_input(s, d)
    return S.best_alpha(scored, targets, [i / 10 for i in range(1, 10)]).select("alpha", F.round("ndcg", 6).alias("ndcg"))


_SCORED = "(VALUES ('score', nk.score), ('support', CAST(nk.support AS DOUBLE)), ('damped', nk.score / sqrt(1 + nk.support)))"

query(
    "d1_scorers",
    X + SPLIT + f""", tg AS (SELECT query, item FROM q WHERE NOT seed), tn AS (SELECT query, count(*) AS n FROM tg GROUP BY 1), rk AS (SELECT v.scorer, nk.query, nk.item, row_number() OVER (PARTITION BY v.scorer, nk.query ORDER BY v.s DESC, nk.item) AS rank FROM nk, {_SCORED} v(scorer, s)),
    hi AS (SELECT scorer, rk.query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM rk JOIN tg ON rk.query = tg.query AND rk.item = tg.item WHERE rank <= 20 GROUP BY 1, 2),
    al AS (SELECT scorer, query, n FROM tn, (VALUES ('score'), ('support'), ('damped')) s(scorer)), mt AS (SELECT al.scorer, coalesce(hits / n, 0) AS recall, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) r(i) WHERE i <= n), 0) AS ndcg, coalesce(1 / first, 0) AS mrr, CASE WHEN hits > 0 THEN 1.0 ELSE 0 END AS hit FROM al LEFT JOIN hi ON al.scorer = hi.scorer AND al.query = hi.query)
    SELECT scorer, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM mt GROUP BY scorer""",
)(lambda s, d: _scorers(s, d))


def _scorers(s, d):
    """Co-listening candidates under three scorers, each a function of the candidates."""
    q, found = _candidates(s, d)
    scorers = {"score": lambda c: c["score"], "support": lambda c: c["support"], "damped": lambda c: c["score"] / F.sqrt(1 + c["support"])}
    m = S.evaluated(found, q.where("NOT seed").select("query", "item"), scorers, 20)
    return m.select("scorer", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "hit")])


#: A ranker's layers by rule: 64 inputs, 8 hidden, one output.
_R2 = [([[((i * 7 + o * 11) % 19 - 9) / 10 for i in range(64)] for o in range(8)], [(o - 4) / 10 for o in range(8)]), ([[(o % 3 - 1) / 2 + 0.1 for o in range(8)]], [0.05])]
query(
    "r2_mlp",
    f"""WITH v AS (SELECT vec_id AS item, label / 10.0 AS base, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    h AS (SELECT item, base, list_transform(list_zip({_R2[0][0]}, {_R2[0][1]}), lambda w: greatest(0, list_dot_product(CAST(w[1] AS DOUBLE[]), v) + w[2])) AS h FROM v),
    o AS (SELECT item, base, list_dot_product(CAST({_R2[1][0][0]} AS DOUBLE[]), list_transform(h, lambda x: CAST(x AS DOUBLE))) + 0.05 AS o FROM h)
    SELECT item, round(o, 5) AS output, round(base + 2 * tanh(o), 5) AS score FROM o""",
)(lambda s, d: _ranked_by_net(s, d))


def _ranked_by_net(s, d):
    v = vectors(s, d).select(F.col("id").alias("item"), (F.col("label") / 10.0).alias("base"), F.col("vec").alias("features"))
    out = S.mlp(v, _R2).withColumnRenamed("score", "output")
    return S.residual(out, ["output"], [1.0]).select("item", F.round("output", 5).alias("output"), F.round("score", 5).alias("score"))


def _pairwise_sql(steps: int = 10) -> str:
    """The same Newton steps over all pairs; two coefficients by Cramer's rule."""
    out = _BLEND + ", ps AS (SELECT p.* FROM p JOIN tg ON p.query = tg.query AND p.item = tg.item), ng AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.query = p.query AND tg.item = p.item)), d AS MATERIALIZED (SELECT ng.a - ps.a AS x, ng.b - ps.b AS y FROM ps JOIN ng ON ps.query = ng.query), w0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"
    for k in range(steps):
        out += f""", s{k} AS (SELECT x, y, u, v, 1 / (1 + exp(-(u * x + v * y))) AS s FROM d, w{k}), g{k} AS (SELECT u, v, avg(s * x) + 1e-4 * u AS g1, avg(s * y) + 1e-4 * v AS g2, avg(s * (1 - s) * x * x) + 1e-4 AS h11, avg(s * (1 - s) * x * y) AS h12, avg(s * (1 - s) * y * y) + 1e-4 AS h22 FROM s{k} GROUP BY u, v),
    w{k + 1} AS MATERIALIZED (SELECT u - (g1 * h22 - g2 * h12) / (h11 * h22 - h12 * h12) AS u, v - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS v FROM g{k})"""
    return out + f", r AS (SELECT query, item, u * a + v * b AS score, row_number() OVER (PARTITION BY query ORDER BY round(u * a + v * b, 9) DESC, item) AS rank FROM p, w{steps}) SELECT query, item, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40"


@query("r11_pairwise_ranker", _pairwise_sql())
def _pairwise(s, d):
    """Every candidate scored by a ranker that is fitted on each query's targets against all its other candidates."""
    q, found = _candidates(s, d)
    rows = cut(S.placed(found, q.where("NOT seed").select("query", "item"), ["score", "support"]), "placed")
    weights = S.pairwise_ranker(rows, ["score", "support"])
    best = S.best_placed(rows, ["score", "support"], weights, 40).select("query", "item", F.col("score").alias("a"), F.col("support").alias("b"))
    ranked = S.linear(best, ["a", "b"], weights).withColumn("score", F.round("score", 9))
    return R.top_k(ranked, 40).select("query", "item", F.round("score", 4).alias("score"), "rank")


@query(
    "m4_sampled_ranking",
    X + """, kn AS (SELECT DISTINCT "user" AS query, item FROM x), us AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), pl AS (SELECT item, row_number() OVER (ORDER BY users DESC, item) AS place FROM us),
    rk AS (SELECT place - row_number() OVER (PARTITION BY query ORDER BY place) + 1 AS rank FROM kn JOIN pl ON kn.item = pl.item)
    SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM rk""",
)
def _sampled(s, d):
    """Every user's items by popularity, each among all items that the user does not know."""
    known = cut(interactions(s, d).select(F.col("user").alias("query"), "item").distinct(), "known")
    popular = known.groupBy("item").agg(F.count("*").cast("double").alias("score"))
    return S.ranking_metrics(S.whole_ranking(known, popular, known)).select(*[F.round(c, 6).alias(c) for c in ("hit", "mrr", "ndcg")])


@query(
    "m14_contrastive_loss",
    """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v), p AS (SELECT a.id, a.v AS a, b.v AS b, (row_number() OVER (ORDER BY sha256(CAST(a.id AS VARCHAR)), a.id) - 1) // 1024 AS batch FROM u a JOIN u b ON b.id = a.id + 1),
    s AS (SELECT x.batch, x.id, y.id = x.id AS own, list_dot_product(x.a, y.b) / 0.07 AS s FROM p x JOIN p y ON x.batch = y.batch), r AS (SELECT batch, id, ln(sum(exp(s))) - max(s) FILTER (own) AS loss FROM s GROUP BY 1, 2)
    SELECT batch, round(avg(loss), 5) AS loss FROM r GROUP BY 1""",
)
def _contrast(s, d):
    v = vectors(s, d)
    pairs = v.select("id", unit(F.col("vec")).alias("a")).join(v.select((F.col("id") - 1).alias("id"), unit(F.col("vec")).alias("b")), "id")
    return S.contrastive_loss(pairs).withColumn("loss", F.round("loss", 5))


query(
    "r8_joint_scores",
    """WITH s AS (SELECT i.vec_id AS item, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0),
    f AS (SELECT item, max(sim) AS a, avg(sim) AS b FROM s GROUP BY item)
    SELECT item, round(0.7 * greatest(0, a - 0.2 * b + 0.1) - 0.4 * greatest(0, b - a) + 0.05, 5) AS score FROM f""",
)(lambda s, d: _joint(s, d))


def _joint(s, d):
    sim = products(vectors(s, d), vectors(s, d).where("id % 100 = 0")).withColumn("sim", dot(F.col("q.vec"), F.col("vec")))
    f = sim.groupBy(F.col("id").alias("item")).agg(F.array(F.max("sim"), F.avg("sim")).alias("features"))
    layers = [([[1.0, -0.2], [-1.0, 1.0]], [0.1, 0.0]), ([[0.7, -0.4]], [0.05])]
    return S.mlp(f, layers).select("item", F.round("score", 5).alias("score"))


query(
    "m3_long_tail",
    X + SPLIT + """, u AS (SELECT item, count(*) AS pop FROM hs GROUP BY item), c AS (SELECT quantile_cont(pop, 0.5) AS m FROM u), tg AS (SELECT query, q.item FROM q JOIN u ON q.item = u.item, c WHERE NOT seed AND pop <= m),
    r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS k FROM nk)
    SELECT tg.query, count(*) AS targets, count(*) FILTER (k <= 200) AS found FROM tg LEFT JOIN r ON tg.query = r.query AND tg.item = r.item GROUP BY 1""",
)(lambda s, d: _tail(s, d))


def _tail(s, d):
    from .graph import _queries

    q, history = _queries(s, d)
    pop = history.groupBy("item").agg(F.count("*").alias("pop"))
    tail = pop.crossJoin(F.broadcast(pop.agg(F.percentile("pop", F.lit(0.5)).alias("m")))).where("pop <= m").select("item")  # one row
    ranked = R.top_k(_candidates(s, d)[1], 200).select("query", "item", "rank")
    return q.where("NOT seed").join(tail, "item", "left_semi").select("query", "item").join(ranked, ["query", "item"], "left").groupBy("query").agg(F.count("*").alias("targets"), F.count("rank").alias("found"))


query(
    "r6_feedback_adjusted",
    """WITH sc AS (SELECT vec_id % 5 AS query, vec_id AS item, label / 10.0 AS score FROM embeddings), fb AS (SELECT vec_id % 5 AS query, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'like' ELSE 'dislike' END AS action, embedding AS fv FROM embeddings WHERE vec_id % 100 < 5),
    j AS (SELECT sc.query, sc.item, sc.score, action, (1 + list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(fv AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(fv AS DOUBLE[]), CAST(fv AS DOUBLE[]))))) / 2 AS sim FROM sc JOIN embeddings e ON sc.item = e.vec_id LEFT JOIN fb ON sc.query = fb.query)
    SELECT query, item, round(score + 0.5 * (coalesce(max(sim) FILTER (action = 'like'), 0) - coalesce(max(sim) FILTER (action = 'dislike'), 0)), 5) AS score FROM j GROUP BY query, item, j.score""",
)(lambda s, d: _adjusted(s, d))


def _adjusted(s, d):
    v = vectors(s, d)
    scored = v.select((F.col("id") % 5).alias("query"), F.col("id").alias("item"), (F.col("label") / 10.0).alias("score"))
    fb = v.where("id % 100 < 5").select((F.col("id") % 5).alias("query"), F.col("id").alias("item"), F.when(F.col("id") % 2 == 0, "like").otherwise("dislike").alias("action"))
    return S.feedback_adjusted(scored, fb, v.select(F.col("id").alias("item"), unit(F.col("vec")).alias("vec"))).withColumn("score", F.round("score", 5))




query(
    "r15_calibrated",
    X + SPLIT + ASSOC + """, tg AS (SELECT query, item FROM q WHERE NOT seed), tn AS (SELECT query, count(*) AS n FROM tg GROUP BY 1), se AS (SELECT c.c AS confidence, r.r AS radius FROM (VALUES (0.2), (0.35)) c(c), (VALUES (-0.1), (0.0), (0.25)) r(r)),
    e AS (SELECT src, dst, cf.confidence AS conf, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM cf LEFT JOIN embeddings a ON src = a.vec_id LEFT JOIN embeddings b ON dst = b.vec_id WHERE cf.confidence >= 0.2),
    cn AS (SELECT DISTINCT se.confidence, se.radius, query, dst AS item FROM q JOIN e ON q.item = src JOIN se ON conf >= se.confidence AND coalesce(round(sim, 9), 1) >= se.radius WHERE seed), ht AS (SELECT confidence, radius, cn.query, count(*) AS size, count(tg.item) AS hits FROM cn LEFT JOIN tg ON cn.query = tg.query AND cn.item = tg.item GROUP BY ALL),
    rs AS (SELECT se.confidence, se.radius, round(avg(coalesce(hits / n, 0)), 6) AS recall, round(avg(coalesce(size, 0)), 6) AS size FROM tn CROSS JOIN se LEFT JOIN ht ON ht.query = tn.query AND ht.confidence = se.confidence AND ht.radius = se.radius GROUP BY 1, 2)
    SELECT CAST(confidence AS DOUBLE) AS confidence, CAST(radius AS DOUBLE) AS radius, recall, size, recall >= 0.01 AND row_number() OVER (ORDER BY recall < 0.01, size, recall DESC, confidence, radius) = 1 AS at_01,
      recall >= 0.35 AND row_number() OVER (ORDER BY recall < 0.35, size, recall DESC, confidence, radius) = 1 AS at_35, recall >= 0.6 AND row_number() OVER (ORDER BY recall < 0.6, size, recall DESC, confidence, radius) = 1 AS at_60 FROM rs""",
)(lambda s, d: _calibrated(s, d))


def _calibrated(s, d):
    """Every setting of the grid of confidences and radii, and which of them is chosen at a floor of 0.01, of 0.35 and of the
    operator's own 0.6. Edges meet the vectors only where they start at a seed."""
    from .graph import _confident, _queries

    q = _queries(s, d)[0]
    v = vectors(s, d).select("id", "vec")
    sources = q.where("seed").select(F.col("item").alias("src")).distinct()
    e = _confident(s, d).where("confidence >= 0.2").join(sources, "src", "left_semi").join(v.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("vec").alias("b")), "dst", "left")
    e = e.select("src", "dst", F.col("confidence").alias("conf"), F.coalesce(F.round(dot(F.col("a"), F.col("b")), 9), F.lit(1.0)).alias("sim"))
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), F.lit(r).alias("radius")) for c in (0.2, 0.35) for r in (-0.1, 0.0, 0.25)])).alias("g")
    targets = q.where("NOT seed").select("query", "item")
    found = q.where("seed").select("query", F.col("item").alias("src")).join(e, "src").select("query", F.col("dst").alias("item"), "conf", "sim", grid).where("conf >= g.confidence AND sim >= g.radius").select("query", "item", "g.*").distinct()
    hits = found.join(targets.withColumn("hit", F.lit(1)), ["query", "item"], "left").groupBy("query", "confidence", "radius").agg(F.count("*").alias("size"), F.count("hit").alias("hits"))
    n = targets.groupBy("query").agg(F.count("*").alias("n")).select("query", "n", grid).select("query", "n", "g.*")
    each = n.join(hits, ["query", "confidence", "radius"], "left").na.fill(0)
    results = each.groupBy("confidence", "radius").agg(F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"), F.round(F.avg("size"), 6).alias("size"))
    results, setting = cut(results, "settings"), ["confidence", "radius"]
    for name, floor in (("at_01", 0.01), ("at_35", 0.35), ("at_60", 0.6)):
        best = S.calibrated(results.select(*setting, "recall", "size"), setting, floor).select(*setting, F.lit(True).alias(name))
        results = results.join(best, setting, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return results


def _rated(s, d):
    """Ratings are a user's clicks and purchases against its other events, five of them an exposure."""
    from pyspark.sql import Window

    from ..sources.tables import listens

    e = listens(s, d).where("item IS NOT NULL").withColumn("f1", F.col("item") / 100.0).withColumn("f2", (F.col("item") % 7) / 7.0)
    pop = e.groupBy("item").agg(F.log1p(F.count("*")).alias("score"))
    nth = F.row_number().over(Window.partitionBy("user").orderBy("event_id")) - 1
    rated = e.withColumn("exposure", F.floor(nth / 5)).join(pop, "item")
    rated = rated.select(F.col("user").alias("query"), F.col("event_id").alias("id"), F.col("event_id").alias("sequence"), "exposure", F.col("action").isin("click", "purchase").cast("double").alias("label"), "score", "f1", "f2")
    scores = e.select(F.col("user").alias("query"), "item", "f1", "f2").distinct().join(pop, "item")
    return rated, scores


def _personal_sql(steps: int = 8) -> str:
    """The same fits by Newton steps, with the three equations of two features and a bias solved by Cramer's rule."""
    out = "WITH " + LISTENS + """, ev AS (SELECT "user" AS query, event_id AS id, item, action, item / 100.0 AS f1, (item % 7) / 7.0 AS f2, (row_number() OVER (PARTITION BY "user" ORDER BY event_id) - 1) // 5 AS exposure FROM e WHERE item IS NOT NULL),
    pop AS (SELECT item, ln(1 + count(*)) AS score FROM ev GROUP BY item), rt AS (SELECT ev.*, score, CASE WHEN action IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM ev JOIN pop ON ev.item = pop.item),
    n AS (SELECT query, count(*) AS n FROM rt GROUP BY query HAVING count(*) >= 20 AND sum(y) >= 5 AND count(*) - sum(y) >= 5 AND count(DISTINCT exposure) >= 3),
    bk AS (SELECT rt.*, n, row_number() OVER (PARTITION BY rt.query ORDER BY id DESC) AS back FROM rt JOIN n ON rt.query = n.query), fr AS (SELECT query, id AS first FROM bk WHERE back = greatest(4, n // 5)),
    va AS (SELECT bk.* FROM bk JOIN fr ON bk.query = fr.query WHERE id >= first), ea AS (SELECT bk.* FROM bk JOIN fr ON bk.query = fr.query WHERE id < first AND NOT EXISTS (SELECT 1 FROM va WHERE va.query = bk.query AND va.exposure = bk.exposure)),
    st AS MATERIALIZED (SELECT query, count(*) AS m, avg(y) AS prior, avg(f1) AS m1, avg(f2) AS m2, greatest(0.05, stddev_samp(f1)) AS s1, greatest(0.05, stddev_samp(f2)) AS s2 FROM ea GROUP BY query HAVING count(*) >= 10 AND count(DISTINCT y) = 2),
    z AS MATERIALIZED (SELECT ea.query, y, greatest(-5, least(5, (f1 - m1) / s1)) AS a, greatest(-5, least(5, (f2 - m2) / s2)) AS b FROM ea JOIN st ON ea.query = st.query),
    t0 AS (SELECT query, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, ln(least(0.99, greatest(0.01, prior)) / (1 - least(0.99, greatest(0.01, prior)))) AS w3 FROM st)"""
    for k in range(steps):
        out += f""", p{k} AS (SELECT z.*, w1, w2, w3, 1 / (1 + exp(-(w1 * a + w2 * b + w3))) AS p FROM z JOIN t{k} t ON z.query = t.query),
    g{k} AS (SELECT query, w1, w2, w3, avg((p - y) * a) + 0.1 * w1 AS g1, avg((p - y) * b) + 0.1 * w2 AS g2, avg(p - y) AS g3, avg(p * (1 - p) * a * a) + 0.1 AS h11, avg(p * (1 - p) * a * b) AS h12, avg(p * (1 - p) * a) AS h13,
      avg(p * (1 - p) * b * b) + 0.1 AS h22, avg(p * (1 - p) * b) AS h23, avg(p * (1 - p)) AS h33 FROM p{k} GROUP BY query, w1, w2, w3), d{k} AS (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM g{k}),
    t{k + 1} AS MATERIALIZED (SELECT query, w1 - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS w1,
      w2 - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS w2, w3 - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS w3 FROM d{k})"""
    return out + f""", sc AS (SELECT DISTINCT ev.query, ev.item, f1, f2, score FROM ev JOIN pop ON ev.item = pop.item), sp AS (SELECT query, greatest(0.05, stddev_pop(score)) AS spread FROM sc GROUP BY query),
    mo AS (SELECT st.*, w1, w2, w3, spread, least(0.35, m / 200) AS strength FROM st JOIN t{steps} t ON st.query = t.query JOIN sp ON st.query = sp.query),
    lg AS (SELECT va.query, exposure, va.score, y, spread, strength, prior, w1 * greatest(-5, least(5, (f1 - m1) / s1)) + w2 * greatest(-5, least(5, (f2 - m2) / s2)) + w3 AS logit FROM va JOIN mo ON va.query = mo.query),
    mv AS (SELECT *, score + strength * spread * tanh(logit / 2) AS moved FROM lg), ls AS (SELECT query, count(*) AS validation, avg(greatest(0, logit) + ln(1 + exp(-abs(logit))) - y * logit) AS loss, avg(-(y * ln(prior) + (1 - y) * ln(1 - prior))) AS base_loss FROM mv GROUP BY query),
    pr AS (SELECT a.query, count(*) AS pairs, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS base_order, avg(CASE WHEN a.moved > b.moved THEN 1.0 WHEN a.moved = b.moved THEN 0.5 ELSE 0 END) AS own_order
      FROM mv a JOIN mv b ON a.query = b.query AND a.exposure = b.exposure AND a.y = 1 AND b.y = 0 GROUP BY a.query),
    ok AS (SELECT mo.*, validation, loss, base_loss, pairs, base_order, own_order, loss < base_loss AND own_order >= base_order AS accepted FROM mo JOIN ls ON mo.query = ls.query JOIN pr ON mo.query = pr.query)"""


query(
    "r13_personal_models",
    _personal_sql() + " SELECT query, m AS train, validation, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS bias, round(loss, 6) AS loss, round(base_loss, 6) AS base_loss, pairs, round(base_order, 6) AS base_order, round(own_order, 6) AS own_order, accepted FROM ok",
)(lambda s, d: _personal_models(s, d))


def _personal_models(s, d):
    rated, scores = _rated(s, d)
    m = S.personal_models(rated, scores.groupBy("query").agg(F.greatest(F.lit(0.05), F.stddev_pop("score")).alias("spread")), ["f1", "f2"])
    rounded = [F.round(c, 6).alias(c) for c in ("loss", "base_loss", "base_order", "own_order")]
    return m.select("query", "train", "validation", *[F.round(F.col("theta")[k], 6).alias(n) for k, n in enumerate(("w1", "w2", "bias"))], "pairs", "accepted", *rounded)


query(
    "r13_personal_layer",
    _personal_sql() + """ SELECT sc.query, sc.item, round(score + CASE WHEN accepted THEN strength * spread * tanh((w1 * greatest(-5, least(5, (f1 - m1) / s1)) + w2 * greatest(-5, least(5, (f2 - m2) / s2)) + w3) / 2) ELSE 0 END, 6) AS score
    FROM sc LEFT JOIN ok ON sc.query = ok.query""",
)(lambda s, d: S.personal_layer(*_rated(s, d), ["f1", "f2"]).withColumn("score", F.round("score", 6)))
