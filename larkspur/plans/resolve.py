"""Merging, resolving and excluding candidates; coverage, protection and fallbacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import matching as M
from ..operators.popularity import rank_feature
from ..operators.sessions import eligible
from ..sources.staging import cut
from ..sources.tables import INTERACTIONS, LISTENS, catalog, interactions, listens, vectors
from .base import query
from .graph import ELIGIBLE, SPLIT, _candidates
from .text import TITLES, _titles

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS

query(
    "j2_merged_lists",
    X + """, sd AS (SELECT DISTINCT "user" AS query, item FROM x WHERE "user" % 100 = 0), c AS (SELECT DISTINCT ctx, item FROM x), pt AS (SELECT p_partkey AS item, p_brand || '|' || p_name AS identity FROM part),
    l0 AS (SELECT query, sd.item AS seed, b.item, count(*) AS n FROM sd JOIN c a ON a.item = sd.item JOIN c b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY query, seed ORDER BY n DESC, item) AS rank FROM l0),
    nm AS (SELECT DISTINCT query, identity FROM sd JOIN pt ON sd.item = pt.item)
    SELECT l.query, l.item, count(DISTINCT seed) AS support, CAST(min(rank) AS INTEGER) AS best FROM l JOIN pt ON l.item = pt.item WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query = l.query AND sd.item = l.item) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.query = l.query AND nm.identity = pt.identity) GROUP BY 1, 2""",
)(lambda s, d: _merged(s, d))


def _merged(s, d):
    x = interactions(s, d)
    seeds = x.where("user % 100 = 0").select(F.col("user").alias("query"), "item").distinct()
    c = x.select("ctx", "item").distinct()
    near = seeds.withColumnRenamed("item", "seed").join(c.withColumnRenamed("item", "seed"), "seed").join(c, "ctx").where("seed <> item").groupBy("query", "seed", "item").agg(F.count("*").alias("score"))
    lists = near.withColumn("rank", F.row_number().over(Window.partitionBy("query", "seed").orderBy(F.desc("score"), "item")))
    return M.merged_lists(lists, seeds, catalog(s, d).select("item", F.concat_ws("|", "artist", "title").alias("identity"))).drop("evidence")


KEYS = f"""{TITLES}, ky AS (SELECT item, m, lower(artist) || '|' || lower(title) AS exact, lower(artist) || '|' || lower(CASE WHEN m IN (2, 4, 5) THEN p_name ELSE title END) AS master, lower(artist) || '|' || lower(CASE WHEN m IN (1, 2, 3, 4, 5) THEN p_name ELSE title END) AS family FROM t)"""


def _keys(s, d):
    t, a = _titles(s, d), T.match_key(F.col("artist"))
    return t.select("item", F.concat(a, F.lit("|"), T.match_key(F.col("title"))).alias("exact"), F.concat(a, F.lit("|"), T.remaster_key(F.col("title"))).alias("master"), F.concat(a, F.lit("|"), T.family_title(F.col("title"))).alias("family"))


query(
    "j6_known_families",
    f"""WITH {KEYS}, nm AS (SELECT item % 10 AS query, exact, master, family FROM ky WHERE item % 7 = 0), h AS (SELECT DISTINCT query, nm.exact, 0 AS level, ky.item FROM nm JOIN ky ON nm.exact = ky.exact UNION ALL SELECT DISTINCT query, nm.exact, 1, ky.item FROM nm JOIN ky ON nm.master = ky.master),
    f AS (SELECT *, min(level) OVER (PARTITION BY query, exact) AS b FROM h), fi AS (SELECT * FROM f WHERE level = b), sg AS (SELECT DISTINCT query, min(item) AS item FROM (SELECT query, exact, item FROM fi) GROUP BY query, exact HAVING count(DISTINCT item) = 1),
    kn AS (SELECT query, item FROM fi UNION SELECT query, ky.item FROM nm JOIN ky ON nm.family = ky.family)
    SELECT query, item, EXISTS (SELECT 1 FROM sg WHERE sg.query = kn.query AND sg.item = kn.item) AS seed FROM kn""",
)(lambda s, d: _known(s, d))


def _known(s, d):
    c = _keys(s, d)
    names = c.where("item % 7 = 0").select((F.col("item") % 10).alias("query"), "exact", "master", "family")
    seeds, known = M.known_with_families(names, c)
    return known.join(seeds.withColumn("seed", F.lit(True)), ["query", "item"], "left").select("query", "item", F.coalesce("seed", F.lit(False)).alias("seed"))


query(
    "j7_excluded",
    X + SPLIT + """, pt AS (SELECT p_partkey AS item, p_brand || '|' || p_name AS identity FROM part), sd AS (SELECT DISTINCT query, item FROM q WHERE seed)
    SELECT nk.query, nk.item FROM nk JOIN pt ON nk.item = pt.item WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query = nk.query AND (sd.item = nk.item OR sd.item = nk.item + 1 AND nk.item % 2 = 0 OR sd.item = nk.item - 1 AND nk.item % 2 = 1)) AND NOT EXISTS (SELECT 1 FROM sd JOIN pt p ON sd.item = p.item WHERE sd.query = nk.query AND p.identity = pt.identity)""",
)(lambda s, d: _excluded(s, d))


def _excluded(s, d):
    """An even item's alternate id is the next one."""
    q, found = _candidates(s, d)
    alternates = catalog(s, d).where("item % 2 = 0").select("item", (F.col("item") + 1).alias("alternate"))
    return M.excluded(found.select("query", "item"), q.where("seed"), alternates, catalog(s, d).select("item", F.concat_ws("|", "artist", "title").alias("identity"))).select("query", "item")


query("j12_protected", X + f""", {KEYS} SELECT DISTINCT "user", b.item FROM x JOIN ky a ON a.item = x.item JOIN ky b ON a.family = b.family WHERE "user" % 20 = 0 AND b.item % 3 <> 0""")(lambda s, d: _protection(s, d))


def _protection(s, d):
    """The catalog is two thirds of the items; plays of the others protect their families too."""
    keys = cut(_keys(s, d).select("item", "family"), "keys")  # read twice, and else made again by each filter
    return M.protected_families(interactions(s, d).where("user % 20 = 0").select("user", F.col("item").alias("raw")), keys.withColumnRenamed("item", "raw"), keys.where("item % 3 <> 0"))


query(
    "j15_diagnosis",
    X + f""", {KEYS}, ln AS (SELECT item AS line, CASE WHEN item % 11 = 0 THEN 'nobody|' || item ELSE master END AS key FROM ky WHERE item % 2 = 0), h AS (SELECT master AS key, count(DISTINCT item) AS n, min(item) AS item FROM ky WHERE item % 3 = 0 GROUP BY 1),
    us AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), sn AS (SELECT master AS key, max(coalesce(users, 0)) AS support FROM ky LEFT JOIN us ON ky.item = us.item GROUP BY 1)
    SELECT line, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN support IS NOT NULL THEN 'in_raw_not_catalog' ELSE 'absent' END AS status, CASE WHEN n = 1 THEN h.item ELSE -1 END AS item, CASE WHEN n IS NULL AND support IS NOT NULL THEN support ELSE -1 END AS support FROM ln LEFT JOIN h ON ln.key = h.key LEFT JOIN sn ON ln.key = sn.key""",
)(lambda s, d: _diagnosis(s, d))


def _diagnosis(s, d):
    c = _keys(s, d).select("item", F.col("master").alias("key"))
    lines = c.where("item % 2 = 0").select(F.col("item").alias("line"), F.when(F.col("item") % 11 == 0, F.concat(F.lit("nobody|"), F.col("item").cast("string"))).otherwise(F.col("key")).alias("key"))
    users = interactions(s, d).groupBy(F.col("item").alias("raw")).agg(F.count_distinct("user").alias("users"))
    out = M.diagnosed(lines, c.where("item % 3 = 0"), c.withColumnRenamed("item", "raw"), users)
    return out.select("line", "status", F.coalesce("item", F.lit(-1)).alias("item"), F.coalesce("support", F.lit(-1)).alias("support"))


query("j15_missing_artists", f"""WITH {TITLES} SELECT artist, count(*) AS lines FROM t WHERE item % 2 = 0 AND item % 3 <> 0 GROUP BY artist""")(
    lambda s, d: _titles(s, d).where("item % 2 = 0").join(catalog(s, d).where("item % 3 = 0").select("item"), "item", "left_anti").groupBy("artist").agg(F.count("*").alias("lines"))
)

query("j16_handles", E + """, u AS (SELECT DISTINCT "user" FROM e) SELECT "user", sha256(CAST("user" AS VARCHAR)) AS pseudonym FROM u WHERE "user" % 10 = 3""".replace(" SELECT", " SELECT", 1))(
    lambda s, d: (lambda u: M.handles(u, u.where("user % 10 = 3").select(H.sha(F.col("user")).alias("pseudonym"))))(listens(s, d).select("user").distinct())
)

query(
    "j17_external_match",
    """WITH f AS (SELECT p_partkey AS item, p_partkey * 10 + k AS provider, p_brand AS artist, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS title, 'code' || CASE WHEN p_partkey % 7 = 0 THEN k ELSE 0 END AS code FROM part, range(0, 3) r(k) WHERE k <= p_partkey % 3)
    SELECT f.item, min(provider) AS provider FROM f JOIN part ON item = p_partkey AND artist = p_brand AND title = p_name GROUP BY f.item HAVING count(DISTINCT code) = 1""",
)(lambda s, d: _external(s, d))


def _external(s, d):
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("item") % 3)).alias("k")
    f = catalog(s, d).select("*", k)
    f = f.select("item", (F.col("item") * 10 + F.col("k")).alias("provider"), "artist", F.when(F.col("item") % 5 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.concat(F.lit("code"), F.when(F.col("item") % 7 == 0, F.col("k")).otherwise(F.lit(0)).cast("string")).alias("code"))
    return M.external_match(catalog(s, d), f)


query(
    "j18_splits_kept",
    X + """, sp AS (SELECT "user", CAST('0x' || substr(sha256(sha256(CAST("user" AS VARCHAR))), 1, 8) AS UBIGINT) % 100 AS b, min(ts) AS ts FROM x GROUP BY "user"), o AS (SELECT * FROM sp WHERE ts < DATE '1995-06-01')
    SELECT count(*) FILTER ("user" % 50 = 7 AND "user" % 40 <> 3 AND old) AS changed, count(*) FILTER ("user" % 40 = 3 AND old) AS vanished, count(*) FILTER ("user" % 40 <> 3 AND NOT old) AS added,
      count(*) FILTER (("user" % 50 = 7 OR "user" % 40 = 3) AND old) = 0 AS kept FROM (SELECT *, "user" IN (SELECT "user" FROM o) AS old FROM sp)""",
)(lambda s, d: _splits(s, d))


def _splits(s, d):
    """An earlier publication that had some users elsewhere, and a later one that lacks some."""
    u = interactions(s, d).groupBy("user").agg(F.min("ts").alias("ts")).withColumn("split", H.split_75_10_10_5(F.col("user").cast("string")))
    old = u.where("ts < DATE '1995-06-01'").select("user", F.when(F.col("user") % 50 == 7, "elsewhere").otherwise(F.col("split")).alias("split"))
    return M.splits_kept(old, u.where("user % 40 <> 3").select("user", "split"))


query(
    "j19_seed_vectors",
    X + ELIGIBLE + """, sd AS (SELECT DISTINCT item FROM x), v AS (SELECT vec_id AS item, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 2 = 0), nb AS (SELECT DISTINCT a.item, b.item AS other FROM el a JOIN el b ON a.ctx = b.ctx AND a.item <> b.item),
    m AS (SELECT sd.item, generate_subscripts(v.v, 1) AS d, unnest(v.v) AS x FROM sd JOIN nb ON sd.item = nb.item JOIN v ON v.item = nb.other), a AS (SELECT item, d, avg(x) AS x FROM m GROUP BY 1, 2), n AS (SELECT item, round(max(x) / sqrt(sum(x * x)), 5) AS top FROM a GROUP BY item)
    SELECT sd.item, CASE WHEN v.item IS NOT NULL THEN 'direct' WHEN n.item IS NOT NULL THEN 'neighbours' ELSE 'unresolved' END AS source, coalesce(round(list_max(v.v), 5), top, -9) AS top FROM sd LEFT JOIN v ON sd.item = v.item LEFT JOIN n ON sd.item = n.item""",
)(lambda s, d: _fallback(s, d))


def _fallback(s, d):
    """Every item is a seed. Contexts are paired with those of their items that have a vector."""
    x = interactions(s, d)
    i = eligible(x).select("ctx", "item").distinct()
    v = vectors(s, d).where("id % 2 = 0").select(F.col("id").alias("item"), "vec")
    others = i.join(v.select("item"), "item", "left_semi").withColumnRenamed("item", "other")
    near = i.join(others, "ctx").where("item <> other").select("item", "other").distinct()
    out = M.seed_vectors(x.select("item").distinct(), v, near)
    return out.select("item", "source", F.coalesce(F.round(F.array_max("vec"), 5), F.lit(-9.0)).alias("top"))


query("f18_rank_feature", X + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item) SELECT item, users, round(-ln(1 + (rank() OVER (ORDER BY users DESC) - 1)), 9) AS feature FROM u""")(
    lambda s, d: rank_feature(interactions(s, d).groupBy("item").agg(F.count_distinct("user").alias("users")), "users").select("item", "users", F.round("feature", 9).alias("feature"))
)

query(
    "f16_activations",
    """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), l AS (SELECT *, v[1] * 10 AS x, list_max(v) AS m FROM v)
    SELECT id, round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), 6) AS gelu, round(1 / (1 + exp(-greatest(-30, least(30, x * 20)))), 6) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus,
    round(m + ln(list_sum(list_transform(v, lambda y: exp(y - m)))), 6) AS log_sum_exp, round(exp(v[1] - m) / list_sum(list_transform(v, lambda y: exp(y - m))), 8) AS first_share FROM l""",
)(lambda s, d: _activations(s, d))


def _activations(s, d):
    from ..functions import vector as Q

    v = F.col("vec").cast("array<double>")
    x = v[0] * 10
    return vectors(s, d).select("id", F.round(Q.gelu(x), 6).alias("gelu"), F.round(Q.sigmoid(x * 20), 6).alias("sigmoid"), F.round(Q.softplus(x), 6).alias("softplus"), F.round(Q.log_sum_exp(v), 6).alias("log_sum_exp"), F.round(Q.softmax(v)[0], 8).alias("first_share"))
