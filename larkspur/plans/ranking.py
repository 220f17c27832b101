"""Lists, fusion, blends and pairwise measures over order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.numbering import numbered
from ..sources.staging import cut
from ..sources.tables import INTERACTIONS, catalog, interactions, table
from .base import query
from .graph import SPLIT, _candidates

X = "WITH " + INTERACTIONS

LISTS = """, ls AS (SELECT artist AS list, item, round(sum(weight), 6) - 60 AS score FROM x GROUP BY 1, 2)"""


def _lists(s, d):
    return interactions(s, d).groupBy(F.col("artist").alias("list"), "item").agg((F.round(F.sum("weight"), 6) - 60).alias("score"))


query(
    "w4_normalized_lists",
    X + LISTS + """, m AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, item) AS rank, max(greatest(score, 0)) OVER (PARTITION BY list) AS top FROM ls)
    SELECT list, item, CAST(rank AS INTEGER) AS rank, round(CASE WHEN top > 0 THEN greatest(score, 0) / top ELSE 0 END, 6) AS normalized, round(1 / (60 + rank), 9) AS reciprocal FROM m""",
)(lambda s, d: R.normalized_lists(_lists(s, d)).withColumn("normalized", F.round("normalized", 6)).withColumn("reciprocal", F.round("reciprocal", 9)))

RANKS = """, r0 AS (SELECT "user" % 50 AS query, ctx % 3 AS list, item, sum(weight) AS w FROM x GROUP BY ALL), rk AS (SELECT query, list, item, row_number() OVER (PARTITION BY query, list ORDER BY w DESC, item) AS rank FROM r0)"""


def _ranked(s, d):
    g = interactions(s, d).groupBy((F.col("user") % 50).alias("query"), (F.col("ctx") % 3).alias("list"), "item").agg(F.sum("weight").alias("w"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("w"), "item"))).select("query", "list", "item", "rank")


query("r1_rrf", X + RANKS + " SELECT query, item, round(sum(1 / (60 + rank)), 9) AS score, CAST(min(rank) AS INTEGER) AS best, count(DISTINCT list) AS support FROM rk GROUP BY 1, 2")(
    lambda s, d: R.rrf(_ranked(s, d)).withColumn("score", F.round("score", 9))
)

query(
    "w5_percentile_blend",
    X + SPLIT + """, p AS (SELECT query, item, 1 - (row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1) / (count(*) OVER (PARTITION BY query) - 1) AS a, 1 - (row_number() OVER (PARTITION BY query ORDER BY support DESC, item) - 1) / (count(*) OVER (PARTITION BY query) - 1) AS b FROM nk)
    SELECT query, item, round(0.7 * a + 0.3 * b, 9) AS score FROM p""",
)(lambda s, d: R.blended(_candidates(s, d)[1], "score", "support", 0.7).withColumn("score", F.round("score", 9)))

query(
    "w10_interleaved",
    X + RANKS + """, f AS (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY rank, list) AS k FROM rk), o AS (SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, list) AS INTEGER) AS place FROM f WHERE k = 1) SELECT * FROM o WHERE place <= 200""",
)(lambda s, d: R.interleaved(_ranked(s, d).withColumnRenamed("list", "head"), 200))

query(
    "a15_evidence_features",
    X + """, sd AS (SELECT DISTINCT "user" AS query, item AS seed FROM x WHERE "user" % 100 = 0), c AS (SELECT ctx, item FROM x GROUP BY ALL),
    ev AS (SELECT query, seed, b.item, count(*) AS n FROM sd JOIN c a ON a.item = seed JOIN c b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY ALL),
    rk AS (SELECT *, n / max(n) OVER (PARTITION BY query, seed) AS s, 1 / (60 + row_number() OVER (PARTITION BY query, seed ORDER BY n DESC, item)) AS r FROM ev),
    g AS (SELECT query, item, sum(r) AS rrf, count(DISTINCT seed) AS sup, max(s) AS top, avg(s) AS mean, coalesce(stddev_pop(s), 0) AS spread, list_sort(list(s), 'DESC') AS l FROM rk GROUP BY 1, 2), z AS (SELECT query, count(DISTINCT seed) AS n FROM rk GROUP BY 1)
    SELECT g.query, item, round(rrf, 6) AS rrf, round(sup / n, 6) AS support, round(top, 6) AS top, round(coalesce(l[2], 0), 6) AS second, round(mean, 6) AS mean, round(spread, 6) AS spread FROM g JOIN z ON g.query = z.query""",
)(lambda s, d: _features(s, d))


def _features(s, d):
    x = interactions(s, d)
    sd = x.where(F.col("user") % 100 == 0).select(F.col("user").alias("query"), F.col("item").alias("seed")).distinct()
    c = x.select("ctx", "item").distinct()
    ev = sd.join(c.withColumnRenamed("item", "seed"), "seed").join(c, "ctx").where("seed <> item").groupBy("query", "seed", "item").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query", "seed")
    rows = ev.withColumn("normalized", F.col("n") / F.max("n").over(w)).withColumn("reciprocal", 1 / (60 + F.row_number().over(w.orderBy(F.desc("n"), "item"))))
    f = R.evidence_features(rows, catalog(s, d).select("item", "artist"))
    return f.select("query", "item", *[F.round(k, 6).alias(k) for k in ("rrf", "support", "top", "second", "mean", "spread")])


query(
    "m8_list_diversity",
    X + SPLIT + ", it AS (SELECT p_partkey AS item, p_brand AS artist FROM part), o AS (SELECT nk.query, nk.item, artist, row_number() OVER (PARTITION BY nk.query ORDER BY score DESC, nk.item) AS rank FROM nk JOIN it ON nk.item = it.item) SELECT query, count(DISTINCT artist) AS artists, count(*) AS length FROM o WHERE rank <= 20 GROUP BY 1",
)(lambda s, d: R.top_k(_candidates(s, d)[1].join(catalog(s, d), "item"), 20).groupBy("query").agg(F.count_distinct("artist").alias("artists"), F.count("*").alias("length")))

query(
    "m9_pair_accuracy",
    X + """, p AS (SELECT a.ctx, a.weight AS pos, b.weight AS neg FROM x a JOIN x b ON a.ctx = b.ctx AND a.pos < b.pos) SELECT ctx, round(avg(ln(1 + exp(-(pos - neg)))), 6) AS loss, round(avg(CASE WHEN pos > neg THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY ctx""",
)(lambda s, d: _pair_loss(s, d))


def _pair_loss(s, d):
    x = interactions(s, d).select("ctx", "pos", "weight")
    p = x.select("ctx", F.col("pos").alias("i"), F.col("weight").alias("pos")).join(x.select("ctx", F.col("pos").alias("j"), F.col("weight").alias("neg")), "ctx").where("i < j")
    return p.groupBy("ctx").agg(F.round(F.avg(F.log1p(F.exp(F.col("neg") - F.col("pos")))), 6).alias("loss"), F.round(F.avg(F.when(F.col("pos") > F.col("neg"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def _greedy(s, d, size, per_artist, **rules):
    """Families go by number, so that what is dealt by query is narrow."""
    parts = catalog(s, d).select("item", "artist", F.concat_ws("|", "artist", "title").alias("name"))
    families = cut(numbered(parts.select("name", "artist").distinct(), ["name", "artist"], "family"), "families")
    found = _candidates(s, d, items=parts.join(families, ["name", "artist"]), carry=("family",))[1]
    found = found.withColumn("familiar", F.col("item") % 3 == 0).withColumn("popular", F.col("support") > 20)
    return R.no_adjacent_artist(found, size, per_artist, artists=families.select("family", "artist"), **rules).select("query", "item", "place")


def _greedy_sql(size: int, per_artist: int, familiar: str = "true", popular: str = "true", per_familiar: int | None = None, source: str = "", directions: bool = False) -> str:
    """The greedy walk as a recursion: a step a place, all queries at once."""
    cap = f"CASE WHEN familiar THEN {per_familiar} ELSE {per_artist} END" if per_familiar else str(per_artist)
    covered = "len(list_filter(directions, lambda d: d = cn.direction)), " if directions else ""
    source = source or """cn AS (SELECT nk.query, nk.item, p_brand AS artist, p_brand || '|' || p_name AS family, nk.item % 3 = 0 AS familiar, support > 20 AS popular, score, '' AS direction FROM nk JOIN part ON nk.item = p_partkey)"""
    return f""", {source},
    gr AS (SELECT DISTINCT query, CAST(0 AS INTEGER) AS place, CAST(NULL AS BIGINT) AS item, '' AS direction, CAST([] AS VARCHAR[]) AS families, CAST([] AS VARCHAR[]) AS artists, CAST([] AS VARCHAR[]) AS directions, 0 AS familiars, 0 AS populars FROM cn
      UNION ALL SELECT query, place, item, direction, families, artists, directions, familiars, populars FROM (
        SELECT gr.query, gr.place + 1 AS place, cn.item, cn.direction, list_append(families, family) AS families, list_append(artists, artist) AS artists, list_append(directions, cn.direction) AS directions,
          familiars + CAST(familiar AS INTEGER) AS familiars, populars + CAST(popular AS INTEGER) AS populars,
          row_number() OVER (PARTITION BY gr.query ORDER BY {covered}score DESC, cn.item, cn.direction) AS k_
        FROM gr JOIN cn ON gr.query = cn.query WHERE gr.place < {size} AND NOT list_contains(families, family) AND coalesce(artists[-1], '') <> artist AND len(list_filter(artists, lambda a: a = artist)) < {cap}
          AND (NOT familiar OR {familiar}) AND (NOT popular OR {popular})) WHERE k_ = 1)
    SELECT query, item, {"direction, " if directions else ""}place FROM gr WHERE place > 0"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


query("l2_no_adjacent_artist", _recursive(X + SPLIT + _greedy_sql(50, 2)))(lambda s, d: _greedy(s, d, 50, 2))

query("l4_prefix_quotas", _recursive(X + SPLIT + _greedy_sql(40, 2, "familiars + 1 <= (gr.place + 1) * 3 // 10", "populars + 1 <= (gr.place + 1) // 5")))(
    lambda s, d: _greedy(s, d, 40, 2, familiar=0.3, popular=0.2)
)

query("l5_less_familiar", _recursive(X + SPLIT + _greedy_sql(40, 2, per_familiar=1)))(lambda s, d: _greedy(s, d, 40, 2, per_familiar=1))


query("a22_coverage", X + SPLIT + ", r AS (SELECT item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS k FROM nk) SELECT count(DISTINCT item) AS items, round(count(DISTINCT item) / (SELECT count(*) FROM part), 6) AS share FROM r WHERE k <= 40")(
    lambda s, d: R.top_k(_candidates(s, d)[1], 40).agg(F.count_distinct("item").alias("items")).crossJoin(table(s, d, "part").agg(F.count("*").alias("n"))).select("items", F.round(F.col("items") / F.col("n"), 6).alias("share"))
)
