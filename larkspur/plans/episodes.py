"""Episodes, hard negatives and evaluation sets over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as N
from ..operators.numbering import drawn, drawn_sql
from ..sources.staging import cut
from ..sources.tables import INTERACTIONS, catalog, interactions
from .base import query
from .graph import SPLIT, _candidates, _queries
from .splits import BANDS

X = "WITH " + INTERACTIONS

OWN = """, pt AS (SELECT p_partkey AS item, p_brand AS artist, p_brand || '|' || p_name AS family FROM part), ow AS (SELECT DISTINCT "user", x.item, family, pt.artist FROM x JOIN pt ON x.item = pt.item WHERE "user" % 20 = 0),
fm AS (SELECT *, count(*) OVER (PARTITION BY "user") AS n FROM (SELECT DISTINCT "user", family FROM ow)), f3 AS (SELECT * FROM fm WHERE n >= 3)"""


def _families(s, d):
    return catalog(s, d).select("item", F.concat_ws("|", "artist", "title").alias("family"))


def _episodes(s, d, discovery):
    return N.family_episodes(interactions(s, d).where("user % 20 = 0"), _families(s, d), catalog(s, d).select("item", "artist"), discovery)


query(
    "k8_family_episodes",
    X + OWN + """, hl AS (SELECT "user", family FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sha256("user" || ':' || family), family) AS k FROM f3) WHERE k <= greatest(1, n // 5))
    SELECT ow."user", item, hl.family IS NOT NULL AS target FROM ow LEFT JOIN hl ON ow."user" = hl."user" AND ow.family = hl.family WHERE ow."user" IN (SELECT "user" FROM f3)""",
)(lambda s, d: _episodes(s, d, False))

query(
    "k8_discovery_episodes",
    X + OWN + """, pr AS (SELECT "user", artist, count(DISTINCT family) AS held FROM ow GROUP BY ALL), ok AS (SELECT DISTINCT pr."user", artist FROM pr JOIN f3 ON pr."user" = f3."user" WHERE n - held >= 2),
    pk AS (SELECT "user", artist FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sha256("user" || ':' || artist), artist) AS k FROM ok) WHERE k = 1), hl AS (SELECT DISTINCT ow."user", family FROM ow JOIN pk ON ow."user" = pk."user" AND ow.artist = pk.artist)
    SELECT ow."user", item, hl.family IS NOT NULL AS target FROM ow JOIN pk ON ow."user" = pk."user" LEFT JOIN hl ON ow."user" = hl."user" AND ow.family = hl.family""",
)(lambda s, d: _episodes(s, d, True))

query(
    "k11_pool_pairs",
    X + SPLIT + """, pt AS (SELECT p_partkey AS item, p_brand || '|' || p_name AS family FROM part), tf AS (SELECT DISTINCT query, family FROM q JOIN pt ON q.item = pt.item WHERE NOT seed), kf AS (SELECT DISTINCT query, family FROM q JOIN pt ON q.item = pt.item),
    pf AS (SELECT nk.query, nk.item, score, family FROM nk JOIN pt ON nk.item = pt.item), on1 AS (SELECT pf.query, min(item) AS positive FROM pf JOIN tf ON pf.query = tf.query AND pf.family = tf.family GROUP BY pf.query, pf.family),
    po AS (SELECT query, positive FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sha256(query || ':' || positive), positive) AS k FROM on1) WHERE k <= 12),
    al AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1 AS number, count(*) OVER (PARTITION BY query) AS n FROM pf WHERE NOT EXISTS (SELECT 1 FROM kf WHERE kf.query = pf.query AND kf.family = pf.family)), sz AS (SELECT query, max(n) AS n FROM al GROUP BY 1),
    dr AS (SELECT po.query, positive, j < 3 AS hard, CAST('0x' || substr(sha256(po.query || ':' || positive || ':' || j), 1, 12) AS UBIGINT) % CASE WHEN j < 3 THEN least(500, n) ELSE n END AS number FROM po JOIN sz ON po.query = sz.query, range(0, 4) r(j))
    SELECT dr.query, positive, item AS negative, hard FROM dr JOIN al ON dr.query = al.query AND dr.number = al.number""",
)(lambda s, d: (lambda q, found: N.pool_pairs(found, q.where("NOT seed").select("query", "item"), q.select("query", "item"), _families(s, d)))(*_candidates(s, d)))

query(
    "k14_hard_negatives",
    X + SPLIT + BANDS.replace(", u AS", ", uu AS").replace("FROM u)", "FROM uu)") + """, ak AS (SELECT kn.item AS positive, query, pool FROM kn JOIN b ON kn.item = b.item WHERE query % 100 = 0), """ + drawn_sql("ak", "bi", "kn", ["positive"], 32, 64, "dn")
    + """, hd AS (SELECT dn.query, positive, dn.item, CAST(row_number() OVER (PARTITION BY dn.query, positive ORDER BY coalesce(score, 0) DESC, dn.item) AS INTEGER) AS place FROM dn LEFT JOIN nk ON nk.query = dn.query AND nk.item = dn.item) SELECT * FROM hd WHERE place <= 4""",
)(lambda s, d: _hard(s, d))


def _hard(s, d):
    x = interactions(s, d)
    items = cut(N.band_items(x), "bands")
    known = x.where("user % 100 = 0").select(F.col("user").alias("query"), "item").distinct()
    positives = known.join(items, "item").select(F.col("item").alias("positive"), "query", "pool")
    return N.hard_negatives(drawn(positives, items, known, ["positive"], 32, 64), _candidates(s, d)[1].select("query", "item", "score"))


query(
    "k15_bucketed_evaluation",
    X + """, i AS (SELECT DISTINCT "user", item FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sha256("user" || ':' || item), item) AS k, count(*) OVER (PARTITION BY "user") AS n FROM i)
    SELECT "user", CAST(size AS INTEGER) AS size, item, k <= size AS seed FROM o, (VALUES (5), (20), (60)) z(size) WHERE n > size""",
)(lambda s, d: N.bucketed_evaluation(interactions(s, d)))
