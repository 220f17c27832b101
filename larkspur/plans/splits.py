"""Hash splits, nested partitions, samples and negatives over users and items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import sampling as N
from ..operators.numbering import drawn_sql
from ..sources.tables import INTERACTIONS, LISTENS, interactions, listens
from .base import query

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS


def _users(s, d):
    return interactions(s, d).select("user").distinct()


_U = X + """, u AS (SELECT DISTINCT "user" FROM x)"""
_MOD = "(" * 7 + "CAST('0x' || substr(h, 1, 8) AS UBIGINT) % 100" + "".join(f" * 96 + CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)) % 100" for i in range(1, 8))

query(
    "k1_split_80_10_10",
    _U + f""", h AS (SELECT "user", sha256('salt_' || "user") AS h FROM u), m AS (SELECT "user", {_MOD} AS b FROM h)
    SELECT "user", CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM m""",
)(lambda s, d: _users(s, d).select("user", H.split_80_10_10(F.concat(F.lit("salt_"), F.col("user").cast("string"))).alias("split")))

query(
    "k2_split_75_10_10_5",
    _U + """, m AS (SELECT "user", CAST('0x' || substr(sha256(sha256(CAST("user" AS VARCHAR))), 1, 8) AS UBIGINT) % 100 AS b FROM u)
    SELECT "user", CASE WHEN b < 75 THEN 'train' WHEN b < 85 THEN 'validation' WHEN b < 95 THEN 'test' ELSE 'audit' END AS split FROM m""",
)(lambda s, d: _users(s, d).select("user", H.split_75_10_10_5(F.col("user").cast("string")).alias("split")))

query(
    "k3_nested_partition",
    _U + """, m AS (SELECT "user", CAST('0x' || substr(sha256('rep_' || "user"), 1, 8) AS UBIGINT) % 100 AS a, CAST('0x' || substr(sha256('audit_' || "user"), 1, 8) AS UBIGINT) % 5 AS b FROM u)
    SELECT "user", CASE WHEN a < 70 THEN 'representation' WHEN b = 0 THEN 'reserve' ELSE 'ranker' END AS part FROM m""",
)(
    lambda s, d: _users(s, d).select(
        "user",
        F.when(H.hex_prefix(F.concat(F.lit("rep_"), F.col("user").cast("string"))) % 100 < 70, "representation")
        .when(H.hex_prefix(F.concat(F.lit("audit_"), F.col("user").cast("string"))) % 5 == 0, "reserve")
        .otherwise("ranker")
        .alias("part"),
    )
)

query(
    "k4_ordered_ratio_split",
    _U + """, o AS (SELECT "user", row_number() OVER (ORDER BY sha256('seed:' || "user"), "user") AS k, count(*) OVER () AS n FROM u)
    SELECT "user", CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM o""",
)(lambda s, d: N.ordered_split(_users(s, d), "user", (0.7, 0.15)))

query(
    "k5_artist_disjoint_split",
    X + """, a AS (SELECT artist, count(*) AS n FROM x GROUP BY artist), c AS (SELECT *, sum(n) OVER (ORDER BY sha256(artist), artist ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM a)
    SELECT artist, n, before >= 0.8 * total AS held FROM c""",
)(lambda s, d: N.group_disjoint_split(interactions(s, d), "artist", 0.8))

query(
    "k6_masked_episodes",
    X + """, i AS (SELECT DISTINCT "user", item FROM x WHERE "user" % 100 = 0), m AS (SELECT "user", item, g.i AS mask FROM i, range(0, 32) g(i)),
    o AS (SELECT "user", mask, item, row_number() OVER (PARTITION BY "user", mask ORDER BY sha256(mask || ':' || "user" || ':' || item), item) AS k, count(*) OVER (PARTITION BY "user", mask) AS n FROM m)
    SELECT "user", mask, item, k = least(30, n - 1) + 1 AS positive FROM o WHERE n >= 6 AND k <= least(30, n - 1) + 1""",
)(lambda s, d: N.masked_episodes(interactions(s, d).where(F.col("user") % 100 == 0), masks=32))

BANDS = """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item), pc AS (SELECT item, percent_rank() OVER (ORDER BY users) AS pr FROM u), b AS (SELECT item, CAST(least(9, floor(pr * 10)) AS INTEGER) AS pool FROM pc),
bi AS (SELECT pool, item, row_number() OVER (PARTITION BY pool ORDER BY item) - 1 AS number FROM b), kn AS (SELECT DISTINCT "user" AS query, item FROM x)"""

query(
    "k9_band_negatives",
    X + BANDS + """, ak AS (SELECT kn.item AS positive, query, pool FROM kn JOIN b ON kn.item = b.item WHERE query % 100 = 0), """ + drawn_sql("ak", "bi", "kn", ["positive"], 1, 16, "dn") + " SELECT query, positive, item AS negative FROM dn",
)(lambda s, d: N.band_negatives(interactions(s, d)))

query(
    "k10_random_negatives",
    X + """, kn AS (SELECT DISTINCT "user" AS query, item FROM x), ai AS (SELECT 0 AS pool, item, row_number() OVER (ORDER BY item) - 1 AS number FROM (SELECT DISTINCT item FROM x)), ak AS (SELECT DISTINCT ctx AS key, "user" AS query, 0 AS pool FROM x WHERE "user" % 100 = 0), """
    + drawn_sql("ak", "ai", "kn", ["key"], 99, 160, "dn") + " SELECT key AS ctx, item FROM dn",
)(lambda s, d: (lambda x: N.random_negatives(x.where("user % 100 = 0").select(F.col("ctx").alias("key"), F.col("user").alias("query")).distinct(), x).select(F.col("key").alias("ctx"), "item"))(interactions(s, d)))

query(
    "u2_held_out",
    X + """, i AS (SELECT DISTINCT "user", item FROM x) SELECT "user", item FROM i EXCEPT SELECT "user", item FROM i WHERE CAST('0x' || substr(sha256(CAST(item AS VARCHAR)), 1, 8) AS UBIGINT) % 2 = 0""",
)(lambda s, d: (lambda i: i.exceptAll(i.where(H.hex_prefix(F.col("item")) % 2 == 0)))(interactions(s, d).select("user", "item").distinct()))

query(
    "u3_distinct_contexts",
    X + """, c AS (SELECT "user", ctx, list_sort(list(DISTINCT item)) AS items FROM x GROUP BY 1, 2) SELECT "user", count(DISTINCT items) AS contexts FROM c GROUP BY 1""",
)(lambda s, d: N.distinct_contexts(interactions(s, d)))

query("s4_user_fraction", E + """SELECT event_id, "user" FROM e WHERE CAST('0x' || substr(sha256(CAST("user" AS VARCHAR)), 1, 13) AS UBIGINT) / 4503599627370496.0 < 0.25""")(
    lambda s, d: listens(s, d).where(H.unit_fraction(F.col("user")) < 0.25).select("event_id", "user")
)

query("s16_bounded_pull", E + """, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE ts >= 1704500000 AND ts < 1706000000) SELECT "user", event_id, ts FROM r WHERE k <= 30""")(
    lambda s, d: listens(s, d).where((F.col("ts") >= 1704500000) & (F.col("ts") < 1706000000)).withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 30").select("user", "event_id", "ts")
)

query("f11_pseudonyms", _U + """SELECT "user", sha256(CAST("user" AS VARCHAR)) AS pseudonym, 'track-' || substr(sha256(CAST("user" AS VARCHAR)), 1, 16) AS synthetic, (("user" + 1) * 2654435761) & 4294967295 AS order_hash FROM u""".replace("SELECT \"user\", sha", " SELECT \"user\", sha", 1))(
    lambda s, d: _users(s, d).select("user", H.sha(F.col("user")).alias("pseudonym"), H.synthetic_id("track-", F.col("user")).alias("synthetic"), H.order_hash(F.col("user")).alias("order_hash"))
)

query(
    "p1_identity",
    X + """SELECT DISTINCT item, CASE WHEN item % 3 = 0 THEN 'mbid:' || lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) ELSE 'fallback:' || sha256(artist || chr(31) || title) END AS identity
    FROM (SELECT *, upper(md5(CAST(item AS VARCHAR))) AS h FROM x) WHERE item % 5 <> 1""".replace("SELECT DISTINCT", " SELECT DISTINCT", 1),
)(lambda s, d: _identities(s, d))


def _identities(s, d):
    from ..operators.clean import identify

    h = F.upper(F.md5(F.col("item").cast("string").cast("binary")))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    given = F.when(F.col("item") % 5 == 1, "not-a-uuid").when(F.col("item") % 3 == 0, uuid)
    return identify(interactions(s, d).withColumn("mbid", given)).where("NOT rejected").select("item", "identity").distinct()
