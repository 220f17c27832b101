"""Popularity, canonical rows and audits over the order lines and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import popularity as P
from ..operators import sessions as S
from ..sources.tables import INTERACTIONS, LISTENS, interactions, listens, table
from .base import query

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS

query("a5_context_frequency", X + 'SELECT item, count(DISTINCT ctx) AS contexts FROM x GROUP BY item')(lambda s, d: P.context_frequency(interactions(s, d)))

query(
    "a6_user_percentile",
    X + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item),
    p AS (SELECT item, users, percent_rank() OVER (ORDER BY users) AS pr FROM u)
    SELECT item, users, round(pr, 6) AS percentile, CAST(least(9, floor(pr * 10)) AS INTEGER) AS band FROM p""",
)(lambda s, d: P.user_percentile(interactions(s, d)).withColumn("percentile", F.round("percentile", 6)))

query(
    "a7_rank_popularity",
    X + """, n AS (SELECT item, count(DISTINCT ctx) AS c, count(*) AS p FROM x GROUP BY item)
    SELECT item, round(greatest(0.01, 1 - (row_number() OVER (ORDER BY c DESC, p DESC, item) - 1) / count(*) OVER ()), 4) AS popularity FROM n""",
)(lambda s, d: P.rank_popularity(interactions(s, d)))

query(
    "a8_midrank_popularity",
    X + """, u AS (SELECT item, count(DISTINCT "user") AS users FROM x GROUP BY item),
    r AS (SELECT item, rank() OVER (ORDER BY users) - 1 AS less, count(*) OVER (PARTITION BY users) AS eq, count(*) OVER () AS n FROM u WHERE users > 1)
    SELECT u.item, u.users, coalesce(floor((0.15 + 0.84 * (less + eq / 2) / n) * 1000 + 0.5) / 1000, 0) AS popularity FROM u LEFT JOIN r ON u.item = r.item""",
)(lambda s, d: P.midrank_popularity(interactions(s, d)))

query("a1_canonical", X + """SELECT item, min({'a': artist, 't': title}).a AS artist, min({'a': artist, 't': title}).t AS title FROM x GROUP BY item""")(lambda s, d: P.canonical(interactions(s, d)))

query(
    "a2_best_rows",
    X + """, n AS (SELECT item, artist, title, count(*) AS plays FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY plays DESC, artist DESC, title DESC) AS k FROM n)
    SELECT item, plays, artist, title FROM r WHERE k = 1""",
)(lambda s, d: P.best_rows(interactions(s, d)))

query(
    "a3_name_conflicts", X + "SELECT artist, title, count(DISTINCT item) AS items, min(item) AS first_item FROM x GROUP BY artist, title HAVING count(DISTINCT item) > 1"
)(lambda s, d: P.name_conflicts(interactions(s, d)))

query(
    "a4_history_strength",
    E + """SELECT item, round(sum(coalesce(value, 1)), 4) AS strength, count(*) AS plays, min(e.event_id) AS first_event
    FROM e JOIN events ON e.event_id = events.event_id GROUP BY item ORDER BY sum(coalesce(value, 1)) DESC, plays DESC, first_event LIMIT 500""",
)(lambda s, d: P.history_strength(listens(s, d).join(table(s, d, "events").select("event_id", "value"), "event_id")).withColumn("strength", F.round("strength", 4)))

query("a9_active_users", E + """SELECT "user", count(*) AS listens FROM e WHERE "user" NOT IN (SELECT "user" FROM e WHERE action = 'signup' AND item < 8) GROUP BY "user" HAVING count(*) >= 20""")(
    lambda s, d: P.active_users(listens(s, d), 20, listens(s, d).where("action = 'signup' AND item < 8").select("user").distinct())
)

query(
    "a10_ingest_report",
    E + """SELECT count(*) AS parsed, count(DISTINCT {'u': "user", 't': ts, 'i': item}) AS unique_rows, count(*) FILTER (NOT ("user" IS NOT NULL AND ts > 0 AND item IS NOT NULL)) AS invalid,
    count(DISTINCT "user") AS users, count(DISTINCT item) AS items, min(ts) AS first_ts, max(ts) AS last_ts, 'AUDITED' AS status FROM e""",
)(lambda s, d: P.ingest_report(listens(s, d)))

query(
    "a11_macro_mean",
    X + """, m AS (SELECT artist, "user", avg(weight) AS m FROM x GROUP BY ALL) SELECT artist, round(avg(m), 6) AS mean, count(*) AS members FROM m GROUP BY artist""",
)(lambda s, d: P.macro_mean(interactions(s, d), "artist", "user", "weight").withColumn("mean", F.round("mean", 6)))

query(
    "a12_session_weight",
    X + """, p AS (SELECT "user", ctx, artist, count(DISTINCT item) AS n FROM x GROUP BY ALL), d AS (SELECT "user", ctx, max(n) / sum(n) AS dom FROM p GROUP BY ALL)
    SELECT "user", ctx, round((1 - 0.8 * dom) / count(*) OVER (PARTITION BY "user"), 6) AS weight FROM d""",
)(lambda s, d: P.session_weight(interactions(s, d)).withColumn("weight", F.round("weight", 6)))

query("a13_artist_listeners", X + """SELECT artist, count(DISTINCT "user") AS listeners FROM x GROUP BY artist""")(lambda s, d: P.artist_listeners(interactions(s, d)))

query(
    "a14_popularity_cuts",
    X + """, i AS (SELECT item, count(DISTINCT "user") AS n FROM x GROUP BY item), a AS (SELECT artist, count(DISTINCT "user") AS n FROM x GROUP BY artist)
    SELECT round((SELECT greatest(quantile_cont(n, 0.99), quantile_cont(n, 0.5) + 1) FROM i), 4) AS item_cut, round((SELECT greatest(quantile_cont(n, 0.995), quantile_cont(n, 0.5) + 1) FROM a), 4) AS artist_cut""",
)(lambda s, d: P.popularity_cuts(interactions(s, d)).select(F.round("item_cut", 4).alias("item_cut"), F.round("artist_cut", 4).alias("artist_cut")))

query(
    "a18_standardizer",
    X + """SELECT 'pos' AS feature, round(avg(pos), 6) AS mean, round(greatest(stddev_samp(pos), 0.05), 6) AS scale FROM x
    UNION ALL SELECT 'weight', round(avg(weight), 6), round(greatest(stddev_samp(weight), 0.05), 6) FROM x""",
)(lambda s, d: P.standardizer(interactions(s, d), ["pos", "weight"]).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")))

query(
    "a20_feedback_summary",
    E + """SELECT "user", count(*) FILTER (action IN ('click', 'purchase')) AS likes, count(*) FILTER (action = 'error') AS dislikes, count(*) FILTER (action = 'signup') AS known FROM e GROUP BY "user" """,
)(
    lambda s, d: listens(s, d).groupBy("user").agg(
        F.count_if(F.col("action").isin("click", "purchase")).alias("likes"), F.count_if(F.col("action") == "error").alias("dislikes"), F.count_if(F.col("action") == "signup").alias("known")
    )
)

query(
    "a21_vocabulary",
    X + """, t AS (SELECT 'title' AS field, title AS value, count(*) AS plays FROM x GROUP BY title ORDER BY plays DESC, value LIMIT 8192), a AS (SELECT 'artist' AS field, artist AS value, count(*) AS plays FROM x GROUP BY artist ORDER BY plays DESC, value LIMIT 4096)
    SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) - 1 AS id FROM (SELECT * FROM t UNION ALL SELECT * FROM a)""",
)(lambda s, d: (lambda x: P.vocabulary(x, "title", 8192).select(F.lit("title").alias("field"), F.col("title").alias("value"), "plays", "id").union(P.vocabulary(x, "artist", 4096).select(F.lit("artist"), "artist", "plays", "id")))(interactions(s, d)))

query(
    "p4_profile_suitability",
    X + """, n AS (SELECT "user", item, count(*) AS c FROM x GROUP BY ALL)
    SELECT "user", count(*) AS items, count(*) FILTER (c >= 2) AS repeated FROM n GROUP BY "user" HAVING count(*) >= 20 AND count(*) FILTER (c >= 2) >= 1""",
)(
    lambda s, d: interactions(s, d).groupBy("user", "item").agg(F.count("*").alias("c")).groupBy("user").agg(F.count("*").alias("items"), F.count_if(F.col("c") >= 2).alias("repeated")).where("items >= 20 AND repeated >= 1")
)

query(
    "p5_spam_filter",
    X + """, p AS (SELECT ctx, artist, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT ctx, CAST(sum(n) AS BIGINT) AS length, max(n) AS top FROM p GROUP BY ctx)
    SELECT * FROM c WHERE length BETWEEN 2 AND 150 AND (length <= 3 OR top / length <= 0.85)""",
)(lambda s, d: S.spam_filtered(interactions(s, d)))

query(
    "p6_eligible",
    X + """SELECT "user", ctx, pos, item FROM x WHERE "user" IN (SELECT "user" FROM x GROUP BY "user" HAVING count(DISTINCT item) BETWEEN 5 AND 2000)
    AND ctx IN (SELECT ctx FROM x GROUP BY ctx HAVING count(DISTINCT item) BETWEEN 2 AND 80)""",
)(lambda s, d: S.eligible(interactions(s, d)).select("user", "ctx", "pos", "item"))

query(
    "p14_history_cap",
    X + """, f AS (SELECT "user", item, min(ts) AS first_ts FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY first_ts, item) AS k FROM f)
    SELECT "user", item, k FROM r WHERE k <= 200""",
)(
    lambda s, d: interactions(s, d).groupBy("user", "item").agg(F.min("ts").alias("first_ts")).withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy("first_ts", "item"))).where("k <= 200").select("user", "item", "k")
)
