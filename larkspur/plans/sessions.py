"""Sessions, pairs, hold-outs and throttling over the events and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources.tables import INTERACTIONS, LISTENS, interactions, listens
from .base import query

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS

GAP = """, l AS (SELECT *, lag(ts) OVER w AS before FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id)),
c AS (SELECT *, sum(CASE WHEN ts - before > 1800 AND before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l),
n AS (SELECT *, count(*) OVER (PARTITION BY "user", session) AS n FROM c),
g AS (SELECT "user", CAST(session AS BIGINT) AS session, row_number() OVER (PARTITION BY "user", session ORDER BY ts, event_id) - 1 AS pos, ts, item FROM n WHERE n >= 2)
"""

query("w1_gap_sessions", E + GAP + 'SELECT * FROM g')(lambda s, d: S.gap_sessions(listens(s, d)))

query(
    "w3_adjacent_repeats", E + GAP + ', k AS (SELECT *, lag(item) OVER (PARTITION BY "user", session ORDER BY pos) AS b FROM g) SELECT "user", session, pos, ts, item FROM k WHERE b IS NULL OR b <> item'
)(lambda s, d: S.without_adjacent_repeats(S.gap_sessions(listens(s, d))))

query(
    "w2_capped_sessions",
    E.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT "user", ts, item, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS k FROM e),
    r AS (SELECT "user", k, ts, item, CAST(0 AS BIGINT) AS session, ts AS start FROM o WHERE k = 1
      UNION ALL SELECT o."user", o.k, o.ts, o.item, CASE WHEN o.ts - r.ts > 1800 OR o.ts - r.start > 14400 THEN r.session + 1 ELSE r.session END,
      CASE WHEN o.ts - r.ts > 1800 OR o.ts - r.start > 14400 THEN o.ts ELSE r.start END FROM r JOIN o ON o."user" = r."user" AND o.k = r.k + 1)
    SELECT "user", session, min(ts) AS started, count(*) AS listens, count(DISTINCT item) AS items FROM r GROUP BY "user", session""",
)(lambda s, d: S.capped_sessions(listens(s, d)))

query(
    "j9_window_pairs",
    X + ', o AS (SELECT ctx, item, row_number() OVER (PARTITION BY ctx ORDER BY pos, item) AS k FROM x) SELECT l.item AS a, r.item AS b, count(*) AS n FROM o l JOIN o r ON l.ctx = r.ctx AND l.k <> r.k AND abs(l.k - r.k) <= 5 GROUP BY 1, 2',
)(lambda s, d: S.window_pairs(interactions(s, d)))

query(
    "w7_protocol_split",
    X + """, k AS (SELECT ctx, item, row_number() OVER (PARTITION BY ctx ORDER BY pos, item) AS k, count(*) OVER (PARTITION BY ctx) AS n FROM x)
    SELECT ctx, item, k <= least(1, n - 1) AS one, k <= least(5, n - 1) AS five, k <= greatest(1, floor(n * 0.3)) AS third, k <= greatest(1, floor(n * 0.7)) AS most FROM k WHERE n >= 2""",
)(lambda s, d: _protocol(interactions(s, d)))


def _protocol(x):
    from pyspark.sql import Window

    w = Window.partitionBy("ctx")
    k = x.withColumn("k", F.row_number().over(w.orderBy("pos", "item"))).withColumn("n", F.count("*").over(w)).where("n >= 2")
    cut = {"one": F.least(F.lit(1), F.col("n") - 1), "five": F.least(F.lit(5), F.col("n") - 1), "third": F.greatest(F.lit(1), F.floor(F.col("n") * 0.3)), "most": F.greatest(F.lit(1), F.floor(F.col("n") * 0.7))}
    return k.select("ctx", "item", *[(F.col("k") <= c).alias(name) for name, c in cut.items()])


query(
    "w11_temporal_holdout",
    E + """, r AS (SELECT "user", event_id, item, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY "user") AS n FROM e),
    p AS (SELECT *, back <= greatest(4, floor(n * 0.2)) AS held FROM r)
    SELECT "user", event_id, held FROM p WHERE held OR NOT EXISTS (SELECT 1 FROM p q WHERE q.held AND q."user" = p."user" AND q.item = p.item)""",
)(lambda s, d: S.temporal_holdout(listens(s, d)))

query(
    "st8_throttle",
    E.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT "user", event_id, ts, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS k FROM e),
    r AS (SELECT "user", k, event_id, ts, ts AS start, 1 AS used FROM o WHERE k = 1
      UNION ALL SELECT o."user", o.k, o.event_id, o.ts, CASE WHEN o.ts - r.start >= 3600 THEN o.ts ELSE r.start END, CASE WHEN o.ts - r.start >= 3600 THEN 1 ELSE r.used + 1 END
      FROM r JOIN o ON o."user" = r."user" AND o.k = r.k + 1)
    SELECT "user", event_id, used <= 3 AS allow, start + 3600 - ts AS reset FROM r""",
)(lambda s, d: S.throttled(listens(s, d)))
