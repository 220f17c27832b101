"""Feedback state and stream jobs' batch answers over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import LISTENS, listens
from ..streaming import jobs as J
from .base import query

E = "WITH " + LISTENS

JOURNAL = """, j AS (SELECT "user", event_id AS sequence, item, CASE action WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'known' WHEN 'error' THEN 'dislike' WHEN 'signup' THEN 'undo' ELSE 'clear' END AS action,
 CASE WHEN action = 'signup' THEN lag(event_id) OVER (PARTITION BY "user" ORDER BY event_id) END AS target FROM e),
a AS (SELECT * FROM j WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM j u WHERE u.action = 'undo' AND u."user" = j."user" AND u.target = j.sequence))"""


def journal(s, d):
    from pyspark.sql import Window

    e = listens(s, d)
    action = F.when(F.col("action") == "click", "like").when(F.col("action") == "purchase", "known").when(F.col("action") == "error", "dislike").when(F.col("action") == "signup", "undo").otherwise("clear")
    before = F.lag("event_id").over(Window.partitionBy("user").orderBy("event_id"))
    return e.select("user", F.col("event_id").alias("sequence"), "item", action.alias("action"), F.when(F.col("action") == "signup", before).alias("target"))


query("st5_active_feedback", E + JOURNAL + ' SELECT "user", sequence, item, action FROM a')(lambda s, d: J.active_feedback(journal(s, d)).select("user", "sequence", "item", "action"))

query(
    "st4_feedback_state",
    E + JOURNAL + """, c AS (SELECT "user", item, max(sequence) AS cleared FROM a WHERE action = 'clear' GROUP BY 1, 2), v AS (SELECT a.* FROM a LEFT JOIN c ON a."user" = c."user" AND a.item = c.item WHERE a.action <> 'clear' AND (cleared IS NULL OR sequence > cleared))
    SELECT "user", item, coalesce(CAST(arg_max(CASE action WHEN 'like' THEN 1 WHEN 'dislike' THEN -1 END, sequence) FILTER (action IN ('like', 'dislike')) AS INTEGER), 0) AS preference, coalesce(bool_or(action = 'known'), false) AS known FROM v GROUP BY 1, 2""",
)(lambda s, d: J.feedback_state(journal(s, d)).withColumn("known", F.coalesce("known", F.lit(False))).withColumn("preference", F.coalesce(F.col("preference"), F.lit(0)).cast("int")))


@query(
    "st7_online_weights",
    E.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY event_id) AS k, item / 100.0 AS x1, (item % 7) / 7.0 AS x2, CASE WHEN action IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END AS y FROM e),
    r AS (SELECT DISTINCT "user", CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM o
      UNION ALL SELECT "user", k, a + g, b + g * x1, c + g * x2 FROM (SELECT o."user", o.k, a, b, c, x1, x2, 0.1 * (y - 1 / (1 + exp(-(a + b * x1 + c * x2)))) AS g FROM r JOIN o ON o."user" = r."user" AND o.k = r.k + 1)),
    l AS (SELECT "user", max(k) AS k FROM r GROUP BY 1) SELECT r."user", round(a, 6) AS t0, round(b, 6) AS t1, round(c, 6) AS t2 FROM r JOIN l ON r."user" = l."user" AND r.k = l.k""",
)
def _weights(s, d):
    return J.online_weights(weight_rows(s, d), 3).select("user", *[F.round(F.col("theta")[i], 6).alias(f"t{i}") for i in range(3)])


def weight_rows(s, d):
    return listens(s, d).select("user", F.col("event_id").alias("sequence"), F.array(F.lit(1.0), F.col("item") / 100.0, (F.col("item") % 7) / 7.0).alias("x"), F.col("action").isin("click", "purchase").cast("double").alias("y"))
