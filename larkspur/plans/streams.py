"""The stream jobs replayed over the given events until all are taken; results as the sink holds them then. A file is a
micro-batch, and each job is stopped half-way and started again from its checkpoint (streaming/replay.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import LISTENS, listens, table
from ..streaming import feedback as K
from ..streaming import jobs as J
from ..streaming.replay import replayed
from . import feedback, sessions  # noqa: F401
from .base import SQL, query

E = "WITH " + LISTENS


def _replayed(s, d, job):
    e = table(s, d, "events")
    item = F.get_json_object("props", "$.k").cast("long").alias("item")
    rows = e.select("event_id", F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("time"), item, F.col("event_type").alias("action"))
    return replayed(rows, "time", job)


query("st1_stream_ingest", E + """ SELECT DISTINCT "user", epoch_us(ev.ts) AS micros, item FROM e JOIN events ev ON ev.event_id = e.event_id""")(
    lambda s, d: _replayed(s, d, lambda e: J.deduplicated(e).select("user", F.unix_micros("time").alias("micros"), "item"))
)

query(
    "st2_stream_sessions",
    E + """, l AS (SELECT "user", epoch_us(ev.ts) AS t FROM e JOIN events ev ON ev.event_id = e.event_id), b AS (SELECT *, lag(t) OVER (PARTITION BY "user" ORDER BY t) AS before FROM l), c AS (SELECT *, sum(CASE WHEN t - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b),
    g AS (SELECT "user", min(t) AS started, max(t) + 1800000000 AS ended, count(*) AS listens FROM c GROUP BY "user", k) SELECT * FROM g WHERE ended <= (SELECT max(t) FROM l) - 3600000000""",
)(lambda s, d: _replayed(s, d, J.gap_sessions).select("user", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "listens"))

query(
    "st3_stream_capped_sessions",
    E.replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT "user", ts, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS k FROM e),
    r AS (SELECT "user", k, ts, CAST(0 AS BIGINT) AS session, ts AS start FROM o WHERE k = 1
      UNION ALL SELECT o."user", o.k, o.ts, CASE WHEN o.ts - r.ts > 1800 OR o.ts - r.start > 14400 THEN r.session + 1 ELSE r.session END, CASE WHEN o.ts - r.ts > 1800 OR o.ts - r.start > 14400 THEN o.ts ELSE r.start END FROM r JOIN o ON o."user" = r."user" AND o.k = r.k + 1),
    g AS (SELECT "user", min(ts) AS started, max(ts) AS ended, count(*) AS listens FROM r GROUP BY "user", session) SELECT * FROM g WHERE ended + 1800 < (SELECT max(epoch_us(ts)) FROM events) / 1000000 - 3600""",
)(lambda s, d: _replayed(s, d, J.capped_sessions))


@query("st4_stream_feedback", SQL["st4_feedback_state"])
def _feedback(s, d):
    rows = feedback.journal(s, d)
    return K.current(replayed(rows, "sequence", K.feedback_changes))


@query("st7_stream_weights", SQL["st7_online_weights"])
def _weights(s, d):
    theta = K.last_weights(replayed(feedback.weight_rows(s, d), "sequence", lambda r: K.weight_changes(r, 3)))
    return theta.select("user", *[F.round(F.col("theta")[i], 6).alias(f"t{i}") for i in range(3)])


query("st8_stream_throttle", SQL["st8_throttle"])(lambda s, d: replayed(listens(s, d).select("user", "event_id", "ts"), "ts", K.throttled))
