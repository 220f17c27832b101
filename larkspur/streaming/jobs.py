"""Streams over listens: ingest without repeats, sessions, feedback state, and online weights.

Late data: rows more than the watermark behind are dropped by Spark's operators. Sessions that are open when a stream
ends stay open; a replay pushes a closing row past the watermark to see them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_events(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    """event_id, user, time, item, action from a folder of event files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.select("event_id", F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("time"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("event_type").alias("action"))


def deduplicated(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """One row for each (user, time, item)."""
    return events.withWatermark("time", watermark).dropDuplicatesWithinWatermark(["user", "time", "item"])


def gap_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """user, started, ended, listens of sessions closed by a gap."""
    g = events.withWatermark("time", watermark).groupBy("user", F.session_window("time", gap).alias("w"))
    return g.agg(F.count("*").alias("listens")).select("user", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "listens")


class CappedSessions(StatefulProcessor):
    """Sessions that end by a gap or once they have lasted ``longest`` seconds; an event-time timer closes them. Rows wait
    until the watermark has passed them, so that they are taken in order. A user has one timer that counts, where the next
    session can end, and a user's rows of a micro-batch are put into the state at once."""

    GAP, LONGEST = 1800, 14400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long")
        self.session = handle.getValueState("session", "start long, last long, listens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, [int(ts) for part in rows for ts in part["ts"].tolist()], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, [], timerValues.getCurrentWatermarkInMs())

    def _taken(self, key, new: list[int], watermark: int) -> list[pd.DataFrame]:
        ready, later, out = [], [], []
        had = [ts for (ts,) in self.waiting.get()]
        for ts in had + new:
            (ready if ts * 1000 <= watermark else later).append(ts)
        before = now = self.session.get()
        for ts in sorted(ready):
            if now and (ts - now[1] > self.GAP or ts - now[0] > self.LONGEST):
                out.append((key[0], *now))
                now = None
            now = (now[0], ts, now[2] + 1) if now else (ts, ts, 1)
        if now and watermark > (now[1] + self.GAP) * 1000:  # whatever waits is behind the watermark's gap
            out.append((key[0], *now))
            now = None
        if later and later != had:
            self.waiting.put([(ts,) for ts in later])
        elif had and not later:
            self.waiting.clear()
        if now and now != before:
            self.session.update(now)
        elif before and not now:
            self.session.clear()
        if now or later:  # nothing ends before the open session can, or else the first of the waiting rows
            self.handle.registerTimer(((now[1] if now else min(later)) + self.GAP) * 1000)
        return [pd.DataFrame(out, columns=["user", "started", "ended", "listens"])] if out else []

    def close(self) -> None:
        pass


def capped_sessions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """user, started, ended (epoch seconds), listens. Needs the RocksDB state store."""
    e = events.withWatermark("time", watermark).select("user", "time", F.unix_timestamp("time").alias("ts"))
    return e.groupBy("user").transformWithStateInPandas(CappedSessions(), "user long, started long, ended long, listens long", "Append", "EventTime")


# The feedback journal: like and dislike set the preference, known the familiarity, clear resets both, undo cancels one row.


def active_feedback(journal: DataFrame) -> DataFrame:
    """The journal (user, sequence, action, item, target) without undone rows and without the undos."""
    undone = journal.where("action = 'undo'").select("user", F.col("target").alias("sequence"))
    return journal.where("action <> 'undo'").join(undone, ["user", "sequence"], "left_anti")


def feedback_state(journal: DataFrame) -> DataFrame:
    """(user, item, preference, known): the last write wins for each; what was never reviewed is null, not negative."""
    a = active_feedback(journal)
    cleared = a.where("action = 'clear'").groupBy("user", "item").agg(F.max("sequence").alias("cleared"))
    a = a.where("action <> 'clear'").join(cleared, ["user", "item"], "left").where("cleared IS NULL OR sequence > cleared")
    pref = F.max_by(F.when(F.col("action") == "like", 1).when(F.col("action") == "dislike", -1), F.when(F.col("action").isin("like", "dislike"), F.col("sequence")))
    known = F.max_by(F.when(F.col("action") == "known", True).when(F.col("action") == "new", False), F.when(F.col("action").isin("known", "new"), F.col("sequence")))
    return a.groupBy("user", "item").agg(pref.alias("preference"), known.alias("known"))


def online_weights(rows: DataFrame, dims: int, eta: float = 0.1) -> DataFrame:
    """(user, theta) after theta += eta * (y - sigmoid(theta . x)) * x over a user's rows (sequence, x, y) in order."""
    ordered = rows.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("sequence", "x", "y"))).alias("r"))

    def step(theta, row):
        s = F.aggregate(F.zip_with(theta, row["x"], lambda a, b: a * b), F.lit(0.0), lambda p, v: p + v)
        return F.zip_with(theta, row["x"], lambda a, b: a + eta * (row["y"] - 1 / (1 + F.exp(-s))) * b)

    return ordered.select("user", F.aggregate("r", F.array_repeat(F.lit(0.0), dims), step).alias("theta"))


def sharded(events: DataFrame, shards: int = 32) -> DataFrame:
    """Rows of a user in one partition of bounded number."""
    return events.repartition(shards, "user")


def latest(journal: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return journal.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
