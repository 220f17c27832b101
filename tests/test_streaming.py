"""Streams fed in shuffled micro-batches give the batch answer."""

import datetime
import os
import random
import time

os.environ["TZ"] = "UTC"
time.tzset()

from pyspark.sql import functions as F  # noqa: E402

from larkspur.streaming import jobs as J  # noqa: E402


def _events(spark, tmp_path):
    random.seed(3)
    rows, t = [], 1_700_000_000
    for i in range(300):
        t += random.choice([60, 300, 900, 2500])
        rows.append((i, i % 4, t, i % 9))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, k long")
    df = df.select("event_id", F.timestamp_seconds("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.to_json(F.struct("k")).alias("props"))
    for i in range(3):
        part = df.where((F.col("event_id") >= i * 100) & (F.col("event_id") < (i + 1) * 100)).orderBy(F.rand(i)).coalesce(1)
        part.union(part.limit(5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    close = spark.createDataFrame([(9999, 99, t + 10**6)], "event_id long, user_id long, ts long").select("event_id", F.timestamp_seconds("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    return rows, close


def _run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    return q


def test_ingest_drops_repeats(spark, tmp_path):
    rows, _ = _events(spark, tmp_path)
    q = _run(J.deduplicated(J.read_events(spark, str(tmp_path / "in"), 10), "1000 days"), "dedup", tmp_path)
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup").count() == len(rows)


def test_sessions_equal_batch(spark, tmp_path):
    rows, close = _events(spark, tmp_path)
    e = J.read_events(spark, str(tmp_path / "in"), 10)
    q = _run(J.gap_sessions(e, watermark="60 days"), "gaps", tmp_path)
    q.processAllAvailable()
    close.withColumn("ts", F.col("ts") + F.expr("INTERVAL 300 DAYS")).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r.user, int(r.started.replace(tzinfo=datetime.timezone.utc).timestamp())) for r in spark.table("gaps").collect() if r.user != 99}
    assert got == _starts(rows, None)


def test_capped_sessions_equal_batch(spark, tmp_path):
    rows, close = _events(spark, tmp_path)
    far = close.withColumn("ts", F.col("ts") + F.expr("INTERVAL 300 DAYS"))
    q = _run(J.capped_sessions(J.read_events(spark, str(tmp_path / "in"), 10).dropDuplicates(["event_id"]), "60 days"), "capped", tmp_path)
    q.processAllAvailable()
    far.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r.user, r.started) for r in spark.table("capped").collect() if r.user != 99}
    assert got == _starts(rows, 14400)


def _starts(rows, longest):
    out, state = set(), {}
    for _, u, t, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.get(u)
        if s is None or t - s[1] > 1800 or longest and t - s[0] > longest:
            s = (t, t)
            out.add((u, t))
        state[u] = (s[0], t)
    return out


def test_feedback_undo_and_clear(spark):
    j = spark.createDataFrame(
        [(1, 1, "like", 5, None), (1, 2, "known", 5, None), (1, 3, "dislike", 5, None), (1, 4, "undo", None, 3), (1, 5, "like", 6, None), (1, 6, "clear", 6, None), (1, 7, "new", 7, None)],
        "user long, sequence long, action string, item long, target long",
    )
    got = {r.item: (r.preference, r.known) for r in J.feedback_state(j).collect()}
    assert got == {5: (1, True), 7: (None, False)}
