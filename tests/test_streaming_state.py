"""Keyed stream state over several micro-batches with a restart, against plain Python; late rows."""

import os
import random
import time

os.environ["TZ"] = "UTC"
time.tzset()

from pyspark.sql import functions as F  # noqa: E402

from larkspur.streaming import feedback as K  # noqa: E402
from larkspur.streaming import jobs as J  # noqa: E402
from larkspur.streaming.replay import replayed  # noqa: E402

JOURNAL = "user long, sequence long, action string, item long, target long"


def _state(rows):
    undone = {(u, t) for u, _, a, _, t in rows if a == "undo" and t is not None}
    out = {}
    for u, s, a, i, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if a != "undo" and (u, s) not in undone:
            now = out.setdefault((u, i), {})
            if a == "clear":
                now.clear()
            else:
                now[K.SETS[a][0]] = K.SETS[a][1]
    return {k: (v.get("preference", 0), v.get("known", False)) for k, v in out.items() if v}


def _appended(spark, tmp_path, frames, job):
    """Each frame is a file and a micro-batch; the job starts anew for each from its checkpoint."""
    at, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    result = None
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(at)
        result = job(spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(at))
        q = result.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def test_feedback_state_with_early_late_and_missing_undos(spark, tmp_path):
    rng, rows = random.Random(4), []
    for s in range(240):
        u = rng.randrange(3)
        action = rng.choice(["like", "dislike", "known", "new", "clear", "undo", "like"])
        rows.append((u, s, action, None if action == "undo" else rng.randrange(6), rng.choice([None, s - 1, rng.randrange(240)]) if action == "undo" else None))
    rows.append((0, 500, "undo", None, 999))
    rng.shuffle(rows)  # undos come before and after what they name, in other batches too
    frames = [spark.createDataFrame(rows[k::4], JOURNAL) for k in range(4)]
    changes = _appended(spark, tmp_path, frames, K.feedback_changes)
    assert {(r.user, r.item): (r.preference, r.known) for r in K.current(changes).collect()} == _state(rows)


def test_weights_and_throttle_equal_a_walk(spark):
    import math

    rng = random.Random(7)
    rows = [(u, 10 * k + u, [1.0, rng.random()], float(rng.random() < 0.5)) for k in range(60) for u in range(4)]
    df = spark.createDataFrame(rows, "user long, sequence long, x array<double>, y double").repartition(3)
    got = {r.user: r.theta for r in K.last_weights(replayed(df, "sequence", lambda r: K.weight_changes(r, 2), files=5)).collect()}
    for u in range(4):
        theta = [0.0, 0.0]
        for _, _, x, y in sorted(r for r in rows if r[0] == u):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(theta, x))))
            theta = [a + 0.1 * (y - p) * b for a, b in zip(theta, x)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[u], theta))
    hits = [(k % 3, k, k * rng.choice([100, 700, 1500])) for k in range(90)]
    out = {r.event_id: (r.allow, r.reset) for r in replayed(spark.createDataFrame(hits, "user long, event_id long, ts long"), "ts", K.throttled).collect()}
    state = {}
    for ts, event, u in sorted((t, e, u) for u, e, t in hits):
        start, used = state.get(u, (None, 0))
        if start is None or ts - start >= 3600:
            start, used = ts, 0
        state[u] = (start, used + 1)
        assert out[event] == (used + 1 <= 3, start + 3600 - ts)
    assert len(out) == len(hits)


def test_a_replay_takes_a_file_a_batch_and_goes_on_after_a_restart(spark, tmp_path):
    from pyspark.sql.streaming.listener import StreamingQueryListener

    seen = []

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if event.progress.numInputRows:
                seen.append((event.progress.runId, event.progress.batchId))

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        rows = spark.range(100).select(F.col("id").alias("user"), F.col("id").alias("event_id"), F.col("id").alias("ts"))
        assert replayed(rows, "ts", K.throttled).count() == 100
        deadline = time.time() + 20
        while len(seen) < 4 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert len(seen) >= 4 and len({run for run, _ in seen}) == 2 and len({batch for _, batch in seen}) == len(seen)


def test_a_row_behind_the_watermark_is_dropped(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, "user long, at long, item long").select("user", F.timestamp_seconds("at").alias("time"), "item")

    t = 1_700_000_000
    frames = [frame([(1, t, 5), (1, t + 20_000, 6)]), frame([(1, t + 100, 7), (1, t + 19_000, 8)]), frame([(1, t + 200, 9), (2, t + 40_000, 1)]), frame([(1, t + 20_000, 6)])]
    got = {r.item for r in _appended(spark, tmp_path / "a", frames, J.deduplicated).collect()}
    assert got == {5, 6, 8, 1}  # 7 and 9 are over an hour behind what came before them, the last row repeats one
    sessions = _appended(spark, tmp_path / "b", frames[:3] + [frame([(3, t + 90_000, 1)])], J.gap_sessions)
    assert sorted((r.user, r.listens) for r in sessions.collect()) == [(1, 1), (1, 2), (2, 1)]
