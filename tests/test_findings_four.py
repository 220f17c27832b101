"""Tests of steps that grow with their input, named in FINDINGS_r03.md (third session)."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larkspur.operators import embeddings as E
from larkspur.operators import sampling as N
from larkspur.operators import vectors as V
from larkspur.streaming import jobs as J


def test_pooled_negatives_place_few_pairs_and_take_the_same(spark, monkeypatch):
    """with a low bound (done again for pools that are short) and several blocks of items, as with all pairs."""
    rng = random.Random(5)
    items = spark.createDataFrame([(i, rng.randrange(1, 9), [rng.random(), rng.choice([0.0, 0.5]), 1.0]) for i in range(400)], "item long, users long, vec array<double>")
    known = spark.createDataFrame([(q, rng.randrange(450)) for q in (100, 200) for _ in range(150)] + [(300, i) for i in range(397)], "query long, item long").distinct()
    positives = known.where("item % 40 = 0 AND item < 400").select("query", F.col("item").alias("positive"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(N.pooled_negatives(positives, known, items, 3, placed=10**6))
    monkeypatch.setattr(N, "ITEM_BLOCK", 150)
    assert rows(N.pooled_negatives(positives, known, items, 3, placed=4)) == whole
    vec = {r.item: (np.array(r.vec), r.users) for r in items.collect()}
    free = {q: set(vec) - {r.item for r in known.where(f"query = {q}").collect()} for q in (100, 300)}
    for q, p in {(r["query"], r["positive"]) for r in positives.collect() if r["query"] in free}:
        by_sim = sorted(free[q], key=lambda i: (round(float(vec[i][0] @ vec[p][0]), 9), i))
        n = len(by_sim)
        assert {i for a, b, i, k in whole if (a, b, k) == (q, p, 2)} <= set(by_sim[n // 3 : max(n // 3 + 1, 2 * n // 3)])
        assert len([1 for a, b, *_ in whole if (a, b) == (q, p)]) == (12 if n > 100 else n)


def test_capped_sessions_keep_few_timers_and_write_a_batch_at_once(spark):
    """F16: over several micro-batches as a walk in order; a call of the state per row or timer would be one too many."""
    rng, rows = random.Random(9), []
    for user in range(4):
        t = 1_700_000_000
        for _ in range(150):
            t += rng.choice([60, 600, 1800, 1801, 2500])
            rows.append((user, t))
    calls = {"timers": 0, "puts": 0}

    class State:
        value = None

        def get(self):
            return iter(self.value or []) if self.many else self.value

        def __init__(self, many):
            self.many = many

        def put(self, v):
            calls["puts"] += 1
            self.value = list(v)

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

    class Now:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at * 1000

    expected = []
    for user in range(4):
        now = None
        for ts in sorted(t for u, t in rows if u == user):
            if now and (ts - now[1] > 1800 or ts - now[0] > 14400):
                expected.append((user, *now))
                now = None
            now = (now[0], ts, now[2] + 1) if now else (ts, ts, 1)
        expected.append((user, *now))
    found = []
    for user in range(4):
        job, timers, now = J.CappedSessions(), set(), Now()
        job.waiting, job.session = State(True), State(False)
        job.handle = type("Handle", (), {"registerTimer": staticmethod(lambda t: (timers.add(t), calls.__setitem__("timers", calls["timers"] + 1)))})()
        mine = [t for u, t in rows if u == user]
        for k in range(0, 150, 50):
            frame = pd.DataFrame({"ts": rng.sample(mine[k : k + 50], 50)})
            found += [tuple(r) for out in job.handleInputRows((user,), iter([frame]), now) for r in out.itertuples(index=False)]
            now.at = mine[k + 49] + (10**6 if k == 100 else 0)
            while due := [t for t in timers if t <= now.at * 1000]:
                timers.remove(due[0])
                found += [tuple(r) for out in job.handleExpiredTimer((user,), now, None) for r in out.itertuples(index=False)]
    assert sorted(found) == sorted(expected)
    assert calls["timers"] <= 40 and calls["puts"] <= 20


def test_discovery_edges_reach_a_quantile_by_counts(spark, monkeypatch):
    """counts of a grid of several blocks against numpy; products that equal a number count."""
    rng = random.Random(3)
    vec = {i: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for i in range(90)}
    items = spark.createDataFrame(list(vec.items()), "id long, vec array<double>")
    asked = [(i, vec[i], sorted({round(float(np.dot(vec[i], vec[j])), 9) for j in range(0, 90, 7)})) for i in range(0, 90, 3)]
    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "ITEM_BLOCK", 40)
    found = V.counts_upto(items, spark.createDataFrame(asked, "id long, vec array<double>, limits array<double>")).collect()
    assert {(r.id, r.upto): r.n for r in found} == {(i, t): sum(round(float(np.dot(v, w)), 9) <= t for w in vec.values()) for i, v, limits in asked for t in limits}


def test_a_round_sends_a_vector_once_to_a_block(spark, monkeypatch):
    """matrix times vectors in several blocks and steps, with a column that has no vector; no row is an entry."""
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((60, 60)) < 0.3, rng.random((60, 60)), 0.0)
    dense[5] = 0.0
    matrix = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(*np.nonzero(dense))], "a long, b long, value double")
    x = rng.standard_normal((60, 3))
    x[7] = 0.0
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(60) if i != 7], "id long, vec array<double>")
    monkeypatch.setattr(E, "ENTRIES", 100)
    monkeypatch.setattr(E, "AT_ONCE", 16)
    rows, parts = E._blocks(matrix)
    assert rows.count() == 59
    for kind, close in (("double", 1e-12), ("float", 1e-5)):
        got = {r.id: r.vec for r in E._times(rows, parts, vectors, kind).collect()}
        assert sorted(got) == [i for i in range(60) if i != 5]
        assert all(np.allclose(v, dense[i] @ x, atol=close) for i, v in got.items())
