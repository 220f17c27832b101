"""Draws from unions of lists, pools met in blocks, and lists from candidates that are never written whole."""

import random

from pyspark.sql import functions as F

from larkspur.operators import discovery as D
from larkspur.operators import matching as M
from larkspur.operators import numbering as N
from larkspur.operators import ranking as R
from larkspur.operators import sampling as A


def test_numbers_within_unions_of_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "FAN", 3)
    rng = random.Random(7)
    entries = [(rng.randrange(6), i) for i in range(150)]
    lists = [(p, x) for p in range(5) for x in range(6) if (p + x) % 5 and rng.random() < 0.7]
    want = {p: [i for x, i in entries if (p, x) in set(lists)] for p in range(5)}
    picks = [(p, n) for p, own in want.items() for n in range(len(own))]
    s = spark.createDataFrame
    got = N.in_unions(s(picks, "pool long, number long"), s(lists, "pool long, list long"), s(entries, "list long, item long"))
    assert {(r.pool, r.number): r.item for r in got.collect()} == {(p, n): want[p][n] for p, n in picks}


def test_matched_negatives_write_no_pool(spark, monkeypatch):
    """20 users who know all of 4 artists: their pools have 8,000 rows, of which none is written."""
    written = []
    monkeypatch.setattr(N, "cut", lambda df, name="", keep=N.cut: written.append((df := keep(df, name)).count()) or df)
    monkeypatch.setattr(A, "cut", N.cut)
    x = [(100 * u, a, 400 * k + 4 * u + a) for u in range(20) for a in range(4) for k in range(1)] + [(1, i % 4, i) for i in range(400)]
    x = spark.createDataFrame(x, "user long, artist long, item long")
    got = A.matched_negatives(x).collect()
    assert len(got) == 80 and len({(r.query, r.positive) for r in got}) == 80
    known = {(r.user, r.item) for r in x.collect()}
    assert not any((r.query, r.negative) in known for r in got)
    assert max(written) <= 400


def _plan_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def _listens(users=40, items=60, seed=3):
    rng = random.Random(seed)
    return sorted({(u, rng.randrange(items)) for u in range(users) for _ in range(9)})


def test_candidates_are_dealt_by_query_once(spark, monkeypatch):
    """Users of many rows of items, columns carried, known ones left out; and rankings by query need no further exchange."""
    monkeypatch.setattr(R, "ITEMS", 4)
    know = _listens()
    seeds = [(q, i) for q, i in know if q % 10 == 0][::2]
    history = [(u, i, i % 7) for u, i in know if u % 10]
    s = spark.createDataFrame
    sd = s(seeds, "query long, item long")
    found = R.co_listen(sd, s(history, "user long, item long, kind long"), sd, ("kind",))
    owners = {i: sum(1 for _, j, _ in history if j == i) for _, i, _ in history}
    want = {}
    for q in {q for q, _ in seeds}:
        mine = {i for p, i in seeds if p == q}
        for u in {u for u, _, _ in history}:
            own = {i for v, i, _ in history if v == u}
            for i in own - mine if own & mine else ():
                for x in own & mine:
                    t = want.setdefault((q, i), [0.0, set()])
                    t[0] += owners[x] ** -0.5
                    t[1].add(x)
    got = {(r.query, r.item): r for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k].score - v[0]) < 1e-9 and got[k].support == len(v[1]) and got[k].kind == k[1] % 7 for k, v in want.items())
    both = M.candidate_union(found.select("query", "item", "score", "support"), ["score", "support"], 5)
    for df in (R.top_k(found, 5), both):
        assert "REPARTITION_BY_NUM" in _plan_exchanges(df)[0]  # nothing is dealt after that


def _candidates(spark):
    rng = random.Random(11)
    rows = [(q, i, i % 5, i % 23 * 5 + i % 5, i % 3 == 0, i % 4 == 0, float(rng.randrange(40))) for q in range(4) for i in range(400)]
    return spark.createDataFrame(rows, "query long, item long, artist long, family long, familiar boolean, popular boolean, score double")


def test_lists_from_few_candidates_equal_lists_from_all(spark, monkeypatch):
    """Neither writes all of the candidates where the first ones do."""
    written = []
    monkeypatch.setattr(R, "cut", lambda df, name="", keep=R.cut: written.append((df := keep(df, name)).count()) or df)
    c = _candidates(spark)
    items = c.select("item", "artist", F.col("family").alias("identity")).distinct()
    few, whole = (sorted(map(tuple, R.diversified(c, items, 8, 2, first=n).collect())) for n in (3, 1000))
    assert few == whole and len(whole) == 32
    narrow = c.drop("artist")
    artists = c.select("family", "artist").distinct()
    walk = lambda t, **k: sorted(map(tuple, R.no_adjacent_artist(t, 8, 2, familiar=0.5, **k).select("query", "item", "place").collect()))
    assert walk(narrow, artists=artists, first=3) == walk(c, first=3) == walk(c)
    written.clear()
    R.diversified(c, items, 8, 2, first=100).collect()
    assert max(written) <= 4 * 101
    written.clear()
    assert len(walk(c, first=100)) == 32 and max(written) <= 4 * 101


def test_two_stages_read_the_catalog_for_the_first_only(spark):
    c = _candidates(spark).select("query", "item", F.col("family").alias("identity"), F.col("score").alias("lift"), F.lit(3).alias("support"))
    more = c.select("item").distinct().withColumn("percentile", F.col("item") / 400)
    seeds = c.select("query").distinct().withColumn("seeds", F.lit(9))
    exact = F.col("lift") - F.col("percentile")
    a = D.two_stage(c, exact, seeds, 5, 20, items=more).collect()
    b = D.two_stage(c.join(more, "item"), exact, seeds, 5, 20).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 20
