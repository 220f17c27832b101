"""Operators that SQL cannot state, and what happens at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import vector as Q
from larkspur.operators import numbering as N
from larkspur.operators import ranking as R
from larkspur.operators import sampling as K
from larkspur.operators import scoring as S
from larkspur.operators import vectors as V
from larkspur.sources import playlists as P
from larkspur.sources.sinks import publish


def _vectors(n, d=8, queries=2, seed=3):
    rng = np.random.default_rng(seed)
    return [(i % queries, i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]


def _heads(x, most=12, rounds=4):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = min(len(x), max(2, min(most, int(np.ceil(np.sqrt(len(x)))))))
    chosen = [0]
    while len(chosen) < n:
        chosen.append(int(np.round((x @ x[chosen].T).max(1), 12).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = np.round(x @ c.T, 12).argmax(1)
        c = np.array([x[own == h].sum(0) / np.linalg.norm(x[own == h].sum(0)) if (own == h).any() else c[h] for h in range(n)])
    return c, np.bincount(np.round(x @ c.T, 12).argmax(1), minlength=n)


def test_interest_heads_equal_numpy(spark):
    rows = _vectors(120) + [(9, 500, [1.0] * 8)]
    got = V.interest_heads(spark.createDataFrame(rows, "query long, id long, vec array<double>").repartition(5)).collect()
    for q in (0, 1, 9):
        c, sizes = _heads(np.array([r[2] for r in rows if r[0] == q]))
        mine = sorted((r.head, r.size, r.vec) for r in got if r["query"] == q)
        assert [m[1] for m in mine] == sizes.tolist() and np.allclose([m[2] for m in mine], c)


def test_head_checks_and_rank(spark):
    df = spark.createDataFrame(_vectors(100), "query long, id long, vec array<double>")
    assert all(r.same and r.separation < 1 and 0 < r.matched <= 1.0000001 for r in V.head_checks(df, V.interest_heads).collect())
    flat = df.select("id", F.transform("vec", lambda x, i: F.when(i < 5, x).otherwise(2.0)).alias("vec"))
    assert V.covariance_rank(df) == 8 and V.covariance_rank(flat) == 5


def test_softmax_and_unit(spark):
    r = spark.createDataFrame([([1.0, 2.0, 800.0],), ([0.0, 0.0, 0.0],)], "v array<double>").select(Q.softmax(F.col("v")), Q.unit(F.col("v"))).collect()
    assert np.allclose(r[0][0], [0, 0, 1]) and np.allclose(r[1][0], [1 / 3] * 3) and list(r[1][1]) == [0.0, 0.0, 0.0]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    assert all(r["index"] == i for i, r in enumerate(N.numbered(df, ["b", "a"]).orderBy("b", "a").collect()))
    assert N.numbered(df.limit(0), ["a"]).isEmpty()


def test_draws_are_filled_where_a_pool_is_small(spark):
    items = spark.createDataFrame([(0, i, i) for i in range(12)], "pool int, item long, number long")
    known = spark.createDataFrame([(1, i) for i in range(5)] + [(2, i) for i in range(12)], "query long, item long")
    asked = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (9, 2, 0)], "key long, query long, pool int")
    got = N.drawn(asked, items, known, ["key"], 6, 8).collect()
    assert {k: sorted(r.item for r in got if r.key == k) for k in (7, 8, 9)}[9] == []
    for k in (7, 8):
        mine = [r.item for r in got if r.key == k]
        assert len(mine) == len(set(mine)) == 6 and set(mine) <= set(range(5, 12))


def test_lists_do_not_depend_on_the_first_cut(spark):
    rows = [(q, i, f"a{i % 7}", f"f{i % 40}", i % 7 < 3, i % 4 == 0, float(100 - i % 83), f"d{i % 3}") for q in (1, 2) for i in range(150)]
    s = spark.createDataFrame(rows, "query long, item long, artist string, family string, familiar boolean, popular boolean, score double, direction string")
    one, two = (sorted(map(tuple, R.no_adjacent_artist(s, 30, 4, familiar=0.3, popular=0.2, first=n).collect())) for n in (2, 1000))
    assert one == two and len(one) > 20


def test_personal_layer_moves_only_where_ratings_support_it(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rated = [(1, i, float(v > 0), float(rng.normal()), float(v)) for i, v in enumerate(x)] + [(2, i, float(i % 2), 0.0, 1.0) for i in range(5)]
    rated = [(q, i, i, i // 5, *rest) for q, i, *rest in rated]  # five ratings an exposure
    ratings = spark.createDataFrame(rated, "query long, id long, sequence long, exposure long, label double, score double, f double")
    scores = spark.createDataFrame([(q, i, 0.1 * i, float(i - 2)) for q in (1, 2) for i in range(5)], "query long, item long, score double, f double")
    moved = {(r["query"], r.item): r.score for r in S.personal_layer(ratings, scores, ["f"]).collect()}
    assert moved[1, 4] > 0.4 and moved[1, 0] < 0.0 and all(abs(moved[2, i] - 0.1 * i) < 1e-12 for i in range(5))


def test_cohorts_must_not_overlap(spark):
    a, b = spark.range(5).toDF("user"), spark.range(4, 8).toDF("user")
    with pytest.raises(Exception, match="overlap"):
        K.cohort_union(a, b).collect()
    assert K.cohort_union(a, b.where("user > 4")).count() == 8


def test_publish_writes_only_what_passes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "user long, split string")
    with pytest.raises(ValueError):
        publish(df, f"file://{tmp_path}/x", "split", {"user": F.col("user") > 1})
    with pytest.raises(ValueError):
        publish(df, f"file://{tmp_path}/x", "split", {"user": F.col("user") > 0}, disjoint="user")
    assert not (tmp_path / "x").exists()
    assert spark.read.parquet(publish(df, f"file://{tmp_path}/y", "split", {"user": F.col("user") > 0})).count() == 3


def test_odd_playlists_and_states(spark):
    files = spark.createDataFrame([(1, ""), (2, None), (3, "Abba - Waterloo\r\n\r\nno separator\r\n"), (4, 'title;artist\n"a;b";"say ""x"""\n'), (5, "[not json"), (6, '{"tracks": [{"title": "T", "artist": "A", "id": "x"}]}')], "file_id long, text string")
    got = [(r.file_id, r.pos, r.artist, r.title, r.track) for r in P.playlists(files).orderBy("file_id").collect()]
    assert got == [(3, 0, "Abba", "Waterloo", None), (4, 0, 'say "x"', "a;b", None), (6, 0, "A", "T", None)]
    deep = '{"a":' * 9 + '{"title":"T","artists":["A"]}' + "}" * 9
    states = spark.createDataFrame([(1, deep), (2, '{"x":[{"title":" T ","artists":[{"name":"A"},"B"]}]}'), (3, "no json"), (4, None)], "page_id long, state string")
    assert [tuple(r) for r in P.nested_tracks(states).collect()] == [(2, 0, "A, B", "T")]
