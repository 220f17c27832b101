"""Findings of round 4 (FINDINGS_r04.md)."""

import random

import duckdb
import numpy as np

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from larkspur.operators import graph as G
from larkspur.operators import matching as M
from larkspur.operators import ranking as R
from larkspur.operators import scoring as S
from larkspur.operators import vectors as V
from larkspur.sources import playlists


def test_a_positive_is_ranked_among_all_unknown_items(spark):
    """ranks were among 99 drawn items, of every hundredth user."""
    rng = random.Random(4)
    score = {i: float(rng.randrange(8)) for i in range(300)}
    known = {q: set(rng.sample(range(300), rng.randrange(1, 60))) for q in (3, 7, 100)}
    rows = [(q, i) for q, own in known.items() for i in own]
    expected = {(q, i): 1 + sum((-score[j], j) < (-score[i], i) for j in score if j not in known[q]) for q, i in rows}
    k = spark.createDataFrame(rows, "query long, item long")
    ranked = S.whole_ranking(k, spark.createDataFrame(list(score.items()), "item long, score double"), k)
    assert {(r["query"], r.item): r["rank"] for r in ranked.collect()} == expected
    m = S.ranking_metrics(ranked).head()
    assert abs(m.hit - sum(r <= 10 for r in expected.values()) / len(rows)) < 1e-12 and abs(m.mrr - sum(1 / r for r in expected.values() if r <= 10) / len(rows)) < 1e-12


def test_a_ranker_is_fitted_without_a_row_a_pair(spark, monkeypatch):
    """candidates met their targets twice in joins, and each pair in interpreted sums. Steps against all pairs in numpy."""
    rng = np.random.default_rng(5)
    rows = [(q, int(i), float(rng.integers(9)), int(rng.integers(4))) for q, n in ((1, 40), (2, 1), (3, 25), (4, 30)) for i in rng.choice(500, n, replace=False)]
    targets = [(q, i) for q, i, *_ in rows if i % 5 == 0 and q != 4] + [(1, 900), (9, 1)]
    monkeypatch.setattr(S, "PAIRS", 50)
    placed = S.placed(spark.createDataFrame(rows, "query long, item long, a double, b long"), spark.createDataFrame(targets, "query long, item long"), ["a", "b"])
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
    x = {}
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        for k in (2, 3):
            for place, r in enumerate(sorted(own, key=lambda r: (-r[k], r[1]))):
                x.setdefault((q, r[1]), []).append(1 - place / max(len(own) - 1, 1))
    wanted = set(targets)
    d = np.array([np.subtract(x[o], x[p]) for p in x if p in wanted for o in x if o[0] == p[0] and o not in wanted])
    theta = np.zeros(2)
    for _ in range(10):
        s = 1 / (1 + np.exp(-d @ theta))
        theta = theta - np.linalg.solve((d * (s * (1 - s))[:, None]).T @ d / len(d) + 1e-4 * np.eye(2), s @ d / len(d) + 1e-4 * theta)
    weights = S.pairwise_ranker(placed, ["a", "b"])
    assert np.allclose(weights, theta, atol=1e-9)
    best = S.best_placed(placed, ["a", "b"], weights, 7).collect()
    for q in {r[0] for r in rows}:
        first = sorted((k for k in x if k[0] == q), key=lambda k: -np.dot(x[k], theta))[:7]
        assert set(first) <= {(r["query"], r.item) for r in best if r["query"] == q} and all(np.allclose(x[r["query"], r.item], (r.a, r.b)) for r in best)


def test_five_methods_are_ranked_where_the_candidates_are(spark, monkeypatch):
    """candidates were dealt anew for each method. Co-listening, listeners and two outer methods against counting."""
    rng = random.Random(8)
    library = {u: set(rng.sample(range(60), rng.randrange(3, 25))) for u in range(100, 160)}
    queries = {u: sorted(library[u]) for u in (100, 101, 102)}
    seeds = {u: set(v[: len(v) * 4 // 5]) for u, v in queries.items()}
    own = {u: v for u, v in library.items() if u not in queries}
    owners = lambda some, i: sum(i in v for v in some.values())
    score, outer = {}, {}
    for u, mine in seeds.items():
        for i in range(60):
            met = [w for w, v in own.items() if i in v and v & mine]
            if met and i not in mine:
                co = sum(1 / np.sqrt(owners(own, j)) for w in met for j in own[w] & mine)
                li = sum(len(v & mine) / np.sqrt(len(v)) for w, v in library.items() if w != u and i in v)
                score[u, i] = {"co": co, "listeners": li}
                if i % 3 == 0:
                    outer[u, i] = float(i % 5)
    table = lambda some: spark.createDataFrame([(u, i) for u, v in some.items() for i in v], "user long, item long")
    monkeypatch.setattr(R, "MARKS", 2)
    monkeypatch.setattr(R, "ITEMS", 3)
    sd = spark.createDataFrame([(u, i) for u, v in seeds.items() for i in v], "query long, item long")
    found = R.co_listen(sd, table(own), sd, (), table({u: library[u] for u in queries}))
    got = {(r["query"], r.item): r for r in found.collect()}
    assert got.keys() == score.keys()
    assert all(abs(got[k].score - v["co"]) < 1e-9 and abs(got[k].listeners - v["listeners"]) < 1e-9 for k, v in score.items())
    more = spark.createDataFrame([(u, i, "outer", x) for (u, i), x in outer.items()] + [(100, 900, "outer", 9.0)], "query long, item long, method string, score double")
    targets = {(u, i) for u, v in queries.items() for i in v if i not in seeds[u]}
    t = spark.createDataFrame(sorted(targets), "query long, item long")
    out = R.recalls(found, more, t, {"co": F.col("score"), "listeners": F.col("listeners")}, ["outer"], 9)
    expected = set()
    for u in queries:
        for name in ("co", "listeners", "outer"):
            value = lambda k: outer.get(k, 0.0) if name == "outer" else round(score[k][name], 6)  # noqa: B023, E731
            best = sorted((k for k in score if k[0] == u), key=lambda k: (-value(k), k[1]))[:9]
            n = len(targets & set(best))
            if n:
                expected.add((name, u, n, sum(k[0] == u for k in targets)))
    assert {tuple(r) for r in out.collect()} == expected and len(expected) > 3


def test_listeners_of_many_meet_queries_in_blocks(spark, monkeypatch):
    """artists, which most users share with a query, made a row for each query, user and artist. Both forms against counting."""
    rng = random.Random(9)
    library = {u: {f"a{i}" for i in rng.sample(range(12), rng.randrange(1, 10))} for u in range(40)}
    seeds = {q: {f"a{i}" for i in rng.sample(range(14), 4)} for q in (0, 7, 90, 91)}
    expected = {}
    for q, mine in seeds.items():
        for i in {i for v in library.values() for i in v}:
            met = [v for u, v in library.items() if u != q and i in v and v & mine]
            if met:
                expected[q, i] = (sum(len(v & mine) / np.sqrt(len(v)) for v in met) / np.sqrt(sum(i in v for v in library.values())), len(met))
    inc = spark.createDataFrame([(u, i) for u, v in library.items() for i in v], "ctx long, item string")
    sd = spark.createDataFrame([(q, i) for q, v in seeds.items() for i in v], "query long, item string")
    for name, few in (("QUERIES", 2), ("USERS", 7), ("CELL", 36), ("LEAST_CELLS", 3), ("ITEMS", 2)):
        monkeypatch.setattr(G, name, few)
    for scores in (G.listener_scores, G.listener_scores_in_blocks):
        found = {(r["query"], r.item): (r.score, r.support) for r in scores(inc, sd).collect()}
        assert found.keys() == expected.keys()
        assert all(abs(found[k][0] - s) < 1e-9 and found[k][1] == n for k, (s, n) in expected.items())
    assert G.listener_scores_in_blocks(inc, sd)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the popularity
    assert G.listener_scores_in_blocks(inc, sd.where("query < 0")).collect() == []


def test_products_with_a_querys_heads_stay_in_their_cell(spark, monkeypatch):
    """each product was a row, made by interpreted sums."""
    rng = np.random.default_rng(6)
    h = [(q, rng.normal(size=5)) for q in (1, 1, 1, 2, 5, 5, 8)]
    x = {i: rng.normal(size=5) for i in range(30)}
    for name, few in (("HEADS", 3), ("HEAD_ITEMS", 4), ("HEAD_CELLS", 2)):
        monkeypatch.setattr(V, name, few)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, vec array<double>")
    heads = spark.createDataFrame([(q, v.tolist()) for q, v in h], "query long, vec array<double>")
    found = {(r["query"], r.item): (r.top, r.mean) for r in V.top_and_mean(items, heads).collect()}
    expected = {(q, i): [w @ v for p, w in h if p == q] for q in (1, 2, 5, 8) for i, v in x.items()}
    assert found.keys() == expected.keys() and all(np.allclose(found[k], (max(v), np.mean(v))) for k, v in expected.items())
    assert V.top_and_mean(items, heads.where("query < 0")).collect() == []


def test_a_catalog_of_small_files_is_not_broadcast(spark):
    """F16: names and catalog went through the driver, and every row of the result was dealt again to be distinct."""
    rng = random.Random(2)
    names = [(r, f"f{rng.randrange(6)}") for r in range(20) for _ in range(rng.randrange(1, 3))]
    catalog = [(i, rng.choice(["f1", "f2", "f3", "f9", None])) for i in range(40) for _ in range(rng.randrange(1, 4))]
    plays = [(u, rng.randrange(25)) for u in range(8) for _ in range(5)]
    out = M.protected_families(spark.createDataFrame(plays, "user long, raw long"), spark.createDataFrame(names, "raw long, family string"), spark.createDataFrame(catalog, "item long, family string"))
    found = [(r.user, r.item) for r in out.collect()]
    expected = {(u, i) for u, r in plays for n, f in names for i, g in catalog if n == r and f == g}
    assert set(found) == expected and len(found) == len(expected)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_record_does_not_go_on_with_all_lines_of_its_file(spark):
    """each row of a table had the file's lines beside it until its header was read."""
    files = spark.createDataFrame([(1, "Title;Artist\nA;B\nC;D"), (2, "#EXTM3U\n#EXTINF:1,X - Y")], "file_id long, text string")
    out = playlists.playlists(files)
    assert sorted((r.file_id, r.pos, r.artist, r.title) for r in out.collect()) == [(1, 0, "B", "A"), (1, 1, "D", "C"), (2, 0, "X", "Y")]
    taken = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate posexplode" in line]
    assert len(taken) == 2 and not any("lines" in line.split("), [", 1)[1] for line in taken)


def test_relevance_makes_no_row_a_pair(spark, tmp_path, monkeypatch):
    """F8: every pair of a row and a seed was a row. In one block and in a grid, against SQL."""
    rng = np.random.default_rng(7)
    rows = [(i, np.round(rng.normal(size=4), 2).astype(np.float32).tolist(), i % 3) for i in [*range(0, 1300, 100), *range(1, 40)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for block in (4096, 7):
        monkeypatch.setattr(V, "BLOCK", block)
        df = queries()["r5_target_relevance"](spark, str(tmp_path))
        assert "explode(_q" not in df._jdf.queryExecution().optimizedPlan().toString()
        found = sorted(map(tuple, df.collect()))
        assert len(found) == len(rows) and found == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()['r5_target_relevance']})").fetchall())


def test_the_weakest_are_left_out_in_blocks(spark, monkeypatch):
    """every pair was a row, and a query's quantile a table of all its products. Against weakest_dropped of all pairs."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "ITEM_BLOCK", 9)
    for n in (6, 10, 61):
        x = {i: np.round(rng.normal(size=3), 1).astype(np.float32) for i in range(n)}
        x[2] = x[3] = np.zeros(3, np.float32)
        v = spark.createDataFrame([(i, w.tolist()) for i, w in x.items()], "id long, vec array<float>")
        out = V.weakest_left_out(v, v.where("id < 5"))
        pairs = [(q, i, float(np.round(x[q].astype(float) @ x[i].astype(float), 9))) for q in range(5) for i in x]
        expected = V.weakest_dropped(spark.createDataFrame(pairs, "query long, item long, sim double")).collect()
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expected)) and len(expected) < 5 * n + (n < 10)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_added_up_once_for_both_directions(spark):
    """F10 to F15, F17 share the step: a union of both directions held the pairs' steps and joins twice."""
    inc = spark.createDataFrame([(c, i) for c in range(3) for i in range(3)], "ctx long, item long")
    edges = G.association(inc)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join Inner") == 2 and "Union" not in plan
    assert {(r.src, r.dst, r.support) for r in edges.collect()} == {(a, b, 3) for a in range(3) for b in range(3) if a != b}
