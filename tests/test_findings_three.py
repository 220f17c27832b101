"""Tests of the faults named in FINDINGS_r03.md."""

from __future__ import annotations

from datetime import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from larkspur.llm import url_rules
from larkspur.operators import scoring as S
from larkspur.operators import vectors as V
from larkspur.sources import playlists


def _ratings(spark, last):
    """Two users of 40 ratings in lists of five; those of the last fifth are ``last`` for user 1, mixed for user 2."""
    rows = []
    for user in (1, 2):
        for k in range(40):
            label = float((k * 7 + k // 5) % 3 == 0) if k < 30 or user == 2 else last
            rows.append((user, k, k, k // 5, label, k % 4 / 4.0, k % 3 / 3.0, k % 5 / 5.0))
    return spark.createDataFrame(rows, "query long, id long, sequence long, exposure long, label double, score double, f1 double, f2 double")


def test_users_without_a_like_beside_a_dislike_are_not_judged(spark):
    """their sum of pairs is 0, by which ANSI mode refuses to divide."""
    for last in (0.0, 1.0):
        ratings = _ratings(spark, last)
        spread = ratings.groupBy("query").agg(F.lit(0.5).alias("spread"))
        assert [r["query"] for r in S.personal_models(ratings, spread, ["f1", "f2"]).collect()] == [2]
        scores = ratings.select("query", F.col("id").alias("item"), "score", "f1", "f2")
        moved = {(r["query"], r.item): r.score for r in S.personal_layer(ratings, scores, ["f1", "f2"]).collect()}
        assert len(moved) == 80
        assert all(moved[1, r.item] == r.score for r in scores.where("query = 1").collect())


def _order_tables(spark, at, lines):
    """lineitem, orders and part with a line (user, order, item) each; an item's brand and name are its own."""
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    write("lineitem", [(o, k, i, 1.0) for k, (_, o, i) in enumerate(lines)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    write("orders", sorted({(o, u, datetime(1995, 1, 1)) for u, o, _ in lines}), "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    write("part", [(i, f"b{i}", f"n{i}") for i in sorted({i for *_, i in lines})], "p_partkey long, p_brand string, p_name string")
    return str(at)


def test_merged_lists_take_contexts_of_any_size_and_users_of_any_library(spark, tmp_path):
    """item 2 is met in an order of a user with two items, 100 to 189 in an order of 91."""
    lines = [(100, 1, 1), (7, 2, 1), (7, 2, 2), (8, 3, 1)] + [(8, 3, i) for i in range(100, 190)]
    found = queries()["j2_merged_lists"](spark, _order_tables(spark, tmp_path, lines)).collect()
    assert sorted((r["query"], r.item, r.support, r.best) for r in found) == [(100, i, 1, k + 1) for k, i in enumerate([2, *range(100, 190)])]


def test_every_item_is_a_seed_of_seed_vectors(spark, tmp_path):
    """items 2 and 4 have vectors, 1 has them for neighbours, 9 has none."""
    lines = [(1, 1, i) for i in (1, 2, 4)] + [(1, 2, i) for i in (21, 23)] + [(2, 3, i) for i in (9, 11, 13, 15, 17)]
    at = _order_tables(spark, tmp_path, lines)
    vecs = [(2, [3.0, 0.0], 0), (4, [0.0, 3.0], 0), (1, [1.0, 1.0], 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    found = {r.item: (r.source, r.top) for r in queries()["j19_seed_vectors"](spark, at).collect()}
    assert len(found) == 10 and found[2] == found[4] == ("direct", 3.0) and found[1] == ("neighbours", 0.70711)
    assert all(found[i] == ("unresolved", -9.0) for i in (9, 11, 13, 15, 17, 21, 23))


def test_calibration_returns_every_setting(spark):
    """on sf0.001 and sf0.1 no setting reaches the floor that was registered, so the query returned no row."""
    found = queries()["r15_calibrated"](spark, "/root/testdata/sf0.001").collect()
    assert len({(r.confidence, r.radius) for r in found}) == len(found) == 6
    for name, floor in (("at_01", 0.01), ("at_35", 0.35), ("at_60", 0.6)):
        fit = sorted((r.size, -r.recall, r.confidence, r.radius) for r in found if r.recall >= floor)
        assert [(r.size, -r.recall, r.confidence, r.radius) for r in found if r[name]] == fit[:1]


def test_evidence_takes_every_twentieth_row_as_seed(spark, tmp_path, monkeypatch):
    """seeds from 2,000 on, and five queries; alike in one block and in a grid of blocks."""
    rng = np.random.default_rng(3)
    ids = [0, 7, 20, 40, 60, 80, 100, 120, 2000, 2020, 2043, 2300]
    x = np.round(rng.normal(size=(len(ids), 3)) / 3, 3).astype(np.float32)
    rows = [(i, v.tolist(), i // 20 % 2) for i, v in zip(ids, x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for block in (4096, 4):
        monkeypatch.setattr(V, "BLOCK", block)
        for name in ("l8_explained", "r10_best_evidence", "r7_heuristic_scores"):
            df = queries()[name](spark, str(tmp_path))
            found = sorted(map(tuple, df.collect()))
            assert {r[0] for r in found} == {0, 1, 2, 3, 4} and len(found) == 5 * len(ids)
            assert found == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_playlist_texts_are_made_once(spark):
    """filters and branches made a file's text again for each mention of it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        made.add(1)
        return "[playlist]\nFile1=x.mp3\nTitle1=A - B" if n else "Track Name,Artist Name(s)\nB,A"

    files = spark.range(2).select(F.col("id").alias("file_id"), text("id").alias("text"))
    assert sorted((r.file_id, r.artist, r.title) for r in playlists.playlists(files).collect()) == [(0, "A", "B"), (1, "A", "B")]
    assert made.value == 2


def test_rules_are_mined_from_all_tokens_of_a_long_url(spark):
    """of 13 frequent tokens the commonest was left out, and with it the rule that decides."""
    rare, common = [f"p:{c}" for c in "abcdefghijkl"], "p:zz"
    rows = [([*rare, common], k < 4) for k in range(10)] + [([common], True)] * 20
    rules = {tuple(r.antecedent): r for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert set(rules) == {(common,)} and rules[common,].support == 24 and rules[common,].confidence == 0.8
    rows = [([*rare, common], True) for _ in range(6)] + [([*rare], False)] * 6
    found = [set(r.antecedent) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()]
    assert len(found) == 2**12 and all(common in r for r in found)
