"""Operators on small tables with known answers, and guarantees that hold for any input."""

import hashlib
import random

from pyspark.sql import functions as F

from larkspur.functions import hashing as H
from larkspur.functions import text as T
from larkspur.operators import graph as G
from larkspur.operators import ranking as R
from larkspur.operators import sessions as S
from larkspur.sources.html import json_ld, tracklists


def test_fnv1a_known_value(spark):
    assert spark.range(1).select(H.fnv1a(F.lit("é"))).first()[0] == 0x1E9DE8C1


def test_splits_equal_hashlib(spark):
    rows = spark.range(200).select("id", H.sha_mod(F.col("id").cast("string"), 100).alias("m"), H.hex_prefix(F.col("id")).alias("p")).collect()
    for r in rows:
        h = hashlib.sha256(str(r.id).encode()).hexdigest()
        assert r.m == int(h, 16) % 100 and r.p == int(h[:8], 16)


def test_text_keys(spark):
    df = spark.createDataFrame([("ＣＡＦÉ  Ｘ", "Straße", "Song (2011 Remaster)", "Song (Live at Home) - Acoustic")], "a string, b string, c string, d string")
    r = df.select(T.text_key(F.col("a")), T.folded_key(F.col("b")), T.remaster_key(F.col("c")), T.family_title(F.col("d")), T.versionless(F.col("c"))).first()
    assert list(r) == ["café x", "strasse", "song", "song (live at home)", "song"]


def test_line_to_artist_and_title(spark):
    df = spark.createDataFrame([("1. Abba - Waterloo",), ("• Blur: Song 2",), ("Hurt by Cash",), ("plain",)], "l string")
    got = [(r[0].artist, r[0].title) if r[0] else None for r in df.select(T.artist_title(F.col("l"))).collect()]
    assert got == [("Abba", "Waterloo"), ("Blur", "Song 2"), ("Cash", "Hurt"), None]


def test_association_numbers(spark):
    inc = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)], "ctx string, item long")
    e = {(r.src, r.dst): r for r in G.association(inc, 3).collect()}
    assert set(e) == {(0, 1), (1, 0)} and e[0, 1].support == 3 and abs(e[0, 1].affinity - 1) < 1e-9


def test_pagerank_mass_is_one(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 1.0)], "src long, dst long, value double")
    seeds = spark.createDataFrame([(7, 0), (7, 1), (8, 3)], "query long, item long")
    for r in G.personalized_pagerank(seeds, edges).groupBy("query").agg(F.sum("score").alias("m")).collect():
        assert abs(r.m - 1) < 1e-9


def test_edge_shuffle_keeps_degrees(spark):
    random.seed(1)
    pairs = {tuple(sorted(random.sample(range(60), 2))) for _ in range(400)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    out = [(r.src, r.dst) for r in G.shuffled_edges(e).collect()]
    deg = lambda es: sorted((n, sum(n in x for x in es)) for n in range(60))
    assert len(set(out)) == len(out) == len(pairs) and deg(out) == deg(pairs) and set(out) != pairs


def test_families_join_through_any_key(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z")], "item long, key string")
    assert {(r.item, r.family) for r in G.families(m).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_sessions_gap_and_cap(spark):
    e = spark.createDataFrame([(i, 1, 1000 + i * 1700, i % 3) for i in range(12)] + [(50, 2, 5, 1), (51, 2, 9000, 1)], "event_id long, user long, ts long, item long")
    assert {(r.user, r.session) for r in S.gap_sessions(e).collect()} == {(1, 0)}
    capped = {(r.user, r.session): r.listens for r in S.capped_sessions(e).collect()}
    assert capped == {(1, 0): 9, (1, 1): 3, (2, 0): 1, (2, 1): 1}


def test_window_pairs_any_partitioning(spark):
    x = spark.createDataFrame([(c, p, (c * 7 + p) % 11) for c in range(20) for p in range(9)], "ctx long, pos long, item long")
    a, b = S.window_pairs(x, 2), S.window_pairs(x.repartition(7, "item"), 2)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lists_keep_their_rules(spark):
    rows = [(1, i, f"a{i % 5}", f"f{i % 17}", i % 3 == 0, i % 4 == 0, float(100 - i)) for i in range(60)]
    s = spark.createDataFrame(rows, "query long, item long, artist string, family string, familiar boolean, popular boolean, score double")
    by = {r[1]: r for r in rows}
    got = [by[r.item] for r in R.no_adjacent_artist(s, 20, 3, familiar=0.3, popular=0.2).orderBy("place").collect()]
    for n in range(1, len(got) + 1):
        assert sum(r[4] for r in got[:n]) <= 0.3 * n and sum(r[5] for r in got[:n]) <= 0.2 * n
    assert all(a[2] != b[2] for a, b in zip(got, got[1:])) and len({r[3] for r in got}) == len(got)


def test_no_known_item_among_negatives(spark):
    from larkspur.operators.sampling import band_negatives

    x = spark.createDataFrame([(u, u, 0, (u // 10 * i + i) % 37) for u in range(0, 400, 10) for i in range(1, 6)], "user long, ctx long, pos long, item long")
    n = band_negatives(x)
    known = x.select(F.col("user").alias("query"), F.col("item").alias("negative")).distinct()
    assert n.count() and n.join(known, ["query", "negative"]).isEmpty()


def test_tracklists_and_json_ld(spark):
    html = "<nav><ul><li>Home page</li><li>About us</li></ul></nav><ol><li>Abba - Waterloo</li><li>Blur - Song 2</li></ol><table><tr><td>one line</td></tr></table>"
    ld = '<script type="application/ld+json">{"@type":"MusicPlaylist","byArtist":{"name":"Abba"},"track":[{"name":"Waterloo"},{"name":"Hurt","byArtist":{"name":"Cash"}}]}</script>'
    pages = spark.createDataFrame([(1, html), (2, ld), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.pos, r.text) for r in tracklists(pages).orderBy("pos").collect()] == [(1, 0, "Abba - Waterloo"), (1, 1, "Blur - Song 2")]
    assert [(r.name, r.artist) for r in json_ld(pages).orderBy("pos").collect()] == [("Waterloo", "Abba"), ("Hurt", "Cash")]
