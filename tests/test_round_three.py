"""Title rules, nested songs, blocked similarity, session vectors, co-listening and the personal layer."""

import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import embeddings as E
from larkspur.operators import ranking as R
from larkspur.operators import scoring as S
from larkspur.operators import vectors as V
from larkspur.sources import html, playlists


def _title(words, labels):
    """Whether words are a label but for a year on either side."""
    w = words.split(" ")
    w = w[1:] if re.fullmatch(r"\d{4}", w[0]) else w
    w = w[:-1] if w and re.fullmatch(r"\d{4}", w[-1]) else w
    return " ".join(w) in labels


def test_version_rules_of_titles(spark):
    cases = {  # title: (remaster key, family, versionless)
        "Song": ("song", "song", "song"),
        "Song (2011 Remaster)": ("song", "song", "song"),
        "Song [Remastered 2009]": ("song", "song", "song"),
        "Song - 2011 Remaster": ("song", "song", "song"),
        "Song - Remastered": ("song", "song", "song"),
        "Song (Live)": ("song (live)", "song", "song"),
        "Song (Live) Part 2": ("song (live) part 2", "song (live) part 2", "song part 2"),
        "Song(Live)Part": ("song(live)part", "song(live)part", "songpart"),
        "Song (Alive)": ("song (alive)", "song", "song (alive)"),
        "Song (Live at Home)": ("song (live at home)", "song", "song (live at home)"),
        "Song - Live at Home - 1999": ("song - live at home - 1999", "song", "song - live at home - 1999"),
        "Song - 1999 Version X": ("song - 1999 version x", "song", "song - 1999 version x"),
        "Song - A - Radio Edit": ("song - a - radio edit", "song - a - radio edit", "song - a"),
        "Song—Radio  Edit": ("song-radio edit", "song-radio edit", "song"),
        "Song (Radio Edit)": ("song (radio edit)", "song", "song"),
        "Song ( Live )": ("song ( live )", "song", "song ( live )"),
        "Song (2011)": ("song (2011)", "song (2011)", "song (2011)"),
        "Cover Me": ("cover me", "cover me", "cover me"),
        "Song (feat. Guest)": ("song (feat. guest)", "song (feat. guest)", "song (feat. guest)"),
        "Song (b (remaster)": ("song (b", "song", "song (b"),
        "Re-Live": ("re-live", "re-live", "re"),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.remaster_key(F.col("t")), T.family_title(F.col("t")), T.versionless(F.col("t")))
    got = {r[0]: tuple(r[1:]) for r in df.collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {}
    key = spark.createDataFrame([("“A’s”  —  B − c",)], "t string").select(T.match_key(F.col("t"))).head()[0]
    assert key == "“a's” - b − c"  # double quotes and the minus sign stay


def test_lines_split_without_blanks(spark):
    cases = {
        "A-B": ("A", "B"), "A:B": ("A", "B"), "A – B": ("A", "B"), "12. A - B - C": ("A", "B - C"), "[3] A: B": ("A", "B"), "7 — A — B": ("A", "B"), "* A - B": ("A", "B"),
        "Hurt by Cash": ("Cash", "Hurt"), "Ｂｊörk  -  Jóga ": ("Björk", "Jóga"), "plain": None, "- x": None, "x -": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", T.artist_title(F.col("l")).alias("p"))
    assert {r.l: (r.p.artist, r.p.title) if r.p else None for r in df.collect()} == cases


def test_playlists_of_any_json_shape(spark):
    track = "4uLU6hMCjMI75M1A2tKUQC"
    shapes = {
        1: {"name": "Mix", "tracks": {"items": [{"track": {"name": "Roads", "artists": [{"name": "P"}], "id": track}}, {"track": {"name": "T", "artists": ["M"]}}]}},
        2: [{"Spotify Track Id": track, "Track Name": "Never", "Artist Name(s)": "Rick"}],
        3: {"data": [{"attributes": {"artistName": "A", "name": "B"}}]},
        4: {"songs": ["A - B", "no line", 5, {"artist": {"#text": "X"}, "name": "Y", "spotify_url": f"https://open.example/track/{track}?si=1"}]},
        5: {"some": {"deep": [{"author": {"name": "Q"}, "song": "R"}]}, "other": [1, 2]},
        6: {"recenttracks": {"track": [{"artist": {"name": "L"}, "name": "F"}]}},
        7: [{"master_metadata_album_artist_name": "Rare", "master_metadata_track_name": "Cut", "spotify_track_uri": f"spotify:track:{track}"}, {"episode_name": "Podcast"}],
        8: {"nothing": {"here": 3}},
    }
    files = [(k, json.dumps(v)) for k, v in shapes.items()] + [(9, "{broken"), (10, 'Track Name,Artist\n"Two\nlines, ""q""",Z\nW,V'), (11, 'title,artist\n"open,Z\nW,V'), (12, None), (13, "")]
    got = {}
    for r in playlists.playlists(spark.createDataFrame(files, "file_id long, text string")).collect():
        got.setdefault(r.file_id, []).append((r.pos, r.artist, r.title, r.track))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, "P", "Roads", track), (1, "M", "T", None)], 2: [(0, "Rick", "Never", track)], 3: [(0, "A", "B", None)], 4: [(0, "A", "B", None), (3, "X", "Y", track)], 5: [(0, "Q", "R", None)],
        6: [(0, "L", "F", None)], 7: [(0, "Rare", "Cut", track)], 11: [(0, "Z", "open", None), (1, "V", "W", None)], 10: [(0, "Z", 'Two\nlines, "q"', None), (1, "V", "W", None)],
    }


def test_nested_songs_and_structured_data(spark):
    deep = {"title": "t", "artists": ["a"]}
    for _ in range(9):
        deep = {"x": deep}
    states = spark.createDataFrame([(1, json.dumps([{"title": " A ", "artists": [{"name": "x"}, "y"], "more": {"title": "inner", "artists": ["z"]}}, {"title": "", "artists": ["q"]}, {"title": "B", "artists": ["r"]}])), (2, json.dumps(deep)), (3, "oops"), (4, None)], "page_id long, state string")
    assert sorted((r.page_id, r.pos, r.artist, r.title) for r in playlists.nested_tracks(states).collect()) == [(1, 0, "x, y", "A"), (1, 1, "r", "B")]
    assert playlists.nested_tracks(states, 10).where("page_id = 2").count() == 1
    ld = {"@graph": [{"@type": "MusicAlbum", "byArtist": {"name": "P"}, "track": [{"name": "One"}, {"name": "Two", "byArtist": [{"name": "G"}, {"name": "H"}]}, {"name": ""}]}, {"@type": "ItemList", "itemListElement": [{"item": {"name": "Three"}}]}, {"@type": "Person", "track": [{"name": "No"}]}]}
    pages = spark.createDataFrame([(1, f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">{{bad</script>'), (2, None)], "page_id long, html string")
    assert sorted((r.pos, r.name, r.artist or "") for r in html.json_ld(pages).collect()) == [(0, "One", "P"), (0, "Three", ""), (1, "Two", "G H")]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_by_broadcast_and_by_grid(spark, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "ITEM_BLOCK", 60)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (300, 5)), 1) * rng.choice([0.1, 1, 3], (300, 1))
    x[40:60] = x[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    got = {}
    for r in V.nearest(df, df.where("id % 10 = 0"), 12).collect():
        got.setdefault(r.query, {})[r.rank] = (r.item, r.score)
    for q in range(0, 300, 10):
        s = np.round(x @ x[q], 9)
        best = sorted(range(300), key=lambda i: (-s[i], i))[:12]
        assert [got[q][k + 1] for k in range(12)] == [(i, s[i]) for i in best]


def test_products_meet_every_query_once(spark, monkeypatch):
    monkeypatch.setattr(V, "PRODUCT_BLOCK", 4)
    df = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    got = V.products(df, df.where("id % 5 = 0")).select("id", "q.id").collect()
    assert len(got) == len(set(got)) == 500


def test_factored_matrix_and_session_vectors(spark):
    rng = random.Random(1)
    rows = [(c, k, rng.randrange(12) + 12 * (c % 4)) for c in range(400) for k in range(8)]  # four groups of items that meet
    x = spark.createDataFrame(rows, "ctx long, pos long, item long")
    from larkspur.operators.matching import token_shuffle
    from larkspur.operators.sessions import window_pairs

    m = E.ppmi(window_pairs(x))
    dense = np.zeros((48, 48))
    for r in m.collect():
        dense[r.a, r.b] = r.value
    assert np.allclose(dense, dense.T)
    vec, value = E.factored(m, dims=4)
    true = np.linalg.eigvalsh(dense)
    assert np.allclose(np.abs(value), np.sort(np.abs(true))[::-1][:4], rtol=1e-3)
    v = {r.id: np.array(r.vec) for r in vec.collect()}
    unit = {k: a / np.linalg.norm(a) for k, a in v.items()}
    same = np.mean([unit[a] @ unit[b] for a, b in itertools.combinations(range(48), 2) if a // 12 == b // 12])
    other = np.mean([unit[a] @ unit[b] for a, b in itertools.combinations(range(48), 2) if a // 12 != b // 12])
    assert same > 0.8 > 0.3 > other
    seeds = spark.createDataFrame([(q, 12 * q + k) for q in range(4) for k in range(6)], "query long, item long")
    targets = spark.createDataFrame([(q, 12 * q + k) for q in range(4) for k in range(6, 12)], "query long, item long")
    recall = lambda s: np.mean([r.recall for r in E.retrieval(s, seeds, targets, 6, 4).collect()])
    assert recall(x) > 0.9 and recall(token_shuffle(x)) < 0.5


def test_co_listening_marks_more_seeds_than_a_number_holds(spark):
    rng = random.Random(2)
    know = {(u, i) for u in range(30) for i in rng.sample(range(200), 90)}
    seeds = [(900, i) for i in range(150)] + [(901, i) for i in range(5)]
    got = {(r.query, r.item): (r.score, r.support) for r in R.co_listen(spark.createDataFrame(seeds, "query long, item long"), spark.createDataFrame(sorted(know), "user long, item long")).collect()}
    owners = {i: sum((u, i) in know for u in range(30)) for i in range(200)}
    for q, i in got:
        own = {s for p, s in seeds if p == q}
        hits = [(u, s) for u in range(30) if (u, i) in know for s in own if (u, s) in know]
        assert got[q, i][1] == len({s for _, s in hits}) and abs(got[q, i][0] - sum(owners[s] ** -0.5 for _, s in hits)) < 1e-9


def _ratings(n=40):
    return [(1, i, i, i // 5, float(i % 2), 0.0, float(i % 2), float(i % 3)) for i in range(n)]


RATING = "query long, id long, sequence long, exposure long, label double, score double, f1 double, f2 double"


def test_ratings_are_split_by_time_and_whole_exposures(spark):
    parts = {r.id: r.part for r in S.temporal_ratings(spark.createDataFrame(_ratings(), RATING)).collect()}
    assert sorted(k for k, v in parts.items() if v == "train") == list(range(30)) and sorted(k for k, v in parts.items() if v == "validation") == list(range(32, 40))
    late = [(*r[:2], 100, *r[3:]) if r[1] == 0 else r for r in _ratings()]  # a correction that comes late
    rows = S.temporal_ratings(spark.createDataFrame(late, RATING)).collect()
    assert max(r.sequence for r in rows if r.part == "train") < min(r.sequence for r in rows if r.part == "validation")
    few = [_ratings(19), [(*r[:4], float(r[1] < 4), *r[5:]) for r in _ratings()], [(*r[:3], 0, *r[4:]) for r in _ratings()]]
    assert all(S.temporal_ratings(spark.createDataFrame(rows, RATING)).isEmpty() for rows in few)


def test_personal_fit_is_the_minimum_and_learns(spark):
    rows = _ratings() + [(2, *r[1:4], 1 - r[4], *r[5:]) if r[1] >= 30 else (2, *r[1:]) for r in _ratings()]  # 2 changes its mind
    df = spark.createDataFrame(rows, RATING)
    spread = spark.createDataFrame([(1, 1.0), (2, 1.0)], "query long, spread double")
    m = {r["query"]: r for r in S.personal_models(df, spread, ["f1", "f2"]).collect()}
    assert m[1].accepted and not m[2].accepted and m[1].train == 30 and m[1].validation == 8 and m[1].loss < m[1].base_loss
    x = np.array([r[6:8] for r in _ratings()[:30]])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0, ddof=1), 0.05), -5, 5)
    z, y, t = np.c_[z, np.ones(30)], np.arange(30) % 2, np.array(m[1].theta)
    slope = z.T @ (1 / (1 + np.exp(-z @ t)) - y) / 30 + 0.1 * np.append(t[:2], 0)
    assert np.abs(slope).max() < 1e-8
    items = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0), (1, 8, 0.0, 1.0, 1.0), (2, 7, 0.5, 0.0, 1.0)], "query long, item long, score double, f1 double, f2 double")
    out = {(r.query, r.item): r.score for r in S.personal_layer(df, items, ["f1", "f2"]).collect()}
    assert out[1, 8] > 0 > out[1, 7] and out[2, 7] == 0.5
