"""Scans of raw files. The files (JSON lines, playlists, pages, profiles, bundles) are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import clean as C
from ..sources import html, listens, playlists
from ..sources.staging import cut, folder
from ..sources.tables import INTERACTIONS, LISTENS, catalog, interactions, table, vectors
from ..sources.tables import listens as events
from .base import query

X, E = "WITH " + INTERACTIONS, "WITH " + LISTENS

RAW = """, raw AS (SELECT event_id, CASE WHEN event_id % 40 = 1 THEN '' ELSE 'user-' || "user" END AS name, "user", CASE WHEN event_id % 45 = 2 THEN NULL ELSE ts END AS ts, 'Artist ' || (coalesce(item, 0) % 25) AS artist, 'Track ' || coalesce(item, 0) AS title,
CASE event_id % 3 WHEN 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE '' END END AS mbid, event_id % 50 = 0 AS corrupt
FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM e))"""


def _raw(s, d):
    """Events as compressed JSON lines: some without user or time, some with a malformed id, some cut short."""
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    i, item = F.col("event_id"), F.coalesce("item", F.lit(0))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    mbid = F.when(i % 3 == 0, uuid).when(i % 3 == 1, F.when(i % 7 == 0, "broken").otherwise(""))
    row = F.struct(
        F.when(i % 40 == 1, "").otherwise(F.concat(F.lit("user-"), F.col("user").cast("string"))).alias("user_name"), F.col("user").cast("string").alias("user_id"), F.when(i % 45 != 2, F.col("ts")).alias("listened_at"),
        F.struct(F.concat(F.lit("Artist "), (item % 25).cast("string")).alias("artist_name"), F.concat(F.lit("Track "), item.cast("string")).alias("track_name"), F.struct(mbid.alias("recording_mbid"), F.concat(F.lit("m"), i.cast("string")).alias("recording_msid")).alias("additional_info")).alias("track_metadata"),
    )
    at = folder(s, "raw-listens")
    events(s, d).select(F.when(i % 50 == 0, '{"user_name": "cut').otherwise(F.to_json(row)).alias("value")).write.option("compression", "gzip").text(at)
    return listens.scan(s, at)


query(
    "s1_strict_listens",
    E + RAW + """, v AS (SELECT *, CASE WHEN coalesce(mbid, '') = '' THEN 'fallback:' || sha256(artist || chr(31) || title) WHEN mbid <> 'broken' THEN 'mbid:' || mbid END AS identity FROM raw)
    SELECT CASE WHEN NOT corrupt THEN name END AS "user", CASE WHEN NOT corrupt THEN ts END AS ts, CASE WHEN NOT corrupt THEN artist END AS artist, CASE WHEN NOT corrupt THEN title END AS title, CASE WHEN NOT corrupt THEN identity END AS identity,
    NOT corrupt AND name <> '' AND ts IS NOT NULL AND identity IS NOT NULL AS valid FROM v""",
)(lambda s, d: listens.strict(_raw(s, d)).select("user", "ts", "artist", "title", "identity", "valid"))

query("s1_reject_counts", E + RAW + " SELECT count(*) AS parsed, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected FROM (SELECT NOT corrupt AND name <> '' AND ts IS NOT NULL AND coalesce(mbid, '') <> 'broken' AS ok FROM raw)")(
    lambda s, d: listens.counts(listens.strict(_raw(s, d)))
)

query("s2_lenient_listens", E + RAW + """ SELECT CASE WHEN name = '' THEN CAST("user" AS VARCHAR) ELSE name END AS "user", coalesce(ts, 0) AS ts, artist, title, CASE WHEN coalesce(mbid, '') = '' THEN 'm' || event_id ELSE mbid END AS mbid FROM raw WHERE NOT corrupt""")(
    lambda s, d: listens.lenient(_raw(s, d))
)

query(
    "s3_radio_plays",
    E + """ SELECT 'show-' || ("user" % 7) AS "user", ts, 'Artist ' || (item % 25) AS artist, 'Track ' || item AS title, '' AS mbid FROM e WHERE action <> 'view' AND item IS NOT NULL AND item % 11 <> 0""",
)(
    lambda s, d: listens.radio_plays(
        events(s, d).select(
            (F.col("user") % 7).alias("show"), F.when(F.col("action") == "view", "airbreak").otherwise("trackplay").alias("play_type"),
            F.when(F.col("item") % 11 != 0, F.concat(F.lit("Artist "), (F.col("item") % 25).cast("string"))).alias("artist"), F.concat(F.lit("Track "), F.col("item").cast("string")).alias("song"), F.col("ts").alias("airdate"),
        )
    )
)

query("s6_library", "SELECT DISTINCT p_brand AS artist, p_name AS title FROM part WHERE p_partkey % 13 <> 0")(lambda s, d: _library(s, d))


def _library(s, d):
    at = folder(s, "library")
    c = catalog(s, d).select(F.concat(F.col("artist"), F.lit(";Guest")).alias("Artist Name(s)"), F.when(F.col("item") % 13 != 0, F.col("title")).alias("Track Name"))
    c.write.option("header", True).option("quoteAll", True).csv(at)
    return listens.library(s.read.option("header", True).csv(at))


def _album_pages(s, d):
    """A page for each artist, with its parts as the tracks of an album; every third track names its own artist."""
    own = F.when(F.col("item") % 3 == 0, F.struct(F.concat(F.lit("Guest "), F.col("item").cast("string")).alias("name")))
    track = F.struct("item", F.col("title").alias("name"), own.alias("byArtist"))
    pages = catalog(s, d).groupBy("artist").agg(F.array_sort(F.collect_list(track)).alias("track"), F.min("item").alias("page_id"))
    album = F.to_json(F.struct(F.lit("MusicAlbum").alias("@type"), F.lit("Album").alias("name"), F.struct(F.col("artist").alias("name")).alias("byArtist"), F.transform("track", lambda t: F.struct(t["name"].alias("name"), t["byArtist"].alias("byArtist"))).alias("track")))
    return pages.select("page_id", F.concat(F.lit('<html><script type="application/ld+json">'), album, F.lit("</script><p>text</p></html>")).alias("html"))


query("s8_json_ld", "SELECT min(p_partkey) OVER w AS page_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Guest ' || p_partkey ELSE p_brand END AS artist FROM part WINDOW w AS (PARTITION BY p_brand)")(
    lambda s, d: html.json_ld(_album_pages(s, d))
)


def _state_pages(s, d):
    """A page for each artist: half of its parts in a script's state, some levels down, the others in a pushed string."""
    song = F.struct(F.col("title").alias("title"), F.array(F.struct(F.col("artist").alias("name"))).alias("artists"), "item")
    g = catalog(s, d).groupBy("artist").agg(F.min("item").alias("page_id"), *[F.array_sort(F.collect_list(F.when(F.col("item") % 2 == k, F.struct("item", song.alias("song"))))).alias(f"l{k}") for k in (0, 1)])
    state = lambda c: F.to_json(F.struct(F.struct(F.struct(F.transform(c, lambda x: x["song"]).alias("items")).alias("list")).alias("data")))
    quoted = F.regexp_extract(F.to_json(F.struct(state(F.col("l1")).alias("v"))), r'^\{"v":(.*)\}$', 1)
    return g.select("page_id", F.concat(F.lit("<script>"), state(F.col("l0")), F.lit("</script><script>self.q.push([1, "), quoted, F.lit("])</script>")).alias("html"))


query("s9_nested_tracks", "SELECT min(p_partkey) OVER (PARTITION BY p_brand) AS page_id, p_brand AS artist, p_name AS title FROM part")(
    lambda s, d: playlists.nested_tracks(playlists.page_states(_state_pages(s, d))).select("page_id", "artist", "title")
)

_PLACE = "CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER)"
query(
    "s5_playlists",
    f"""WITH f AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS file_id, {_PLACE} AS pos, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 22) AS link FROM part)
    SELECT file_id, pos, p_brand AS artist, CASE WHEN file_id % 6 = 1 THEN p_name || ', "live"' || chr(10) || 'mix' ELSE p_name END AS title,
      CASE WHEN file_id % 6 = 0 AND pos_shape < 3 OR file_id % 6 IN (1, 2) THEN link END AS track FROM (SELECT *, file_id // 6 % 4 AS pos_shape FROM f)""",
)(lambda s, d: playlists.playlists(_files(s, d)))


def _files(s, d):
    """A file for each artist: JSON of four shapes, CSV with quoted fields and line breaks in them, TSV, M3U, PLS or numbered
    lines."""
    link = F.substring(H.sha(F.col("item")), 1, 22)
    row = F.struct("item", "title", link.alias("link"))
    g = catalog(s, d).groupBy("artist").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("item").alias("file_id"))
    a = F.col("artist")
    each = lambda f: F.array_join(F.transform("rows", f), "\n")
    js = F.to_json(F.transform("rows", lambda r: F.struct(r["title"].alias("name"), F.array(F.struct(a.alias("name"))).alias("artists"), F.concat(F.lit("app:track:"), r["link"]).alias("uri"))))
    wrapped = F.to_json(F.struct(F.lit("Mix").alias("name"), F.struct(F.transform("rows", lambda r: F.struct(F.struct(r["title"].alias("name"), F.array(a).alias("artists"), r["link"].alias("id")).alias("track"))).alias("items")).alias("tracks")))
    attributes = F.to_json(F.struct(F.transform("rows", lambda r: F.struct(F.struct(r["title"].alias("name"), a.alias("artistName"), F.concat(F.lit("app:track:"), r["link"]).alias("uri")).alias("attributes"))).alias("data")))
    texts = F.to_json(F.struct(F.transform("rows", lambda r: F.concat(a, F.lit(" - "), r["title"])).alias("songs")))
    shape = F.floor(F.col("file_id") / 6) % 4
    js = F.when(shape == 0, js).when(shape == 1, wrapped).when(shape == 2, attributes).otherwise(texts)
    csv = F.concat(F.lit("Track Name,Artist Name(s),Track URI\r\n"), each(lambda r: F.concat(F.lit('"'), r["title"], F.lit(', ""live""\nmix",'), a, F.lit(",https://music.example/track/"), r["link"], F.lit("?x=1\r"))))
    tsv = F.concat(F.lit("artist\ttitle\turl\n"), each(lambda r: F.concat_ws("\t", a, r["title"], F.concat(F.lit("app:track:"), r["link"]))))
    m3u = F.concat(F.lit("#EXTM3U\n"), each(lambda r: F.concat(F.lit("#EXTINF:180,"), a, F.lit(" - "), r["title"], F.lit("\nmusic/"), r["link"], F.lit(".mp3"))))
    pls = F.concat(F.lit("[playlist]\n"), F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("File"), (i + 1).cast("string"), F.lit("=x.mp3\nTitle"), (i + 1).cast("string"), F.lit("="), a, F.lit(" - "), r["title"])), "\n"))
    plain = F.array_join(F.transform("rows", lambda r, i: F.concat((i % 900 + 1).cast("string"), F.lit(". "), a, F.lit(" - "), r["title"])), "\n")
    m = F.col("file_id") % 6
    text = F.when(m == 0, js).when(m == 1, csv).when(m == 2, tsv).when(m == 3, m3u).when(m == 4, pls).otherwise(plain)
    return g.select("file_id", text.alias("text"))


query(
    "s11_acoustic",
    """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT id, CASE WHEN id % 7 <> 3 THEN round(list_sum(v[1:13]) + list_sum(list_transform(v[1:13], lambda x: abs(x))) + list_sum(v[14:26]) + list_sum(list_transform(v[14:26], lambda x: abs(x)))
      + list_sum(list_transform(v[27:31], lambda x: ln(1 + abs(x)))) + list_sum(list_transform(v[32:36], lambda x: ln(1 + abs(x)))) + list_sum(list_transform(v[37:39], lambda x: ln(1 + abs(x)))), 5) END AS total FROM v""",
)(lambda s, d: playlists.acoustic_vector(_acoustic(s, d)).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total")))


def _acoustic(s, d):
    v = F.col("vec").cast("array<double>")
    diagonal = lambda part: F.transform(part, lambda x, i: F.transform(part, lambda y, j: F.when(i == j, x * x).otherwise(0.0)))
    cepstrum = lambda k: F.struct(F.slice(v, k, 13).alias("mean"), diagonal(F.slice(v, k, 13)).alias("cov"))
    spectral = [F.struct(F.abs(v[26 + i]).alias("mean"), (v[31 + i] * v[31 + i]).alias("var")).alias(f"spectral_{n}") for i, n in enumerate(("centroid", "energy", "flux", "rolloff", "spread"))]
    rhythm = F.struct(*[F.abs(v[36 + i]).alias(n) for i, n in enumerate(("bpm", "onset_rate", "danceability"))])
    return vectors(s, d).select("id", F.to_json(F.struct(F.struct(cepstrum(1).alias("mfcc"), cepstrum(14).alias("gfcc"), *spectral).alias("lowlevel"), F.when(F.col("id") % 7 != 3, rhythm).alias("rhythm"))).alias("doc"))


query(
    "s12_profiles",
    X + """, u AS (SELECT DISTINCT "user" FROM x WHERE "user" % 50 = 0) SELECT DISTINCT x."user", item FROM x JOIN u ON x."user" = u."user" WHERE x."user" % 100 = 0""",
)(lambda s, d: _profiles(s, d))


def _profiles(s, d):
    """Cached profiles, one JSON file line a user under the hash of its id, found again by the hashes of the wanted users."""
    at = folder(s, "profiles")
    x = interactions(s, d).where("user % 50 = 0").select("user", "item").distinct()
    cache = x.groupBy("user").agg(F.collect_list(F.struct(F.col("item").alias("recording"))).alias("recordings"))
    cache.select(F.to_json(F.struct(H.sha(F.col("user")).alias("key"), F.struct("recordings").alias("payload"))).alias("value")).write.text(at)
    wanted = interactions(s, d).where("user % 100 = 0").select("user").distinct().select("user", H.sha(F.col("user")).alias("key"))
    return listens.profiles(s.read.schema(listens.PROFILE).json(at), wanted).select("user", F.col("recording").alias("item"))


query(
    "s13_published",
    X + """, u AS (SELECT DISTINCT "user", CAST('0x' || substr(sha256(sha256(CAST("user" AS VARCHAR))), 1, 8) AS UBIGINT) % 100 AS b FROM x), p AS (SELECT x.*, CASE WHEN b < 75 THEN 'train' WHEN b < 85 THEN 'validation' WHEN b < 95 THEN 'test' ELSE 'audit' END AS split FROM x JOIN u ON x."user" = u."user")
    SELECT split, count(*) AS plays, count(DISTINCT ctx) AS contexts, count(DISTINCT "user") AS users FROM p GROUP BY split""",
)(lambda s, d: _published(s, d))


def _published(s, d):
    from ..sources.sinks import publish

    x = interactions(s, d).withColumn("split", H.split_75_10_10_5(F.col("user").cast("string")))
    at = publish(x.select("split", "user", "ctx", "item"), folder(s, "sessions"), "split", {"user": F.col("user").isNotNull(), "item": F.col("item").isNotNull()}, disjoint="user")
    return s.read.parquet(at).groupBy("split").agg(F.count("*").alias("plays"), F.count_distinct("ctx").alias("contexts"), F.count_distinct("user").alias("users"))


query(
    "s14_bundle",
    """WITH p AS (SELECT 'catalog' AS part, count(*) AS n FROM part UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'neighbours', count(*) FROM (SELECT q.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY i.vec_id) AS k FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id) WHERE k <= 10)
    SELECT 'as written' AS state, part, n, true AS hashed, true AS within_budget FROM p UNION ALL SELECT 'changed', part, CASE WHEN part = 'catalog' THEN n - 1 ELSE n END, part <> 'catalog', false FROM p""",
)(lambda s, d: _bundle(s, d))


def _bundle(s, d):
    from ..functions.vector import quantize
    from ..operators.vectors import nearest
    from ..sources.sinks import bundle, checked_bundle

    v = vectors(s, d)
    near = nearest(v, v.where("id % 100 = 0"), 11).where("query <> item").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("k <= 10").select("query", "item", "k")
    at = folder(s, "bundle")
    manifest = cut(bundle({"catalog": catalog(s, d), "vectors": v.select("id", quantize(F.col("vec")).alias("vec")), "neighbours": near}, at), "manifest")
    whole = cut(checked_bundle(s, at, manifest, 1 << 40).withColumn("state", F.lit("as written")), "whole")
    catalog(s, d).where("item <> 1").write.mode("overwrite").parquet(f"{at}/catalog")  # another catalog, and a budget of a byte
    return whole.unionByName(checked_bundle(s, at, manifest, 1).withColumn("state", F.lit("changed")))


query("p3_valid_similarity", X + """SELECT DISTINCT ctx AS seed, item, CAST(weight AS DOUBLE) AS score FROM x WHERE item % 7 <> 0 AND item % 5 <> 1 AND ctx % 11 <> 0""".replace("SELECT", " SELECT", 1))(
    lambda s, d: C.valid_similarity(
        interactions(s, d).select(F.when(F.col("ctx") % 11 != 0, F.col("ctx")).alias("seed"), "item", F.when(F.col("item") % 7 == 0, float("nan")).when(F.col("item") % 5 == 1, float("inf")).otherwise(F.col("weight").cast("double")).alias("score")).distinct()
    )
)

query(
    "p8_track_url",
    """WITH u AS (SELECT p_partkey AS item, substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 22) AS t FROM part) SELECT item, CASE WHEN item % 5 IN (0, 1, 2) THEN t END AS track FROM u""",
)(lambda s, d: _urls(s, d))


def _urls(s, d):
    t, m = F.substring(H.sha(F.col("item")), 1, 22), F.col("item") % 5
    url = F.when(m == 0, F.concat(F.lit("https://music.example/track/"), t)).when(m == 1, F.concat(F.lit("https://music.example/intl-de/track/"), t, F.lit("?si=1"))).when(m == 2, F.concat(F.lit("https://music.example/track/"), t, F.lit("#top")))
    urls = catalog(s, d).select("item", url.when(m == 3, F.concat(F.lit("http://music.example/track/"), t)).otherwise(F.concat(F.lit("https://elsewhere.example/track/"), t)).alias("url"))
    return C.track_url(urls, "music.example", keep=["item"]).select("item", "track")


query("p11_artist_title", "SELECT p_partkey AS item, p_brand AS artist, p_name AS title FROM part WHERE p_partkey % 5 <> 4")(lambda s, d: _lines(s, d))


def _lines(s, d):
    m, a, t = F.col("item") % 5, F.col("artist"), F.col("title")
    line = F.when(m == 0, F.concat((F.col("item") % 100).cast("string"), F.lit(". "), a, F.lit(" - "), t)).when(m == 1, F.concat(F.lit("• "), a, F.lit(" – "), t)).when(m == 2, F.concat(a, F.lit(": "), t)).when(m == 3, F.concat(t, F.lit(" by "), a)).otherwise(t)
    return catalog(s, d).select("item", T.artist_title(line).alias("p")).where("p IS NOT NULL").select("item", "p.artist", "p.title")
