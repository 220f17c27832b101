"""Raw listens from JSON lines (plain or gzip): nothing is fatal, rejected rows are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit_fraction
from ..operators.clean import identify

SCHEMA = """user_name string, user_id string, listened_at long, timestamp long, recording_msid string,
track_metadata struct<artist_name: string, track_name: string, additional_info: struct<recording_mbid: string, recording_msid: string>, mbid_mapping: struct<recording_mbid: string>>, _corrupt string"""


def scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of SCHEMA; a malformed line has only _corrupt."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def strict(raw: DataFrame) -> DataFrame:
    """user, ts, artist, title, identity and valid: a row needs a user, a positive time, names, and no malformed id."""
    m = F.col("track_metadata")
    mbid = F.coalesce(F.nullif(m["additional_info"]["recording_mbid"], F.lit("")), m["mbid_mapping"]["recording_mbid"])
    r = raw.select(
        F.trim("user_name").alias("user"), F.coalesce("listened_at", "timestamp").alias("ts"), F.trim(m["artist_name"]).alias("artist"), F.trim(m["track_name"]).alias("title"), mbid.alias("mbid"), F.col("_corrupt").isNotNull().alias("corrupt")
    )
    named = (F.col("artist") != "") & (F.col("title") != "") & (F.col("user") != "") & (F.col("ts") > 0)
    return identify(r).withColumn("valid", F.coalesce(named & ~F.col("rejected") & ~F.col("corrupt"), F.lit(False))).drop("rejected")


def lenient(raw: DataFrame) -> DataFrame:
    """user, ts (0 where missing), artist, title, mbid ('' where missing)."""
    m = F.col("track_metadata")
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    return raw.where("track_metadata IS NOT NULL").select(
        some(F.col("user_name"), F.col("user_id")).alias("user"), F.coalesce("listened_at", "timestamp", F.lit(0)).alias("ts"), m["artist_name"].alias("artist"), m["track_name"].alias("title"),
        some(m["additional_info"]["recording_mbid"], m["additional_info"]["recording_msid"]).alias("mbid"),
    )


def counts(listens: DataFrame) -> DataFrame:
    return listens.agg(F.count("*").alias("parsed"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"))


def radio_plays(plays: DataFrame) -> DataFrame:
    """Plays (show, play_type, artist, song, airdate) of tracks as listens of the show."""
    ok = (F.col("play_type") == "trackplay") & (F.coalesce("artist", F.lit("")) != "") & (F.coalesce("song", F.lit("")) != "")
    return plays.where(ok).select(F.concat(F.lit("show-"), F.col("show").cast("string")).alias("user"), F.col("airdate").alias("ts"), "artist", F.col("song").alias("title"), F.lit("").alias("mbid"))


def user_sample(listens: DataFrame, fraction: float) -> DataFrame:
    """All listens of a stable fraction of the users."""
    return listens.where(unit_fraction(F.col("user")) < fraction)


def library(rows: DataFrame) -> DataFrame:
    """(artist, title), distinct, from exported libraries with any of the usual column names; the artist up to ';'."""
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in rows.columns], F.lit(None).cast("string"))
    artist = F.trim(F.split(pick(["Artist Name(s)", "artist", "artist_name"]), ";")[0])
    title = F.trim(pick(["Track Name", "name", "title", "track_name"]))
    return rows.select(artist.alias("artist"), title.alias("title")).where("artist <> '' AND title <> ''").distinct()


PROFILE = "key string, payload struct<recordings: array<struct<recording: long>>>"


def profiles(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user, recording) of cached profiles (PROFILE) whose key is that of a wanted user. wanted: user, key (the hash of the user)."""
    return cache.join(wanted, "key").select("user", F.explode("payload.recordings").alias("r")).select("user", "r.recording")
