"""Row rules: identities, rejects, validation, and URL classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..functions.text import UNIT

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def identify(x: DataFrame, artist: str = "artist", title: str = "title", mbid: str = "mbid") -> DataFrame:
    """identity and rejected: a UUID names the recording, a malformed one rejects the row, none falls back to a hash."""
    given = F.nullif(F.trim(F.col(mbid)), F.lit(""))
    fallback = F.concat(F.lit("fallback:"), sha(F.concat(F.col(artist), F.lit(UNIT), F.col(title))))
    return x.withColumn("identity", F.when(given.isNull(), fallback).when(given.rlike(UUID), F.concat(F.lit("mbid:"), F.lower(given)))).withColumn("rejected", F.col("identity").isNull())


def valid_similarity(rows: DataFrame) -> DataFrame:
    """Rows (seed, item, score, ..) with both ids and a finite score; raises where none of some rows is valid."""
    ok = F.col("seed").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok")).select(F.when((F.col("n") > 0) & (F.col("ok") == 0), F.raise_error(F.lit("no valid similarity row"))).alias("e"))
    return rows.where(ok).crossJoin(F.broadcast(counted)).drop("e")  # one row


def reject_report(x: DataFrame) -> DataFrame:
    """(code, n) of rows (artist, title): empty, too long, or ok."""
    code = F.when(F.coalesce(F.trim("artist"), F.lit("")) == "", "missing_artist").when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title").when((F.length("artist") > 200) | (F.length("title") > 200), "too_long").otherwise("ok")
    return x.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def page_class(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and status: not_found, blocked or ok, from title and text."""
    head = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    status = F.when(head.rlike(r"\b404\b|not found"), "not_found").when(F.lower(html).rlike("not available in your (?:country|region)"), "blocked").otherwise("ok")
    return pages.select("page_id", status.alias("status"))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, https, host, section (first path segment), page (query parameter)."""
    return pages.select(
        "page_id", F.col("url").startswith("https://").alias("https"), F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]*)", 1).alias("section"), F.try_to_number(F.nullif(F.regexp_extract("url", r"[?&]page=(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long").alias("page"),
    )


def track_url(urls: DataFrame, host: str, keep: list[str] | None = None) -> DataFrame:
    """url (or the columns to keep) and track: the 22-character id of https://<host>/track/<id>, null otherwise."""
    pattern = rf"^https://{host}/(?:intl-[a-z]{{2}}/)?track/([A-Za-z0-9]{{22}})(?:[?#].*)?$"
    return urls.select(*(keep or ["url"]), F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")).alias("track"))
