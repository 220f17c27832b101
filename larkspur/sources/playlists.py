"""Playlists in files of any of six formats, and tracks nested anywhere in a page's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import artist_title
from .nested import NestedTracks, PlaylistSongs, each
from .staging import cut

#: Column names under which exports give artist, title and link (fixed values).
ARTIST_NAMES = ("artist", "artist name", "artist name(s)", "artist_name", "performer")
TITLE_NAMES = ("title", "track", "track name", "track_name", "name", "song")
LINK_NAMES = ("spotify id", "spotify uri", "track uri", "uri", "url", "link", "id")
_ID = r"(?:^|track[:/])([A-Za-z0-9]{22})(?:$|[?#])"


def kind(text: Column) -> Column:
    """json, m3u, pls, tsv, csv or lines, by how the text begins."""
    body = F.ltrim(text)
    first = F.lower(F.split(body, "\n")[0])
    named = first.rlike(r"(?:^|[\t,;\"])(?:" + "|".join(n.replace("(", r"\(").replace(")", r"\)") for n in TITLE_NAMES) + r")(?:$|[\t,;\"\r])")
    return (
        F.when(body.rlike(r"^[\[{](?!playlist)"), "json").when(first.startswith("#extm3u"), "m3u").when(first.startswith("[playlist]"), "pls")
        .when(named & first.contains("\t"), "tsv").when(named & first.rlike("[,;]"), "csv").otherwise("lines")
    )


def _fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line; quoted ones may hold the delimiter, and doubled quotes."""
    mark = F.when(delimiter == "\t", "\\t").otherwise(delimiter)
    pattern = F.concat(F.lit('("[^"]*(?:""[^"]*)*"|[^"'), mark, F.lit("]*)(?:"), mark, F.lit("|$)"))
    raw = F.regexp_extract_all(line, pattern, F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)))


def _named(header: Column, fields: Column, names: tuple[str, ...]) -> Column:
    at = F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0)) for n in names])
    return F.try_element_at(fields, at.cast("int"))


def playlists(files: DataFrame) -> DataFrame:
    """file_id, pos (from 0), artist, title, track (22 characters, null without a link) of files (file_id, text). Rows without
    artist or title go; pos counts what a file lists."""
    files = cut(files.select("file_id", "text"), "files")  # else a filter by kind makes the text anew for each mention of it
    typed = cut(files.withColumn("kind", kind(F.col("text"))), "typed-files")
    songs = each(typed.where("kind = 'json'"), ["file_id"], F.col("text"), PlaylistSongs)
    named = F.when(F.col("line").isNotNull(), artist_title(F.col("line"))).otherwise(F.struct("artist", "title"))
    songs = songs.select("file_id", "pos", named.alias("t"), "links").select("file_id", "pos", "t.artist", "t.title", F.get(F.filter("links", lambda x: x.rlike(_ID)), F.lit(0)).alias("link"))
    # a record of a table may go on behind a line break in quotes; a file in which quotes are left open is cut at each break
    paired = (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2 == 0
    records = F.when(F.col("kind").isin("csv", "tsv") & paired, F.regexp_extract_all("text", F.lit(r'((?:"[^"]*+"|[^"\n]++)++)'), 1)).otherwise(F.split("text", "\n"))
    lines = typed.where("kind <> 'json'").select("file_id", "kind", F.filter(F.transform(records, lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "").alias("lines"))
    lines = cut(lines, "lines")  # read several times by each branch
    delimiter = F.when(F.col("kind") == "tsv", "\t").when(F.col("lines")[0].contains(";") & ~F.col("lines")[0].contains(","), ";").otherwise(",")
    tables = lines.where("kind IN ('csv', 'tsv')").withColumn("delimiter", delimiter)
    # what a record needs of its file is made first: else each record goes on with all lines of the file
    tables = tables.select("file_id", "delimiter", F.transform(_fields(F.col("lines")[0], F.col("delimiter")), F.lower).alias("header"), F.slice("lines", 2, 1 << 30).alias("records"))
    tables = tables.select("file_id", "delimiter", "header", F.posexplode("records").alias("pos", "line"))
    tables = tables.select("file_id", "pos", "header", _fields(F.col("line"), F.col("delimiter")).alias("f"))
    tables = tables.select("file_id", "pos", *[_named(F.col("header"), F.col("f"), n).alias(c) for c, n in (("artist", ARTIST_NAMES), ("title", TITLE_NAMES), ("link", LINK_NAMES))])

    def entry(kind: Column, line: Column) -> Column:
        extended, numbered = F.regexp_extract(line, r"^#EXTINF:[^,]*,(.*)$", 1), F.regexp_extract(line, r"(?i)^title\d+=(.*)$", 1)
        return F.when(kind == "m3u", F.nullif(extended, F.lit(""))).when(kind == "pls", F.nullif(numbered, F.lit(""))).otherwise(line)

    rest = lines.where("kind IN ('m3u', 'pls', 'lines')").select("file_id", F.filter(F.transform("lines", lambda line: entry(F.col("kind"), line)), lambda x: x.isNotNull()).alias("entries"))
    rest = rest.select("file_id", F.posexplode("entries").alias("pos", "entry")).select("file_id", "pos", artist_title(F.col("entry")).alias("t"))
    rest = rest.select("file_id", "pos", "t.artist", "t.title", F.lit(None).cast("string").alias("link"))
    whole = songs.unionByName(tables).unionByName(rest).where("trim(artist) <> '' AND trim(title) <> ''")
    return whole.select("file_id", "pos", F.trim("artist").alias("artist"), F.trim("title").alias("title"), F.nullif(F.regexp_extract("link", _ID, 1), F.lit("")).alias("track"))


def nested_tracks(states: DataFrame, deepest: int = 8) -> DataFrame:
    """page_id, pos, artist, title of objects with a title and artists, at most ``deepest`` levels down, in order of their
    place. states: page_id, state (JSON of any shape, which no schema fits; text that is no JSON has none)."""
    found = each(states, ["page_id"], F.col("state"), lambda v: NestedTracks(v, F.lit(deepest)))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "pos", "artist", "title")


def page_states(pages: DataFrame) -> DataFrame:
    """page_id, state: JSON bodies of script elements, and of strings that a page pushes to itself while it loads."""
    body = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>\s*([\[{].*?)\s*</script>"), 1), lambda x: x != "")
    pushed = F.regexp_extract_all("html", F.lit(r'(?s)\.push\(\s*\[\s*\d+\s*,\s*(".*?(?:(?<=\\\\)|(?<!\\))")\s*\]\s*\)'), 1)
    unescaped = F.transform(pushed, lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))
    return pages.select("page_id", F.explode(F.concat(body, unescaped)).alias("state"))


def acoustic_vector(docs: DataFrame) -> DataFrame:
    """id, vec: means and deviations (roots of the covariance's diagonal) of 13 mfcc and 13 gfcc, logs (1 + x) of mean and
    deviation of five spectral statistics, and of three rhythm values: 65 numbers, null where any is missing. docs: id, doc (JSON)."""
    cepstrum = "struct<mean: array<double>, cov: array<array<double>>>"
    spectral = ("centroid", "energy", "flux", "rolloff", "spread")
    schema = f"struct<lowlevel: struct<mfcc: {cepstrum}, gfcc: {cepstrum}, " + ", ".join(f"spectral_{n}: struct<mean: double, var: double>" for n in spectral) + ">, rhythm: struct<bpm: double, onset_rate: double, danceability: double>>"
    j = docs.select("id", F.from_json("doc", schema).alias("j"))
    low, parts = F.col("j.lowlevel"), []

    def deviations(cov: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.sqrt(F.get(F.get(cov, i), i)))

    for c in ("mfcc", "gfcc"):
        parts += [low[c]["mean"], deviations(low[c]["cov"])]
    parts.append(F.array(*[F.log1p(x) for n in spectral for x in (low[f"spectral_{n}"]["mean"], F.sqrt(low[f"spectral_{n}"]["var"]))]))
    parts.append(F.array(*[F.log1p(F.col(f"j.rhythm.{n}")) for n in ("bpm", "onset_rate", "danceability")]))
    vec = F.concat(*parts)
    whole = (F.size(vec) == 65) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    return j.select("id", F.when(whole, vec).alias("vec"))
