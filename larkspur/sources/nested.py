"""Songs in JSON of any shape: table functions over a variant, joined to its row by a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where exports keep a song's artist, title and link, and a file its list (fixed values; first found counts, a number is a
#: place in a list).
ARTISTS = (
    "master_metadata_album_artist_name", "artistName", "artist", "artist.name", "artist.#text", "Artist Name(s)", "Artist Name", "Artist", "artist_name", "artists.0", "artists.0.name",
    "artists.0.artist.name", "author", "author.name", "performer", "performer.name", "byArtist", "byArtist.name", "Исполнитель", "Артист", "Автор",
)
TITLES = ("master_metadata_track_name", "trackName", "title", "track", "Track", "Track Name", "name", "Title", "song", "Song", "track_name", "Название", "Трек", "Песня")
LINKS = ("spotify_track_uri", "uri", "Spotify Track Id", "id", "spotify_url", "external_urls.spotify")
LISTS = (
    "songs", "tracks", "items", "data", "history", "tracks.items", "playlist.tracks", "playlist.items", "result.tracks", "results.track", "results.tracks", "recenttracks.track", "library.tracks",
)
#: Types of structured data that list songs (fixed values).
LISTING = frozenset({"MusicPlaylist", "MusicAlbum", "ItemList"})


def at(x, path: str):
    """What stands at a path, or None."""
    for step in path.split("."):
        if isinstance(x, dict):
            x = x.get(step)
        elif isinstance(x, list) and step.isdigit() and int(step) < len(x):
            x = x[int(step)]
        else:
            return None
    return x


def first_of(x, paths: tuple[str, ...], kind: type):
    return next((v for v in (at(x, p) for p in paths) if isinstance(v, kind)), None)


def song(entry) -> tuple[str | None, str | None, list[str]]:
    """Artist, title and all links of an entry, which may wrap its song."""
    inner = next((entry[k] for k in ("attributes", "track") if isinstance(entry, dict) and isinstance(entry.get(k), dict)), entry)
    return first_of(inner, ARTISTS, str), first_of(inner, TITLES, str), [v for v in (at(inner, p) for p in LINKS) if isinstance(v, str)]


def song_list(x) -> list:
    """The list of songs of a file: itself, at a known place, or else the first list at one of the two upper levels that
    begins with a song."""
    if isinstance(x, list):
        return x
    known = first_of(x, LISTS, list)
    if known is not None or not isinstance(x, dict):
        return known or []
    inner = [y for v in x.values() for y in ([v] if isinstance(v, list) else v.values() if isinstance(v, dict) else ()) if isinstance(y, list) and y]
    return next((y for y in inner if all(song(y[0])[:2])), [])


def _python(v):
    return v.toPython() if v is not None else None


@F.udtf(returnType="pos int, artist string, title string, links array<string>, line string")
class PlaylistSongs:
    """A row an entry of the file's list; an entry that is a text comes as a line."""

    def eval(self, v) -> Iterator[tuple]:
        for pos, entry in enumerate(song_list(_python(v))):
            if isinstance(entry, str):
                yield pos, None, None, None, entry
            elif isinstance(entry, dict):
                yield pos, *song(entry), None


@F.udtf(returnType="pos int, artist string, title string")
class NestedTracks:
    """Objects with a title and artists, at most ``deepest`` levels down, in order of their place."""

    def eval(self, v, deepest: int) -> Iterator[tuple]:
        waiting, pos = [(_python(v), 0)], 0
        while waiting:
            x, level = waiting.pop()
            names = [n.strip() for n in (a.get("name") if isinstance(a, dict) else a for a in x["artists"]) if isinstance(n, str) and n.strip()] if isinstance(x, dict) and isinstance(x.get("artists"), list) else []
            if names and isinstance(x.get("title"), str) and x["title"].strip():
                yield pos, ", ".join(names), x["title"].strip()
                pos += 1
            elif level < deepest:
                inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
                waiting += [(y, level + 1) for y in reversed(inner)]


@F.udtf(returnType="pos int, name string, artist string")
class ListedSongs:
    """Songs of every object that says it lists some, wherever it stands; a song without artist takes the list's."""

    def eval(self, v) -> Iterator[tuple]:
        waiting = [_python(v)]
        while waiting:
            x = waiting.pop()
            if isinstance(x, dict) and str(x.get("@type")) in LISTING:
                for pos, entry in enumerate(first_of(x, ("track", "tracks", "itemListElement"), list) or []):
                    one = entry["item"] if isinstance(entry, dict) and isinstance(entry.get("item"), dict) else entry
                    name, artist = at(one, "name"), self._name(at(one, "byArtist")) or self._name(x.get("byArtist"))
                    if isinstance(name, str) and name.strip():
                        yield pos, name.strip(), artist
            inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            waiting += [y for y in reversed(inner) if isinstance(y, (dict, list))]

    @staticmethod
    def _name(by) -> str | None:
        names = [n for n in (at(b, "name") for b in (by if isinstance(by, list) else [by])) if isinstance(n, str)]
        return " ".join(names).strip() or None


def each(rows: DataFrame, keys: list[str], text: Column, function) -> DataFrame:
    """The keys of rows beside what a table function gives for their JSON; text that is none gives nothing."""
    parsed = rows.select(*keys, F.try_parse_json(text).alias("_v")).where("_v IS NOT NULL").alias("parsed")
    return parsed.lateralJoin(function(F.col("parsed._v").outer()))
