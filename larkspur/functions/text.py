"""Text keys. They differ on purpose in case folding, white space and version labels: a join must name the one it uses."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\x1f"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no builtin for it."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def _composed(c: Column, how) -> Column:
    """Only text outside ASCII goes to Python."""
    return F.when(c.rlike("^\\p{ASCII}*$"), c).otherwise(how(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def text_key(c: Column) -> Column:
    """Composed, lower case, single spaces."""
    return collapse(F.lower(_composed(c, nfkc)))


def folded_key(c: Column) -> Column:
    """Composed, case folded, single spaces."""
    return collapse(F.when(c.rlike("^\\p{ASCII}*$"), F.lower(c)).otherwise(nfkc_casefold(c)))


def match_key(c: Column) -> Column:
    """Folded key with single curly quotes and the dashes ‐ ‑ – — made plain and " - " spaced evenly."""
    return collapse(F.regexp_replace(F.translate(folded_key(c), "‘’‐‑–—", "''----"), r"\s+-\s+", " - "))


def seed_key(artist: Column, title: Column) -> Column:
    """Lower case and trimmed only, joined by NUL."""
    return F.concat(F.trim(F.lower(_composed(artist, nfkc))), F.lit("\x00"), F.trim(F.lower(_composed(title, nfkc))))


def track_key(artist: Column, title: Column) -> Column:
    return F.concat(text_key(artist), F.lit(UNIT), text_key(title))


#: Words that make a last bracket, or what follows a spaced dash, a version of a family's song.
FAMILY_WORDS = ("remaster", "live", "version", "remix", "acoustic", "edit")
#: Labels that say nothing but which version it is, and those of mastering alone.
LABELS = ("remaster", "remastered", "remix", "remixed", "live", "demo", "acoustic", "instrumental", "radio edit", "single version", "album version", "mono", "stereo", "clean", "explicit", "cover")
MASTERED = ("remaster", "remastered")


def _is_label(text: Column, labels: tuple[str, ...]) -> Column:
    """Whether the words of a text, but for a year before or behind them, are one of these labels."""
    words = F.split(text, " ")
    year = lambda w: F.coalesce((F.length(w) == 4) & (F.translate(w, "0123456789", "") == ""), F.lit(False))
    skip, cut = year(F.element_at(words, 1)).cast("int"), year(F.element_at(words, -1)).cast("int")
    return F.array_join(F.slice(words, skip + 1, F.greatest(F.size(words) - skip - cut, F.lit(0))), " ").isin(*labels)


def _bracketed(title: Column, inside: str) -> tuple[Column, Column]:
    """What stands before a bracket at the end, and what stands in it."""
    return F.rtrim(F.regexp_extract(title, inside, 1)), F.regexp_extract(title, inside, 2)


_INNERMOST, _OUTERMOST = r"^(.*)[\[(]([^\[\]()]+)[\])]$", r"^(.*?)[\[(]([^\])]+)[\])]$"


def remaster_key(title: Column) -> Column:
    """The match key without a last bracket or dash suffix that only says remaster, with or without a year."""
    key = match_key(title)
    before, inside = _bracketed(key, _INNERMOST)
    bare = F.when(_is_label(inside, MASTERED), before).otherwise(key)
    suffix = F.substring_index(bare, " - ", -1)
    return F.when((suffix != bare) & _is_label(suffix, MASTERED), F.left(bare, F.length(bare) - F.length(suffix) - 3)).otherwise(bare)


def family_title(title: Column) -> Column:
    """The match key without a last bracket that holds a version word, and without what follows a spaced dash and one."""
    key = match_key(title)
    before, inside = _bracketed(key, _OUTERMOST)
    bare = F.when(reduce(or_, [F.contains(inside, F.lit(w)) for w in FAMILY_WORDS]), before).otherwise(key)
    pieces = F.split(bare, " - ")

    def tells(piece: Column) -> Column:
        behind_year = F.when(F.length(F.substring_index(piece, " ", 1)) == 4, F.when(F.translate(F.left(piece, F.lit(4)), "0123456789", "") == "", F.substring(piece, 6, 1 << 20)))
        return reduce(or_, [F.coalesce(behind_year, piece).startswith(w) for w in FAMILY_WORDS])

    at = F.array_position(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), tells), True).cast("int")
    return F.trim(F.when(at > 0, F.array_join(F.slice(pieces, F.lit(1), at), " - ")).otherwise(bare))


def song_key(artist: Column, title: Column) -> Column:
    """Key of all versions of a song."""
    return F.concat(match_key(artist), F.lit(UNIT), family_title(title))


def versionless(title: Column) -> Column:
    """Every bracket goes whose whole content is a version label, with the space before it, and so does a dash suffix."""
    pieces = F.split(text_key(title), r"(?=[\[(])|(?<=[\])])")
    label = lambda p: F.coalesce(F.left(p, F.lit(1)).isin("[", "(") & F.right(p, F.lit(1)).isin("]", ")") & _is_label(F.substring(p, F.lit(2), F.length(p) - 2), LABELS), F.lit(False))
    behind = F.concat(F.slice(pieces, 2, 1 << 30), F.array(F.lit("")))
    kept = F.zip_with(pieces, behind, lambda p, q: F.when(label(p), "").when(label(q), F.rtrim(p)).otherwise(p))
    bare = F.array_join(kept, "")
    dash = r"^(.*)[-–—]\s*([^-–—]+)$"
    return collapse(F.when(_is_label(F.regexp_extract(bare, dash, 2), LABELS), F.regexp_extract(bare, dash, 1)).otherwise(bare))


def token_text(c: Column) -> Column:
    """Letters and digits of the lower-case text, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def artist_title(line: Column) -> Column:
    """A line "1. Artist - Title" as struct(artist, title): numbering, then a bullet go; the first dash or colon splits, with
    or without blanks, or " by " with the title first, whichever comes first."""
    numbered = F.regexp_replace(line, r"^\s*(?:\[\d+\]|\d+\s*[.):-]|\d+\s+[–—])\s*", "")
    bare = F.trim(F.regexp_replace(numbered, r"^\s*[•*·-]\s+", ""))
    sides = F.split(bare, r"(?i)(?<!^)(?:\s*[-–—:]\s*|\s+by\s+)", 2)
    swapped = F.regexp_extract(bare, r"(?i)(?<!^)(\s*[-–—:]\s*|\s+by\s+)", 1).rlike("(?i)by")
    first, second = collapse(_composed(F.get(sides, F.lit(0)), nfkc)), collapse(_composed(F.get(sides, F.lit(1)), nfkc))
    whole = (F.size(sides) == 2) & (first != "") & (second != "")
    return F.when(whole, F.struct(F.when(swapped, second).otherwise(first).alias("artist"), F.when(swapped, first).otherwise(second).alias("title")))
