"""Personal data with exact spans, also where it is disguised.

Plain identifiers are found by linear scans of the text as it is. Texts that show signs of a disguise (look-alike or
full-width characters, invisible characters, bracketed or spelled-out "at" and "dot", runs of spelled digits) go through
two transducers whose outputs remember where each character came from: one for single characters, one for phrases.
Identifiers of the normalised text map back to source spans; those that touch no plain one are added.

Defined cases: null text counts as empty and has no spans; offsets count code points of the text as it is; a match that
fails its test is dropped and the scan goes on behind it; repeated rows each get their row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import tidy

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9][0-9. -]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping within a kind, sorted."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    for chunk in _NUMERIC.finditer(text):
        lo, hi = chunk.span()
        for m in _IP.finditer(text, lo, hi):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((1, *m.span()))
        if hi - lo >= 16:
            for m in _CARD.finditer(text, lo, hi):
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return sorted(out)


#: Look-alikes of ASCII characters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    "․": ".", "。": ".", "．": ".", "｡": ".", "‧": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-",
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}

#: Names of the ten digits in the languages of the corpus (fixed values).
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


@lru_cache(1)
def _characters() -> dict[str, str]:
    """Single characters and what they stand for: the table; characters whose compatibility form is one ASCII character
    (full-width, mathematical, circled and raised ones among them); decimal digits of all scripts; combining marks vanish."""
    out = {}
    for c in range(0x80, 0x20000):
        x = chr(c)
        kind = unicodedata.category(x)
        plain = unicodedata.normalize("NFKC", x)
        if kind == "Nd":
            out[x] = str(unicodedata.digit(x))
        elif kind == "Mn" and c < 0x370:
            out[x] = ""
        elif len(plain) == 1 and " " <= plain <= "~":
            out[x] = plain
    return out | HOMOGLYPHS


#: Last labels that make a bare "x at y dot z" an address (fixed values).
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|me|eu|de|fr|es|uk|us|ca|ch|at|it|nl|be|pt|pl|ru|cn|jp|in|br|mx"


#: Words for @ and for the dot in addresses, in the languages of the corpus (fixed values).
AT_WORDS, DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto"


@lru_cache(1)
def _patterns():
    characters = "[" + "".join(map(re.escape, _characters())) + "]"
    name = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
    number = rf"(?:{name}|[0-9]{{1,4}})"
    open_, close = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
    host = r"[A-Za-z0-9-]{1,63}"
    boxed = rf"\s{{0,3}}{open_}(?:{DOT_WORDS}|\.){close}\s{{0,3}}"
    bare = rf"\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}"
    byte = rf"{number}(?:[\s-]{number}){{0,2}}"
    phrases = re.compile(
        rf"(?P<at>\s{{0,3}}{open_}(?:{AT_WORDS}|a|@){close}\s{{0,3}}(?={host})|\s{{1,3}}(?:{AT_WORDS})\s{{1,3}}(?={host}(?:\.{host}){{0,4}}{boxed}{host}|{host}(?:(?:\.|{bare}){host}){{0,4}}{bare}(?:{ENDINGS})\b))"
        rf"|(?P<bytes>\b{byte}(?:{bare}{byte}){{3}}\b)"
        rf"|(?P<dot>{boxed}(?=[A-Za-z0-9])|{bare}(?={host}))"
        rf"|(?P<plus>\bplus\s{{1,3}}(?={name}\b|[0-9]))"
        rf"|(?P<digits>\b(?:{number}[\s.-]{{1,2}}){{0,40}}?{name}(?:[\s.-]{{1,2}}{number}){{2,40}}\b)"
        rf"|(?P<spaced>(?<!\S)[A-Za-z0-9](?:\s[A-Za-z0-9._%+-]){{1,40}}\s?@\s?[A-Za-z0-9](?:\s[A-Za-z0-9.-]){{3,60}}(?!\S))",
        re.IGNORECASE,
    )
    sign = (
        rf"(?i:{open_}(?:{AT_WORDS}|a|@|{DOT_WORDS}|\.){close}|\s(?:{DOT_WORDS})\s|{name}[\s.-]{{1,2}}{number}[\s.-]{{1,2}}{number}|{number}[\s.-]{{1,2}}{number}[\s.-]{{1,2}}{name}"
        rf"|\s[a-z0-9]\s?@\s?[a-z0-9]\s)|{characters}"  # case folding would let a plain s or k stand for its look-alikes
    )
    return re.compile(characters), phrases, re.compile(rf"{name}|[0-9]+|(?:{DOT_WORDS})|[^\w]+", re.IGNORECASE), sign


#: Without one of these a text has no plain identifier.
_PLAIN_SIGN = r"@|\+[0-9]|[0-9][0-9. -]{6}"


def _marked(text: pa.Array) -> tuple[list[bool], list[bool]]:
    """Rows that may hold a plain identifier, and rows with a sign of disguise; null for null."""
    return tuple(pc.match_substring_regex(text, x).to_pylist() for x in (_PLAIN_SIGN, _patterns()[3]))


def _spans(text: str | None, plain: bool | None, disguised: bool | None) -> tuple[list, list]:
    found = plain_spans(text) if plain else []
    return found, added_spans(text, found) if disguised else []


class Aligned:
    """A rewritten text that knows the source span of each of its characters."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, replacement), in order and apart."""
        parts, self.to, self.origin, at, n = [], [], [], 0, 0
        for start, end, new in edits:
            if start > at:
                parts.append(source[at:start])
                self.to.append(n)
                self.origin.append((at, None))
                n += start - at
            if new:
                parts.append(new)
                self.to.append(n)
                self.origin.append((start, end))
                n += len(new)
            at = end
        parts.append(source[at:])
        self.to.append(n)
        self.origin.append((at, None))
        self.text = "".join(parts)

    def span(self, start: int, end: int) -> tuple[int, int]:
        def of(i: int) -> tuple[int, int]:
            k = bisect_right(self.to, i) - 1
            lo, hi = self.origin[k]
            return (lo + i - self.to[k], lo + i - self.to[k] + 1) if hi is None else (lo, hi)

        return of(start)[0], of(end - 1)[1]


def _phrase(m: re.Match, pieces: re.Pattern) -> str:
    if m.lastgroup == "spaced":
        return "".join(m.group().split())
    if m.lastgroup in ("digits", "bytes"):
        out = []
        for x in pieces.finditer(m.group()):
            word = x.group().lower()
            if word[0].isdigit():
                out.append(word)
            elif word[0].isalpha():
                out.append(DIGITS.get(word, "."))
            elif len(word) > 1 and m.lastgroup == "digits":
                out.append(" ")
        return "".join(out)
    return {"at": "@", "dot": ".", "plus": "+"}[m.lastgroup]


def added_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    characters, phrases, pieces, _ = _patterns()
    table = _characters()
    first = Aligned(text, [(m.start(), m.end(), table[m.group()]) for m in characters.finditer(text)])
    second = Aligned(first.text, [(m.start(), m.end(), _phrase(m, pieces)) for m in phrases.finditer(first.text)])
    taken = sorted((s, e) for _, s, e in plain)
    out = []
    for kind, start, end in plain_spans(second.text):
        start, end = first.span(*second.span(start, end))
        k = bisect_right(taken, (start, len(text) + 1))
        if any(s < end and start < e for s, e in taken[max(0, k - 2) : k + 1]):
            continue
        out.append((kind, start, end))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, plain matches of each kind, base_sha256, all spans, and how many the method added."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, hashed, spans, more = [[], [], [], []], [], [], []
            for x, *signs in zip(b.column(1), *_marked(b.column(1))):
                plain, extra = _spans(x.as_py(), *signs) if any(signs) else ([], [])
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in plain))
                hashed.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                spans.append(_joined(sorted(plain + extra)))
                more.append(len(extra))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashed, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        tidy(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, -end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text masked; null stays null, all columns stay."""
    i = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            new = b.column(i).to_pylist()
            for k, signs in enumerate(zip(*_marked(b.column(i)))):
                if any(signs):
                    new[k] = mask(new[k], sum(_spans(new[k], *signs), []))
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
