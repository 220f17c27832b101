"""Hashes, hash splits and hash orders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def hex_prefix(c: Column, digits: int = 8) -> Column:
    """The first hex digits of the SHA-256 as a long; at most 15 digits."""
    return F.conv(F.substring(sha(c), 1, digits), 16, 10).cast("long")


def unit_fraction(c: Column) -> Column:
    """The first 13 hex digits as a fraction of 1."""
    return hex_prefix(c, 13) / F.lit(float(1 << 52))


def sha_mod(c: Column, m: int) -> Column:
    """The whole 256-bit SHA-256 modulo m, by Horner's rule over eight words."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(sha(c), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: (a * F.lit((1 << 32) % m) + w) % F.lit(m))


def split_80_10_10(key: Column) -> Column:
    """train, validation, test by the whole digest modulo 100."""
    bucket = sha_mod(key, 100)
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def split_75_10_10_5(key: Column) -> Column:
    """train, validation, test, audit by eight hex digits of the digest of the digest, modulo 100."""
    bucket = hex_prefix(sha(key), 8) % 100
    return F.when(bucket < 75, "train").when(bucket < 85, "validation").when(bucket < 95, "test").otherwise("audit")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    h = F.hex(F.encode(c, "UTF-8"))
    at = F.filter(F.sequence(F.lit(0), F.length(h)), lambda i: (i % 2 == 0) & (i < F.length(h)))
    byte = F.transform(at, lambda i: F.conv(F.substring(h, i + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(byte, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def subword_ids(text: Column, buckets: int = 4096, shortest: int = 3, longest: int = 5) -> Column:
    """Sorted distinct hash buckets of the character n-grams of ^text$."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substring(marked, i, F.lit(n)))
        return F.when(F.length(marked) >= n, every).otherwise(F.array().cast("array<string>"))

    whole = F.flatten(F.array(*[grams(n) for n in range(shortest, longest + 1)]))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda g: fnv1a(g) % buckets)))


def order_hash(i: Column) -> Column:
    """((i + 1) * 2654435761) mod 2**32."""
    return ((i + 1) * F.lit(2654435761)).bitwiseAND(F.lit(4294967295))


def synthetic_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha(c), 1, 16))
