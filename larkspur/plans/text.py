"""Text keys, hashes and page rules over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import clean as C
from ..sources.html import tracklists
from ..sources.tables import catalog, table
from .base import query


def _docs(s, d):
    return table(s, d, "documents")


query("f1_text_key", r"SELECT p_partkey AS item, lower(p_brand) || chr(31) || trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS key FROM part")(
    lambda s, d: catalog(s, d).select("item", T.track_key(F.col("artist"), F.col("title")).alias("key"))
)


query("f2_folded_keys", r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS folded FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", F.md5(T.folded_key(F.col("text")).cast("binary")).alias("folded"))
)


query("f7_token_text", r"SELECT p_partkey AS item, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS tokens FROM part")(
    lambda s, d: catalog(s, d).select("item", T.token_text(F.concat_ws(" ", "artist", "title")).alias("tokens"))
)

#: (before, behind) a part's name: titles of versions, and others that look like them.
VERSIONS = [("", ""), ("", " - Live"), ("", " (2011 Remaster)"), ("", " (Acoustic)"), ("", " - 1999 Remastered"), ("", " [Remastered 2009]"), ("", " (Demo)"), ("", " (Live) Part 2"), ("Re-", ""), ("", " (feat. Guest)")]
_LIST = lambda k: "[" + ", ".join("'" + v[k] + "'" for v in VERSIONS) + "]"
TITLES = f"t AS (SELECT p_partkey AS item, p_brand AS artist, p_partkey % 10 AS m, {_LIST(0)}[p_partkey % 10 + 1] || p_name || {_LIST(1)}[p_partkey % 10 + 1] AS title, p_name FROM part)"


def _titles(s, d):
    at = (F.col("item") % 10 + 1).cast("int")
    before, behind = (F.element_at(F.array(*[F.lit(v[k]) for v in VERSIONS]), at) for k in (0, 1))
    return catalog(s, d).withColumn("title", F.concat(before, F.col("title"), behind))


query(
    "f5_song_family",
    f"""WITH {TITLES} SELECT lower(artist) || chr(31) || lower(CASE WHEN m IN (1, 2, 3, 4, 5) THEN p_name ELSE title END) AS family, count(*) AS versions, min(item) AS first_item FROM t GROUP BY 1""",
)(lambda s, d: _titles(s, d).groupBy(T.song_key(F.col("artist"), F.col("title")).alias("family")).agg(F.count("*").alias("versions"), F.min("item").alias("first_item")))

query("f4_remaster_key", f"WITH {TITLES} SELECT item, lower(CASE WHEN m IN (2, 4, 5) THEN p_name ELSE title END) AS key FROM t")(lambda s, d: _titles(s, d).select("item", T.remaster_key(F.col("title")).alias("key")))

query("f6_versionless", f"WITH {TITLES} SELECT item, lower(CASE WHEN m IN (1, 2, 3, 4, 5, 6) THEN p_name WHEN m = 7 THEN p_name || ' Part 2' ELSE title END) AS title FROM t")(
    lambda s, d: _titles(s, d).select("item", T.versionless(F.col("title")).alias("title"))
)

#: Curly double quotes and the minus sign are no part of the folding; single quotes and dashes are.
query("f3_match_key", """SELECT p_partkey AS item, '\u201c' || lower(p_name) || '\u201d - it''s \u2212 x' AS key FROM part""")(
    lambda s, d: catalog(s, d).select("item", T.match_key(F.concat(F.lit("\u201c"), F.col("title"), F.lit("\u201d   \u2014  It\u2019s \u2212 X "))).alias("key"))
)

query("f8_seed_key", "SELECT p_partkey AS item, sha256(lower(p_brand) || chr(0) || lower(p_name)) AS key FROM part")(
    lambda s, d: catalog(s, d).select("item", H.sha(T.seed_key(F.concat(F.lit("  "), "artist"), F.col("title"))).alias("key"))
)

FNV = "list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS UBIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"

query("f9_fnv1a", f"SELECT p_partkey AS item, CAST({FNV.format('p_name')} AS BIGINT) AS hash FROM part")(lambda s, d: catalog(s, d).select("item", H.fnv1a(F.col("title")).alias("hash")))

query(
    "f10_subwords",
    f"""WITH g AS (SELECT DISTINCT p_partkey AS item, substr('^' || p_name || '$', i, n) AS gram FROM part, range(3, 6) r(n), range(1, 200) s(i) WHERE i + n - 1 <= len(p_name) + 2),
    b AS (SELECT DISTINCT item, CAST({FNV.format('gram')} % 4096 AS BIGINT) AS bucket FROM g) SELECT item, count(*) AS n, string_agg(bucket, ',' ORDER BY bucket) AS buckets FROM b GROUP BY item""",
)(lambda s, d: catalog(s, d).select("item", H.subword_ids(F.col("title")).alias("b")).select("item", F.size("b").cast("long").alias("n"), F.array_join("b", ",").alias("buckets")))

query("f12_order_hash", "SELECT p_partkey AS item, ((p_partkey + 1) * 2654435761) & 4294967295 AS hash FROM part")(lambda s, d: catalog(s, d).select("item", H.order_hash(F.col("item")).alias("hash")))


query("p2_name_length", "SELECT c_custkey, length(c_name) AS n FROM customer WHERE length(c_name) <= 200")(lambda s, d: table(s, d, "customer").select("c_custkey", F.length("c_name").alias("n")).where("n <= 200"))

query("p12_reject_report", "SELECT 'ok' AS code, count(*) AS n FROM part")(lambda s, d: C.reject_report(catalog(s, d)))

query(
    "p9_url_parts",
    r"""SELECT page_id, starts_with(url, 'https://') AS https, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS section,
    CAST(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS BIGINT) AS page FROM pages""",
)(lambda s, d: C.url_parts(table(s, d, "pages")))

query(
    "p10_page_class",
    r"""SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\b404\b|not found') THEN 'not_found'
    WHEN regexp_matches(lower(html), 'not available in your (?:country|region)') THEN 'blocked' ELSE 'ok' END AS status FROM pages""",
)(lambda s, d: C.page_class(table(s, d, "pages")))


@query("s7_html_lists")
def _lists(s, d):
    """With navigation, as the given pages have lists nowhere else."""
    return tracklists(table(s, d, "pages"), skipped=frozenset({"script", "style"}))


query("s15_fingerprint", "SELECT count(*) AS n, sum(CAST('0x' || substr(sha256(doc_id || ':' || text), 1, 8) AS UBIGINT))::DOUBLE AS digest FROM documents")(
    lambda s, d: _docs(s, d).agg(F.count("*").alias("n"), F.sum(H.hex_prefix(F.concat_ws(":", "doc_id", "text"))).cast("double").alias("digest"))
)
