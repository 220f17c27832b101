"""URL filters: stated host and path rules first, then association rules mined from labelled urls.

A url becomes a set of tokens: labels of its host, pieces of its path, parts of what follows. FP-growth runs over the
labelled urls' sets, to which ``BAD`` is added where a label says so. A frequent set with ``BAD`` and the same set without
it make a rule; it stays if its support and confidence reach the bounds. Each rule is posted once, under its rarest
token. A url looks up the postings of its tokens and checks that it has the rest of the rule.

Bounds: a token in a frequent set is in ``share`` of the labelled urls, so there are at most (tokens a url) / ``share`` of
them; these tokens reach the driver, nothing else does. A labelled url brings all its frequent tokens into the mining, so
no rule is missed; sets are exponential in the number of tokens that are frequent together. Postings are broadcast up to
``MOST`` rules; more are joined by salted token, since a token may be in most urls.

Everything runs as DataFrame operations; there is no Python in tasks.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated
pages each get their row; labels with null ids or null marks count for nothing; a page with several labels counts once
for each; without labels there are no mined rules; an empty table gives no rows; further columns are ignored. Of stated
rules that fit, the longest wins, then the first in code-point order; of mined ones the most confident, then the one with
most support, then the first in order.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import staged

#: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

BAD = "=bad"
#: So many mined rules are broadcast at most.
MOST = 50_000
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows them."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1), F.lit(""))


def url_tokens(host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens: h: a label of the host, p: a piece of the path, t: a part of what follows; runs of digits are #."""

    def pieces(kind: str, text: Column, cut: str) -> Column:
        plain = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]+", "#")
        return F.transform(F.filter(F.split(plain, cut), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    return F.array_distinct(F.concat(pieces("h:", host, r"\."), pieces("p:", path, "[^a-z0-9#-]+"), pieces("t:", F.regexp_replace(tail, "#", "&"), "[?&]+")))


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last that fits stays
        of, slash, below = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + below)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _tokens(pages: DataFrame, url_col: str) -> Column:
    return url_tokens(*url_parts(F.col(url_col)))


def mine(labelled: DataFrame, share: float = 0.002, least: int = 5, confidence: float = 0.6) -> DataFrame:
    """labelled: tokens, bad. Rules: antecedent (sorted tokens), anchor (the rarest of them), support (bad urls that have
    them all), confidence."""
    spark = labelled.sparkSession
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled-urls")
    n = rows.count()
    need = max(least, -int(-share * n // 1))
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    often = staged(often, "url-tokens")
    met = each.join(F.broadcast(often), "token")  # (tokens a url) / share rows at most
    baskets = met.groupBy("row").agg(F.collect_list("token").alias("items"), F.first("bad").alias("bad"))
    baskets = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    baskets = staged(baskets, "baskets")
    shown = baskets.count()
    if not shown:
        return spark.createDataFrame([], "antecedent array<string>, anchor string, support long, confidence double")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / shown)).fit(baskets).freqItemsets
    sets = staged(sets.select(F.array_sort("items").alias("items"), "freq"), "frequent-urls")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("support"))
    both = bad.join(sets.select(F.col("items").alias("antecedent"), "freq"), "antecedent")
    both = both.select("antecedent", "support", (F.col("support") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence)
    anchors = both.select("*", F.explode("antecedent").alias("token")).join(F.broadcast(often), "token")
    return staged(anchors.groupBy("antecedent", "support", "confidence").agg(F.min(F.struct("n", "token"))["token"].alias("anchor")).select("antecedent", "anchor", "support", "confidence"), "url-rules")


def judge(pages: DataFrame, mined: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the stated one that decides), verdict, because (the mined rule that fits best),
    confidence (of it)."""
    used = [r[0] for r in mined.select(F.explode("antecedent").alias("token")).distinct().collect()]  # frequent tokens only
    host, path, tail = url_parts(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), tail.alias("tail"))
    known = F.array_intersect(url_tokens(F.col("host"), F.col("path"), F.col("tail")), F.array(*map(F.lit, used)).cast("array<string>"))
    rows = rows.select("row", "page_id", "host", "path", known.alias("known"))
    each = rows.select("*", F.explode_outer("known").alias("anchor"))
    index = mined.select("anchor", F.struct("confidence", "support", "antecedent").alias("found"))
    if mined.count() <= MOST:
        met = each.join(F.broadcast(index), "anchor", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", (F.col("row") % SALTS).cast("int")).join(salted, ["anchor", "salt"], "left")
    fits = F.size(F.array_except("found.antecedent", "known")) == 0
    key = F.when(fits, F.struct(F.col("found.confidence").alias("confidence"), F.col("found.support").alias("support"), F.array_join("found.antecedent", " ").alias("because")))
    order = lambda c: F.struct(-c["confidence"], -c["support"], c["because"])
    met = met.select("row", "page_id", "host", "path", key.alias("key"))
    best = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.min_by("key", F.when(F.col("key").isNotNull(), order(F.col("key")))).alias("key"))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("key").isNotNull(), "block").otherwise("allow")
    return best.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("key.because").alias("because"), F.col("key.confidence").alias("confidence"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad whose label has quality 0 or says toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.where("url IS NOT NULL").join(labels.where("bad IS NOT NULL"), "page_id").select(_tokens(pages, "url").alias("tokens"), "bad")
    return judge(pages, mine(labelled))


OP11_SQL = r"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_replace(url, '(?s)^.*?://', '') ELSE '' END AS rest FROM pages
), u AS (
  SELECT row_number() OVER () AS row, page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(.*)$', 1) AS tail FROM r
), k AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'), '[^a-z0-9#-]+'), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(translate(replace(tail, '#', '&'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'), '[?&]+'), lambda x: x <> ''), lambda x: 't:' || x))) AS tokens FROM u
), l AS (
  SELECT k.tokens, k.row, coalesce(quality = 0 OR toxic = 1, NULL) AS bad, count(*) OVER () AS n FROM k JOIN labels ON doc_id = page_id WHERE url IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL
), e AS (SELECT row_number() OVER () AS id, tokens, bad, greatest(5, ceil(0.002 * n)) AS need FROM l
), f AS (SELECT t AS token FROM (SELECT unnest(tokens) AS t, need FROM e) GROUP BY t HAVING count(*) >= max(need)
), b AS (SELECT id, bad, need, list_sort(list_filter(tokens, lambda x: list_contains(often, x))) AS items FROM e, (SELECT list(token) AS often FROM f)
), s AS (
  SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedent, bad, need FROM b, LATERAL (SELECT unnest(range(1, (1 << len(items))::BIGINT)) AS m)
), g AS (
  SELECT antecedent, count(*) FILTER (bad) AS support, count(*) FILTER (bad) / count(*) AS confidence FROM s GROUP BY antecedent HAVING count(*) FILTER (bad) >= max(need)
), h AS (
  SELECT k.row, arg_min({'c': confidence, 'b': array_to_string(antecedent, ' ')}, {'c': -confidence, 's': -support, 'b': array_to_string(antecedent, ' ')}) AS best
  FROM k JOIN (SELECT * FROM g WHERE confidence >= 0.6) g ON list_has_all(k.tokens, g.antecedent) GROUP BY k.row
), v AS (
  SELECT k.*, h.best, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM k LEFT JOIN h ON k.row = h.row
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       best.b AS because, best.c AS confidence
FROM v
"""
