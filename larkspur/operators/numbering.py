"""Numbers for rows in a total order, and draws by number, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import cut


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of a whole number over all rows before each one, in the order of these columns (which must tell all
    rows apart). Range partitions are summed by themselves and moved by the sums of those before."""
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    own = before.partitionBy("_p").orderBy(*order)
    inner = parts.withColumn("_v", value.cast("long")).withColumn("_p", F.spark_partition_id()).withColumn("_s", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    inner = cut(inner, "running")  # read twice: a second sampling of the ranges could differ
    totals = inner.groupBy("_p").agg(F.sum("_v").alias("t"))
    moved = totals.select("_p", F.coalesce(F.sum("t").over(before.orderBy("_p")), F.lit(0)).alias("_t"))  # one row a partition
    return inner.join(F.broadcast(moved), "_p").withColumn(name, F.col("_t") + F.col("_s")).drop("_p", "_v", "_s", "_t")


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """df with each row's number, from 0, in the order of these columns."""
    return running(df, order, F.lit(1), name)


def hash_number(*parts: Column) -> Column:
    """48 bits of the SHA-256 of the parts joined by ':'."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 12), 16, 10).cast("long")


#: Entries of a last block, and blocks under one of the next level, where a union of lists is searched by number.
LEAF, FAN = 128, 32


def in_unions(picks: DataFrame, lists: DataFrame, entries: DataFrame) -> DataFrame:
    """(pool, number, item): the entry with that number, from 0, of the pool's lists together, in the order of items. The
    union itself is never made: entries are counted by list in blocks of blocks, and each pick goes down from the one block
    of all entries to the last one that holds its number. picks: pool, number; lists: pool, list; entries: list, item."""
    at = cut(numbered(entries, ["item", "list"], "at"), "entries")
    n, widths = at.count(), [LEAF]
    while widths[-1] < n:
        widths.append(widths[-1] * FAN)
    state = picks.select("pool", "number").distinct().withColumns({"node": F.lit(0).cast("long"), "left": F.col("number").cast("long")})
    block = lambda width: F.floor(F.col("at") / width)
    for width in reversed(widths[:-1]):
        under = block(width)
        counts = at.groupBy(F.floor(under / FAN).alias("node"), "list").agg(*[F.count_if(under % FAN == c).alias(f"c{c}") for c in range(FAN)])
        each = state.join(lists, "pool").join(counts, ["node", "list"]).groupBy("pool", "number", "node", "left").agg(F.array(*[F.sum(f"c{c}") for c in range(FAN)]).alias("c"))
        step = lambda s, c: F.when(s["left"] < c, F.struct(s["child"].alias("child"), s["left"].alias("left"), F.lit(True).alias("there"))).otherwise(F.struct((s["child"] + 1).alias("child"), (s["left"] - c).alias("left"), F.lit(False).alias("there")))
        start = F.struct(F.lit(0).cast("long").alias("child"), F.col("left"), F.lit(False).alias("there"))
        down = F.aggregate("c", start, lambda s, c: F.when(s["there"], s).otherwise(step(s, c)))
        state = each.withColumn("d", down).select("pool", "number", (F.col("node") * FAN + F.col("d.child")).alias("node"), F.col("d.left").alias("left"))
    last = at.groupBy(block(LEAF).alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "list", "item"))).alias("e"))
    own = lists.groupBy("pool").agg(F.collect_set("list").alias("own"))
    at_left = F.filter("e", lambda e: F.array_contains(F.col("own"), e["list"]))[F.col("left").cast("int")]
    return state.join(own, "pool").join(last, "node").select("pool", "number", at_left["item"].alias("item"))


def drawn(asked: DataFrame, items: DataFrame, known: DataFrame, keys: list[str], n: int, tries: int, lists: DataFrame | None = None) -> DataFrame:
    """(keys.., query, pool, item): for each asked row n items of its pool that its query does not know, the first by hash
    draws. Draw j takes the pool's item number hash(keys, j) mod the pool's size; of ``tries`` draws the first n different
    unknown items count. A quarter more than n draws are made first, and all of them where these are not enough. Where all
    are not enough (a small pool, or one that is nearly known), the rest is filled in hash order from all unknown items of
    the pool: exact, and rare. asked: keys, query, pool; items: pool, item, number (dense within the pool, from 0); known:
    query, item. With lists (pool, list), a pool is the union of its lists in the order of items, and items are list, item."""
    if lists is None:
        size = items.groupBy("pool").agg(F.count("*").alias("size"))
    else:
        size = lists.join(items.groupBy("list").agg(F.count("*").alias("n")), "list").groupBy("pool").agg(F.sum("n").alias("size"))
    same = [F.col(k) for k in keys]
    w = Window.partitionBy(*keys, "query").orderBy("j")

    def some(rows: DataFrame, draws: int) -> DataFrame:
        d = rows.join(size, "pool").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        pick = d.select(*keys, "query", "pool", "j", F.pmod(hash_number(*same, F.col("j")), F.col("size")).alias("number"))
        if lists is None:
            found = pick.join(items, ["pool", "number"])
        else:
            pick = cut(pick, "picks")  # read twice
            found = pick.join(in_unions(pick, lists, items), ["pool", "number"])
        found = found.join(known, ["query", "item"], "left_anti").groupBy(*keys, "query", "pool", "item").agg(F.min("j").alias("j"))
        return cut(found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k"), "drawn")

    def missing(rows: DataFrame, have: DataFrame) -> DataFrame:
        got = have.groupBy(*keys, "query").agg(F.count("*").alias("got"))
        return rows.join(got, [*keys, "query"], "left").where(F.coalesce("got", F.lit(0)) < n)

    few = n + n // 4
    first = some(asked, min(few, tries))
    short = missing(asked, first)
    if few < tries:
        short = cut(short.drop("got"), "short")
        if not short.isEmpty():
            more = some(short, tries)
            first = first.join(short.select(*keys, "query"), [*keys, "query"], "left_anti").unionByName(more)
            short = missing(short, more)
        else:
            short = short.withColumn("got", F.lit(0))
    of = items.select("pool", "item") if lists is None else lists.join(items, "list").select("pool", "item")
    rest = short.join(of, "pool").join(known, ["query", "item"], "left_anti").join(first.select(*keys, "query", "item"), [*keys, "query", "item"], "left_anti")
    fill = rest.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "query").orderBy(hash_number(*same, F.col("item")), "item")))
    fill = fill.where(F.col("k") <= n - F.coalesce("got", F.lit(0)))
    return first.select(*keys, "query", "pool", "item").unionByName(fill.select(*keys, "query", "pool", "item"))


def drawn_sql(asked: str, items: str, known: str, keys: list[str], n: int, tries: int, name: str) -> str:
    """The same as common table expressions, the last one called ``name``."""
    k = ", ".join(keys)
    joined = " || ':' || ".join(keys)
    both = " AND ".join(f"a.{x} = b.{x}" for x in [*keys, "query"])
    number = "CAST('0x' || substr(sha256({0}), 1, 12) AS UBIGINT)"
    return f"""{name}_z AS (SELECT pool, count(*) AS size FROM {items} GROUP BY pool),
{name}_d AS (SELECT {k}, query, a.pool, j, {number.format(joined + " || ':' || j")} % size AS number FROM {asked} a JOIN {name}_z z ON a.pool = z.pool, range(0, {tries}) r(j)),
{name}_f AS (SELECT {k}, d.query, d.pool, i.item, min(j) AS j FROM {name}_d d JOIN {items} i ON d.pool = i.pool AND d.number = i.number WHERE NOT EXISTS (SELECT 1 FROM {known} kn WHERE kn.query = d.query AND kn.item = i.item) GROUP BY ALL),
{name}_1 AS (SELECT {k}, query, pool, item FROM (SELECT *, row_number() OVER (PARTITION BY {k}, query ORDER BY j) AS k_ FROM {name}_f) WHERE k_ <= {n}),
{name}_s AS (SELECT a.*, coalesce(got, 0) AS got FROM {asked} a LEFT JOIN (SELECT {k}, query, count(*) AS got FROM {name}_1 GROUP BY ALL) b ON {both} WHERE coalesce(got, 0) < {n}),
{name}_r AS (SELECT {", ".join("a." + x for x in keys)}, a.query, a.pool, i.item, got, row_number() OVER (PARTITION BY {", ".join("a." + x for x in keys)}, a.query ORDER BY {number.format(" || ':' || ".join("a." + x for x in keys) + " || ':' || i.item")}, i.item) AS k_ FROM {name}_s a JOIN {items} i ON a.pool = i.pool
  WHERE NOT EXISTS (SELECT 1 FROM {known} kn WHERE kn.query = a.query AND kn.item = i.item) AND NOT EXISTS (SELECT 1 FROM {name}_1 b WHERE {both} AND b.item = i.item)),
{name} AS (SELECT {k}, query, pool, item FROM {name}_1 UNION ALL SELECT {k}, query, pool, item FROM {name}_r WHERE k_ <= {n} - got)"""
