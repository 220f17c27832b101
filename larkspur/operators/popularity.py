"""Popularity on three scales, canonical rows, and audit aggregates over interactions (user, ctx, item, artist, title)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def context_frequency(x: DataFrame) -> DataFrame:
    """Distinct contexts of each item."""
    return x.groupBy("item").agg(F.count_distinct("ctx").alias("contexts"))


def user_percentile(x: DataFrame, bands: int = 10) -> DataFrame:
    """Distinct users, percentile lower/(n-1) and band of each item."""
    users = x.groupBy("item").agg(F.count_distinct("user").alias("users"))
    # the rank of a frequency is found among frequencies, of which there are few, not among items
    per = users.groupBy("users").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("users").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    pct = per.select("users", F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias("percentile"))
    return users.join(pct, "users").select("item", "users", "percentile", F.least(F.lit(bands - 1), F.floor(F.col("percentile") * bands)).cast("int").alias("band"))


def rank_popularity(x: DataFrame) -> DataFrame:
    """round(max(0.01, 1 - rank/n), 4) by contexts, then plays, then item."""
    n = x.groupBy("item").agg(F.count_distinct("ctx").alias("contexts"), F.count("*").alias("plays"))
    ranked = numbered(n.select("item", (-F.col("contexts")).alias("c"), (-F.col("plays")).alias("p")), ["c", "p", "item"], "rank")
    whole = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n"))))  # one row
    return whole.select("item", F.round(F.greatest(F.lit(0.01), 1 - F.col("rank") / F.col("n")), 4).alias("popularity"))


def midrank_popularity(x: DataFrame) -> DataFrame:
    """0.15 + 0.84 * (less + equal/2)/n among items with more than one user, else 0; three places, halves up."""
    users = x.groupBy("item").agg(F.count_distinct("user").alias("users"))
    per = users.where("users > 1").groupBy("users").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("users").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    value = F.floor((0.15 + 0.84 * (below + F.col("n") / 2) / total) * 1000 + 0.5) / 1000
    return users.join(per.select("users", value.alias("value")), "users", "left").select("item", "users", F.coalesce("value", F.lit(0.0)).alias("popularity"))


def canonical(x: DataFrame) -> DataFrame:
    """The smallest (artist, title) of each item."""
    return x.groupBy("item").agg(F.min(F.struct("artist", "title")).alias("m")).select("item", "m.artist", "m.title")


def best_rows(x: DataFrame) -> DataFrame:
    """The (plays, artist, title) of each item that is largest."""
    n = x.groupBy("item", "artist", "title").agg(F.count("*").alias("plays"))
    return n.groupBy("item").agg(F.max(F.struct("plays", "artist", "title")).alias("m")).select("item", "m.plays", "m.artist", "m.title")


def name_conflicts(x: DataFrame, key: str = "title") -> DataFrame:
    """Names that more than one item has, with how many."""
    return x.groupBy("artist", key).agg(F.count_distinct("item").alias("items"), F.min("item").alias("first_item")).where("items > 1")


def history_strength(e: DataFrame, limit: int = 500) -> DataFrame:
    """Items by play time (1 where unknown), plays and first event; the strongest ones."""
    n = e.groupBy("item").agg(F.sum(F.coalesce("value", F.lit(1.0))).alias("strength"), F.count("*").alias("plays"), F.min("event_id").alias("first_event"))
    return n.orderBy(F.desc("strength"), F.desc("plays"), "first_event").limit(limit)


def active_users(e: DataFrame, least: int, excluded: DataFrame | None = None) -> DataFrame:
    n = e.groupBy("user").agg(F.count("*").alias("listens")).where(F.col("listens") >= least)
    return n.join(excluded, "user", "left_anti") if excluded is not None else n


def ingest_report(e: DataFrame) -> DataFrame:
    """One row of counts and a status."""
    ok = F.col("user").isNotNull() & (F.col("ts") > 0) & F.col("item").isNotNull()
    r = e.agg(
        F.count("*").alias("parsed"), F.count_distinct("user", "ts", "item").alias("unique_rows"), F.count_if(~ok).alias("invalid"), F.count_distinct("user").alias("users"),
        F.count_distinct("item").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return r.withColumn("status", F.when((F.col("parsed") > 0) & (F.col("invalid") * 100 <= F.col("parsed")), "AUDITED").otherwise("REJECTED"))


def macro_mean(x: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Mean of the group means of each key's mean."""
    return x.groupBy(group, key).agg(F.avg(value).alias("m")).groupBy(group).agg(F.avg("m").alias("mean"), F.count("*").alias("members"))


def session_weight(x: DataFrame) -> DataFrame:
    """(1 - 0.8 * artist dominance) / contexts of the user."""
    per = x.select("user", "ctx", "artist", "item").distinct().groupBy("user", "ctx", "artist").agg(F.count("*").alias("n"))
    dom = per.groupBy("user", "ctx").agg((F.max("n") / F.sum("n")).alias("dominance"))
    return dom.select("user", "ctx", ((1 - 0.8 * F.col("dominance")) / F.count("*").over(Window.partitionBy("user"))).alias("weight"))


def artist_listeners(x: DataFrame) -> DataFrame:
    return x.select("user", "artist").distinct().groupBy("artist").agg(F.count("*").alias("listeners"))


def popularity_cuts(x: DataFrame) -> DataFrame:
    """Exact 0.99 quantile of item users and 0.995 of artist users, at least just above the median."""
    def cut(df: DataFrame, name: str, q: float) -> DataFrame:
        return df.agg(F.greatest(F.percentile("n", F.lit(q)), F.percentile("n", F.lit(0.5)) + 1).alias(name))

    items = x.groupBy("item").agg(F.count_distinct("user").alias("n"))
    artists = x.groupBy("artist").agg(F.count_distinct("user").alias("n"))
    return cut(items, "item_cut", 0.99).crossJoin(cut(artists, "artist_cut", 0.995))  # one row each


def standardizer(x: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale), scale at least 0.05."""
    long = x.select(F.explode(F.create_map(*[y for c in columns for y in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v"))
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_samp("v"), F.lit(0.05)).alias("scale"))


def vocabulary(x: DataFrame, column: str, size: int) -> DataFrame:
    """The most played values with ids by alphabetical order."""
    top = x.groupBy(column).agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), column).limit(size)
    return top.select(column, "plays", (F.row_number().over(Window.orderBy(column)) - 1).alias("id"))


def rank_feature(x: DataFrame, value: str) -> DataFrame:
    """x with feature = -log1p(how many rows have a larger value): equal evidence, equal feature. Ranks are found among the
    distinct values; round a continuous value first."""
    per = x.groupBy(value).agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.join(per.select(value, (-F.log1p(above)).alias("feature")), value)
