"""Scores, fitted linear rankers and evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..functions.vector import dense, dot
from ..sources.staging import cut
from .numbering import numbered


def mlp(rows: DataFrame, layers: list[tuple[list[list[float]], list[float]]], features: str = "features") -> DataFrame:
    """rows with score: dense ReLU layers with literal weights, the last one linear with one output."""
    x = F.col(features).cast("array<double>")
    for k, (w, b) in enumerate(layers):
        x = dense(x, w, b, relu=k < len(layers) - 1)
    return rows.withColumn("score", x[0])


def evaluated(candidates: DataFrame, targets: DataFrame, scorers: dict[str, Callable[[DataFrame], Column]], k: int) -> DataFrame:
    """(scorer, queries, recall, ndcg, mrr, hit): the means over queries of what each scorer ranks into the first k places.
    A scorer takes the candidates (query, item, ..) and gives a column of them; all see the same candidates and targets, and
    those are read once. Ties by item."""
    from .ranking import metrics

    names = list(scorers)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), scorers[n](candidates).cast("double").alias("score")) for n in names]))
    scored = candidates.select("query", "item", each.alias("s")).select("s.scorer", "query", "item", "s.score")
    w = Window.partitionBy("scorer", "query").orderBy(F.desc("score"), "item")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asked = targets.withColumn("scorer", F.explode(F.array(*map(F.lit, names))))
    key = F.struct("scorer", "query").alias("query")
    m = metrics(ranked.select(key, "item", "rank"), asked.select(key, "item"), k)
    return m.groupBy(F.col("query.scorer").alias("scorer")).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("recall", "ndcg", "mrr", "hit")])


def placed(scored: DataFrame, targets: DataFrame, signals: list[str]) -> DataFrame:
    """(query, items, hits, a column a signal): one row a query, with its candidates by item, 1 where one is a target, and
    their places from 0 by each signal, ties by item. Candidates that are dealt by query already are not dealt again. scored:
    query, item, signals; targets: query, item."""
    kinds = [scored.schema[c].dataType.simpleString() for c in ("query", "item")]

    def run(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        item = mine["item"].to_numpy()
        order = np.argsort(item, kind="stable")
        item, n = item[order], len(item)
        out = {"query": mine["query"].slice(0, 1), "items": [item], "hits": [np.isin(item, wanted["target"].to_numpy()).astype(np.int8)]}
        for c in signals:
            place = np.empty(n, np.int32)
            place[np.argsort(-mine[c].to_numpy()[order].astype(float), kind="stable")] = np.arange(n, dtype=np.int32)
            out[c] = [place]
        return pa.table(out if n else {c: [] for c in out})

    def typed(mine: pa.Table, wanted: pa.Table) -> pa.Table:
        return run(mine, wanted).cast(pa.schema([("query", mine.schema.field("query").type), ("items", pa.list_(mine.schema.field("item").type)), ("hits", pa.list_(pa.int8())), *[(c, pa.list_(pa.int32())) for c in signals]]))

    both = scored.select("query", "item", *signals).groupBy("query").cogroup(targets.select(F.col("query").alias("of"), F.col("item").alias("target")).groupBy("of"))
    return both.applyInArrow(typed, f"query {kinds[0]}, items array<{kinds[1]}>, hits array<tinyint>, " + ", ".join(f"{c} array<int>" for c in signals))


def _shares(row: dict, signals: list[str]) -> np.ndarray:
    """1 for the first place of a signal to 0 for the last, a column a signal."""
    places = np.stack([np.asarray(row[c], float) for c in signals], 1)
    return 1 - places / max(len(places) - 1, 1)


#: Pairs of a query that are added up at once.
PAIRS = 1 << 20


def pairwise_ranker(rows: DataFrame, signals: list[str], penalty: float = 1e-4, steps: int = 10) -> list[float]:
    """Coefficients of the least mean of softplus(other - target) over all pairs of a target and another candidate of one query,
    plus penalty / 2 * |coefficients|^2, by Newton steps. Pairs are never rows: a step is one pass over ``placed`` rows, in which
    each task sends its sums of gradient and curvature, added up in numpy. rows: of ``placed``."""
    size, theta = len(signals), np.zeros(len(signals))
    rows = rows.select("hits", *signals)

    def sums(theta: np.ndarray):
        def run(batches):
            total = np.zeros(1 + size + size * size)
            for b in batches:
                for k in range(b.num_rows):
                    row = {c: b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("hits", *signals)}
                    x, hit = _shares(row, signals), row["hits"] > 0
                    p, others = x[hit], x[~hit]
                    total[0] += len(p) * len(others)
                    step = max(1, PAIRS // max(len(p), 1))
                    for at in range(0, len(others) if len(p) else 0, step):
                        o = others[at : at + step]
                        s = 1 / (1 + np.exp(p @ theta - (o @ theta)[:, None]))
                        curve = s * (1 - s)
                        cross = o.T @ curve @ p
                        total[1 : 1 + size] += s.sum(1) @ o - s.sum(0) @ p
                        total[1 + size :] += (o.T @ (curve.sum(1)[:, None] * o) + p.T @ (curve.sum(0)[:, None] * p) - cross - cross.T).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "x"])

        return run

    for _ in range(steps):
        got = rows.mapInArrow(sums(theta), "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow().sort_by("place")["x"].to_numpy()
        if not len(got) or not got[0]:
            break
        mean = got[1:] / got[0]
        move = np.linalg.solve(mean[size:].reshape(size, size) + penalty * np.eye(size), mean[:size] + penalty * theta)
        theta = theta - move
        if np.abs(move).max() < 1e-10:
            break
    return theta.tolist()


def best_placed(rows: DataFrame, signals: list[str], weights: list[float], k: int, slack: float = 1e-8) -> DataFrame:
    """(query, item, signals): of ``placed`` rows the candidates whose weighted sum of shares is at most ``slack`` below a
    query's k-th best, so that sums that are rounded can be ranked by whoever reads them."""
    kinds = [rows.schema["query"].dataType.simpleString(), rows.schema["items"].dataType.elementType.simpleString()]
    w = np.array(weights)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = _shares({c: b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in signals}, signals)
                score = x @ w
                on = np.flatnonzero(score >= (np.partition(score, -k)[-k] if len(score) > k else -np.inf) - slack)
                item = b.column("items")[i].values.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("query")[i].as_py()] * len(on), b.column("query").type), item, *[pa.array(x[on, j]) for j in range(len(signals))]], ["query", "item", *signals])

    return rows.mapInArrow(run, f"query {kinds[0]}, item {kinds[1]}, " + ", ".join(f"{c} double" for c in signals))


def linear(rows: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    score = F.lit(0.0)
    for c, w in zip(columns, weights):
        score = score + F.col(c) * w
    return rows.withColumn("score", score)


def residual(rows: DataFrame, columns: list[str], weights: list[float], bound: float = 2.0) -> DataFrame:
    """base + bound * tanh(linear)."""
    return linear(rows, columns, weights).withColumn("score", F.col("base") + bound * F.tanh("score"))


def feedback_adjusted(scored: DataFrame, feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, item, score): plus half of (best similarity to a liked item less that to a disliked one), similarities mapped to
    (1 + cos)/2. feedback: query, item, action; vectors: item, vec of unit length."""
    f = feedback.join(vectors.select("item", F.col("vec").alias("fv")), "item").select("query", "action", "fv")
    s = scored.join(vectors, "item").join(f, "query", "left").withColumn("sim", (1 + dot(F.col("vec"), F.col("fv"))) / 2)
    best = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, F.col("sim"))), F.lit(0.0))
    g = s.groupBy("query", "item", "score").agg((0.5 * (best("like") - best("dislike"))).alias("adjust"))
    return g.select("query", "item", (F.col("score") + F.col("adjust")).alias("score"))


def best_alpha(scored: DataFrame, targets: DataFrame, alphas: list[float], k: int = 20) -> DataFrame:
    """(alpha, ndcg): the blend of percentile ranks a and b with the best mean NDCG. scored: query, item, a, b."""
    from .ranking import metrics

    each = scored.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    w = Window.partitionBy("alpha", "query")
    ranked = each.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b"), 9)), "item"))).where(F.col("rank") <= k)
    key = F.concat_ws("|", F.col("alpha").cast("string"), F.col("query").cast("string"))
    asked = targets.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    m = metrics(ranked.select(key.alias("query"), "item", "rank"), asked.select(key.alias("query"), "item"), k)
    mean = m.groupBy(F.split("query", r"\|")[0].cast("double").alias("alpha")).agg(F.avg("ndcg").alias("ndcg"))
    return mean.orderBy(F.desc(F.round("ndcg", 9)), "alpha").limit(1)


def whole_ranking(positives: DataFrame, scores: DataFrame, known: DataFrame) -> DataFrame:
    """(query, item, rank): each positive's place, from 1, by score, ties by item, among itself and all items that its query does
    not know. No item is drawn and none crossed with the queries: it is the item's place among all of them, less the known ones
    before it. positives: query, item, of the known; scores: item, score; known: query, item."""
    places = numbered(scores.select("item", (-F.col("score")).alias("s")), ["s", "item"], "place").select("item", "place")
    before = F.row_number().over(Window.partitionBy("query").orderBy("place")) - 1
    ranked = known.select("query", "item").distinct().join(places, "item").select("query", "item", (F.col("place") - before + 1).alias("rank"))
    return positives.select("query", "item").join(ranked, ["query", "item"])


def ranking_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row: hit, mrr and ndcg at k, means over positives with their rank."""
    within = F.col("rank") <= k
    return ranked.agg(F.avg(within.cast("double")).alias("hit"), F.avg(F.when(within, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.avg(F.when(within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"))


def contrastive_loss(pairs: DataFrame, heat: float = 0.07, batch: int = 1024) -> DataFrame:
    """(batch, loss): mean softmax loss of each pair's similarity among its hash batch's. pairs: id, a, b (vectors)."""
    number = numbered(pairs.select("id", sha(F.col("id")).alias("h")), ["h", "id"], "number").select("id", F.floor(F.col("number") / batch).alias("batch"))
    parts = cut(pairs.join(number, "id"), "batches")
    other = parts.select("batch", F.col("id").alias("other"), F.col("b").alias("ob"))
    s = parts.join(other, "batch").withColumn("s", dot(F.col("a"), F.col("ob")) / heat)  # a batch has ``batch`` rows
    row = s.groupBy("batch", "id").agg(F.log(F.sum(F.exp("s"))).alias("all"), F.max(F.when(F.col("id") == F.col("other"), F.col("s"))).alias("own"))
    return row.groupBy("batch").agg(F.avg(F.col("all") - F.col("own")).alias("loss"))


def calibrated(results: DataFrame, settings: list[str], floor: float = 0.6) -> DataFrame:
    """The setting of the smallest mean size whose recall reaches the floor; none if none does. results: settings.., recall, size."""
    return results.where(F.col("recall") >= floor).orderBy("size", F.desc("recall"), *settings).limit(1)


def temporal_ratings(ratings: DataFrame, least: int = 20, each: int = 5, exposures: int = 3, train: int = 10) -> DataFrame:
    """Ratings (query, id, sequence, exposure, label, ..) with ``part``: the last fifth by sequence (4 at least, ties with the
    first of them too) validates; what is earlier trains, but for exposures that validate too. Queries with fewer than
    ``least`` ratings, ``each`` likes or dislikes, ``exposures`` lists, or ``train`` training ratings of both labels go."""
    n = ratings.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("likes"), F.count_distinct("exposure").alias("lists"))
    enough = n.where((F.col("n") >= least) & (F.col("likes") >= each) & (F.col("n") - F.col("likes") >= each) & (F.col("lists") >= exposures)).select("query", "n")
    back = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sequence"), F.desc("id")))
    r = cut(ratings.join(enough, "query").withColumn("back", back), "ratings")
    first = r.where(F.col("back") == F.greatest(F.lit(4), F.floor(F.col("n") / 5))).select("query", F.col("sequence").alias("from"))
    r = r.join(first, "query")
    late = r.where(F.col("sequence") >= F.col("from"))
    held = late.select("query", "exposure").distinct()
    early = r.where(F.col("sequence") < F.col("from")).join(held, ["query", "exposure"], "left_anti")
    able = early.groupBy("query").agg(F.count("*").alias("m"), F.count_distinct("label").alias("kinds")).where((F.col("m") >= train) & (F.col("kinds") == 2)).select("query")
    both = early.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("validation")))
    return both.join(able, "query").drop("n", "back", "from")


def _salted(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows beside their query's one, so dealt that a query may have any share of them."""
    salted = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["query", "salt"]).drop("salt")


def logistic_fits(rows: DataFrame, decay: float = 0.05, steps: int = 8) -> DataFrame:
    """(query, theta): for each query the weights and, last, the bias of least mean cross entropy plus decay * |weights|^2, by
    Newton steps from the label's mean. A step is one aggregate for all queries: sums of gradient and curvature. rows: query, id,
    z (features), label."""
    rows = cut(rows.select("query", "id", F.array_append("z", F.lit(1.0)).alias("z"), "label"), "fit-rows")
    size = len(rows.select("z").head()[0]) if not rows.isEmpty() else 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    prior = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.avg("label")))
    start = F.concat(F.array_repeat(F.lit(0.0), size - 1), F.array(F.log(prior / (1 - prior))))
    now = rows.groupBy("query").agg(F.count("*").alias("n"), start.alias("theta"))
    kind = rows.schema["query"].dataType.simpleString()

    def solved(batches):
        for b in batches:
            theta, g, h = [], np.array(b["g"].tolist()), np.array(b["h"].tolist())
            for k, (t, n) in enumerate(zip(b["theta"], b["n"])):
                t, curve = np.array(t, float), np.zeros((size, size))
                for (i, j), v in zip(pairs, h[k]):
                    curve[i, j] = curve[j, i] = v / n
                ridge = np.append(np.full(size - 1, 2 * decay), 0.0)
                theta.append((t - np.linalg.solve(curve + np.diag(ridge), g[k] / n + ridge * t)).tolist())
            yield pd.DataFrame({"query": b["query"], "n": b["n"], "theta": theta})

    for _ in range(steps):
        each = _salted(cut(now, "fits"), rows).withColumn("p", 1 / (1 + F.exp(-dot(F.col("theta"), F.col("z")))))
        error, curve = F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p"))
        g = F.array(*[F.sum(error * F.col("z")[i]) for i in range(size)])
        h = F.array(*[F.sum(curve * F.col("z")[i] * F.col("z")[j]) for i, j in pairs])
        sums = each.groupBy("query").agg(F.first("n").alias("n"), F.first("theta").alias("theta"), g.alias("g"), h.alias("h"))
        now = sums.mapInPandas(solved, f"query {kind}, n long, theta array<double>")
    return cut(now.select("query", "theta"), "fits")


def _ordered_pairs(rows: DataFrame, score: str) -> DataFrame:
    """How many pairs of a like and a dislike of one list are in the right order, halves for ties, from ranks; sum over a list."""
    w = Window.partitionBy("query", "exposure")
    rank = F.rank().over(w.orderBy(score)) + (F.count("*").over(Window.partitionBy("query", "exposure", score)) - 1) / 2
    ranked = rows.withColumn("_r", rank)
    likes = F.count_if(F.col("label") > 0)
    return ranked.groupBy("query", "exposure").agg((F.sum(F.when(F.col("label") > 0, F.col("_r")).otherwise(0.0)) - likes * (likes + 1) / 2).alias(score), (likes * (F.count("*") - likes)).alias("pairs"))


def personal_models(ratings: DataFrame, spread: DataFrame, features: list[str]) -> DataFrame:
    """(query, mean, scale, theta, strength, ..) of the accepted fits, and what they were accepted by: loss on the validating
    ratings below the prior's, and within lists as many like-dislike pairs in order as the base score has. ratings: query, id,
    sequence, exposure, label, score, features; spread: query, spread (of the query's scores). A query whose validating lists
    have no like beside a dislike cannot be judged and has no row."""
    r = cut(temporal_ratings(ratings).withColumn("x", F.array(*[F.col(f).cast("double") for f in features])), "parts")
    n = len(features)
    stats = r.where("part = 'train'").groupBy("query").agg(
        F.count("*").alias("train"), F.avg("label").alias("prior"), F.array(*[F.avg(F.col("x")[i]) for i in range(n)]).alias("mean"),
        F.array(*[F.greatest(F.lit(0.05), F.stddev_samp(F.col("x")[i])) for i in range(n)]).alias("scale"),
    )
    z = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "scale", lambda a, b: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), a / b)))
    z_rows = cut(_salted(stats, r).withColumn("z", z), "standardized")
    models = stats.join(logistic_fits(z_rows.where("part = 'train'")), "query").join(spread, "query").withColumn("strength", F.least(F.lit(0.35), F.col("train") / 200))
    models = cut(models, "models")
    late = _salted(models.select("query", "theta", "strength", "spread"), z_rows.where("part = 'validation'").drop("prior"))
    logit = dot(F.array_append("z", F.lit(1.0)), F.col("theta"))
    late = cut(late.withColumn("logit", logit).withColumn("moved", F.col("score") + F.col("strength") * F.col("spread") * F.tanh(logit / 2)), "judged")
    loss = F.avg(F.greatest(F.lit(0.0), F.col("logit")) + F.log1p(F.exp(-F.abs("logit"))) - F.col("label") * F.col("logit"))
    judged = late.groupBy("query").agg(F.count("*").alias("validation"), loss.alias("loss"), F.avg("label").alias("liked"))
    order = _ordered_pairs(late, "score").join(_ordered_pairs(late, "moved").drop("pairs"), ["query", "exposure"])
    order = order.groupBy("query").agg(*[F.sum(c).alias(c) for c in ("pairs", "score", "moved")]).where("pairs > 0")
    order = order.select("query", "pairs", *[F.try_divide(c, "pairs").alias(n) for c, n in (("score", "base_order"), ("moved", "own_order"))])
    m = models.join(judged, "query").join(order, "query")
    m = m.withColumn("base_loss", -(F.col("liked") * F.log("prior") + (1 - F.col("liked")) * F.log(1 - F.col("prior"))))
    return m.withColumn("accepted", F.coalesce((F.col("loss") < F.col("base_loss")) & (F.col("pairs") > 0) & (F.col("own_order") >= F.col("base_order")), F.lit(False)))


def personal_layer(ratings: DataFrame, scores: DataFrame, features: list[str]) -> DataFrame:
    """(query, item, score): scores plus a bounded personal correction where a user's own ratings support one: strength (up to
    0.35, with the number of ratings) * deviation of the scores * tanh(logit / 2). scores: query, item, score, features."""
    spread = scores.groupBy("query").agg(F.greatest(F.lit(0.05), F.stddev_pop("score")).alias("spread"))
    models = personal_models(ratings, spread, features).where("accepted").select("query", "mean", "scale", "theta", "strength", "spread")
    x = F.array(*[F.col(f).cast("double") for f in features])
    z = F.zip_with(F.zip_with(x, "mean", lambda a, b: a - b), "scale", lambda a, b: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), a / b)))
    logit = dot(F.array_append(z, F.lit(1.0)), F.col("theta"))
    moved = F.col("score") + F.coalesce(F.col("strength") * F.col("spread") * F.tanh(logit / 2), F.lit(0.0))
    return scores.join(models, "query", "left").select("query", "item", moved.alias("score"))
