"""Classes grow by the links of a round alone (check's fail of op1_near_dedup and pipeline, FINDINGS_r03.md)."""

import random

from larkspur.llm import near_dup


def _roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(4)
    chain = list(range(1000, 1040))
    star = [(2000 + k, 2099) for k in range(30)] + [(2099, 1999), (7, 7)]
    mixed = rng.sample(chain, 40)
    links = list(zip(mixed, mixed[1:])) + star + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    links = [(a, b) for a, b in links if a != b]
    assert {r.node: r.root for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()} == _roots(links)
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).collect() == []
    klass = near_dup._joined(None, spark.createDataFrame(links[:50], "a long, b long"))
    klass = near_dup._joined(klass, spark.createDataFrame(links[50:], "a long, b long"))
    assert {r.node: r.root for r in klass.collect()} == _roots(links)


def test_links_of_a_round_are_gone_through_once(spark, monkeypatch):
    rng = random.Random(5)
    base, docs = [f"w{k}" for k in range(120)], []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 2, 2])):
            text[at] = f"v{k}z{at}"
        docs.append((k, " ".join(text)))
    given, found = [], []
    search, between = near_dup.components, near_dup._similar

    def counted(edges):
        given.append(edges.count())
        return search(edges)

    def kept(pairs, sets):
        out = between(pairs, sets)
        found.append(out.where("similarity >= 0.8").count())
        return out

    monkeypatch.setattr(near_dup, "components", counted)
    monkeypatch.setattr(near_dup, "_similar", kept)
    rows = near_dup.near_dup_classes(spark.createDataFrame(docs, "doc_id long, text string"), bands=3, rows=2, small=4, exhaustive=False).collect()
    assert len(rows) == 60 and len(given) > 1
    assert sum(given) <= sum(found)
