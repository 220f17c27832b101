"""Url rules, spelling variants and conversation tries on awkward tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import prefix_trie, spelling, url_rules

PAGES = "page_id long, url string, html string, row long, host string, verdict string"


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _stated(host, path):
    best = None
    for verdict, rule in url_rules.RULES:
        of, slash, below = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + below) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    urls = [
        "https://Www.Example.NET/en/1", "http://a.example.net/fr/x", "http://net/", "http://net", "http://planet/de/", "https://example.com/de/9?x=1", "https://x.EXAMPLE.com/de", "ftp://y.org/fr/#a",
        "http://org?fr/", None, "", "no scheme/net/", "a://b://c.net/d", "://net/", "http://ÄB.net/é\nf?q#r", "http://h/" + "a/" * 3000,
    ]
    urls += [f"http://{'spam' if k % 3 == 0 else 'good'}.site.io/p{k % 4}/{k}" for k in range(60)] + ["http://org/fr/"] * 3
    return spark.createDataFrame([(i, u, None, 5, "h", "v") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, 1, "", "")], PAGES), urls


def test_url_rules(spark, pages):
    df, urls = pages
    bad = {i: i >= 16 and i < 76 and (i - 16) % 3 == 0 for i in range(70)}
    labels = spark.createDataFrame([(i, b) for i, b in bad.items()], "page_id long, bad boolean")
    labelled = df.where("url IS NOT NULL").join(labels, "page_id").select(url_rules._tokens(df, "url").alias("tokens"), "bad")
    mined = url_rules.mine(labelled)
    rules = {tuple(r.antecedent): (r.support, r.confidence) for r in mined.collect()}
    tokens = [tuple(r.tokens) for r in labelled.where("bad").collect()]
    assert rules[("h:spam",)] == (18, 1.0) and all(v[0] >= 5 and v[1] >= 0.6 for v in rules.values())
    assert all(sum(set(rule) <= set(t) for t in tokens) == support for rule, (support, _) in rules.items())
    out = {r.page_id: r for r in url_rules.judge(df, mined).collect()}
    assert len(out) == df.count() and out[None].rule == "net/"
    for i, u in enumerate(urls):
        r = out[i]
        rule, verdict = _stated(*_parts(u))
        assert (r.host, r.path, r.rule) == (*_parts(u), rule), u
        assert r.verdict == (verdict or ("block" if "//spam." in (u or "") else "allow")), u
    again = {r.page_id: (r.verdict, r.because) for r in _without_broadcast(df, mined)}
    assert again == {k: (r.verdict, r.because) for k, r in out.items()}


def _without_broadcast(df, mined):
    most, url_rules.MOST = url_rules.MOST, -1
    try:
        return url_rules.judge(df, mined).collect()
    finally:
        url_rules.MOST = most


def test_url_rules_without_labels_or_pages(spark, pages):
    df, urls = pages
    none = url_rules.mine(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    assert none.isEmpty() and {r.verdict for r in url_rules.judge(df, none).where("rule IS NULL").collect()} == {"allow"}
    assert url_rules.judge(df.limit(0), none).isEmpty()


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w in n:
        near = [v for v in n if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(near)
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("alphabet", ["ab", "abcdÉé÷xY"])
def test_spelling_equals_brute_force(spark, alphabet, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    words += [w[:k] + rng.choice(alphabet) + w[k + rng.randrange(2) :] for w in words for k in (0, len(w) // 2, len(w) - 1)]
    words += ["a" * 5, "a" * 6, "a" * 7, "long" * 40, "long" * 40 + "x", "longx" + "long" * 39]
    rows = [(i, " 1,".join(rng.choices(words, k=90))) for i in range(60)] + [(k, " ".join(words[-6:])) for k in (None, None, 7, 8)]
    rows += [(None, None), (3, ""), (4, "12 ö_- ×")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = _variants(rows)
    assert sum(r[1] is not None for r in want) > 10
    assert {tuple(r) for r in spelling.variants(df).collect()} == want
    monkeypatch.setattr(spelling, "BLOCK", 500)  # many blocks, groups in parts
    monkeypatch.setattr(spelling, "GROUP", 40)
    assert {tuple(r) for r in spelling.variants(df).collect()} == want


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert spelling.variants(df).isEmpty() and spelling.variants(df.limit(0)).isEmpty()


def test_wide_intervals_are_walked_by_symbol(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(200)})
    text = [w.encode() for w in words]
    q = np.array([list(w) for w in text], np.int64)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a[3:] == b[3:] and _near(a, b)}
    for narrow in (0, 1000):
        monkeypatch.setattr(spelling, "NARROW", narrow)
        six, no = np.full(len(words), 6), np.zeros(len(words), bool)
        a, b = spelling.Ranks(text, six * 2).near(q, six, six // 2, six * 2, no, no)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def _trie(rows):
    convs = _rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, path string, n long"


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_trie_equals_brute_force(spark, parts, monkeypatch):
    rng = random.Random(parts)
    rows = []
    for c in rng.sample(range(0, 400), 150):
        rows += [(c, t if rng.random() < 0.97 else None, rng.choice(["u", "a", None]), rng.choice(["x", "y z", "", None])) for t in range(rng.randrange(1, 6))]
    rows = [(c, t, r, x if t is not None else f"null {k}") for k, (c, t, r, x) in enumerate(rows)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(1000 + k, t, "u", "same text here") for k in range(90) for t in range(3)]
    rows += [(2000 + k, t, "u", f"w{t}") for k in range(3) for t in range(100 + 20 * k)] + [(None, 0, "u", "lost")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS).repartition(3)
        out = prefix_trie.trie(prefix_trie.distinct_paths(prefix_trie.rebuilt(df)).cache()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(tuple(r) for r in out) == _trie(rows)


def test_trie_of_copies_of_one_another_and_of_nothing(spark):
    rows = [(c, t, "u", f"{t}") for c in range(0, 200000, 20) for t in range(2)]  # ids of several pieces end at one node
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in prefix_trie.trie(prefix_trie.distinct_paths(prefix_trie.rebuilt(df))).collect()) == _trie(rows)
    assert prefix_trie.trie(prefix_trie.distinct_paths(prefix_trie.rebuilt(df.limit(0)))).isEmpty()
    alone = spark.createDataFrame([(41, 0, "u", "gone")], df.schema)
    assert [tuple(r) for r in prefix_trie.trie(prefix_trie.distinct_paths(prefix_trie.rebuilt(alone))).collect()] == list(_trie([(41, 0, "u", "gone")]))


def test_turns_of_equal_number_have_one_order(spark):
    rows = [(0, 1, "u", x) for x in "abc"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = {bytes(prefix_trie.rebuilt(df.orderBy(F.col("text") if up else F.desc("text")).coalesce(1)).head().path) for up in (True, False)}
    assert len(paths) == 1 and len(paths.pop()) == 3 * prefix_trie.ID
