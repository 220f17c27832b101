"""The training-data operators on small awkward tables, against brute force or exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, language, masked_lm, near_dup, packing, pieces, pii, quality, repeats, shards
from larkspur.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, part string"


def _docs(spark, n=120):
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    vocab = {"en": ["the", "of", "and", "house", "river", "walks", "green"], "fr": ["le", "été", "maison", "rivière", "marche", "vert"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        words = [rng.choice(vocab[lang]) + rng.choice(["", "s", "ly", "x", "q"]) for _ in range(rng.choice([3, 40, 80, 150]))]
        rows.append([i, " ".join(words), lang, f"s{i % 2}", 0, "k", "p"])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \n\t "
    rows[6][1] = "word " * 6000
    rows[7][2] = rows[8][3] = None
    rows[10][1] = rows[11][1] = rows[12][1] = rows[9][1]
    rows[13][1] = rows[9][1].replace(" ", "  ")
    long = " ".join(f"w{k}" for k in range(200))
    rows[20][1] = long
    rows[21][1] = long.replace("w100 ", "changed ")
    rows[22][1] = "start here " + " ".join(f"w{k}" for k in range(60, 130)) + " the end"
    rows[23][1] = "na " * 130
    rows[24][1] = "na " * 90 + "end"
    rows[25][1] = "12345"
    rows.append(list(rows[30]))
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_equal_regex():
    import pyarrow as pa

    texts = ["a b\x0b c", "", " x", "é\n漢字 \x1c", "y" * 50]
    w = W.words(next(W.blocks(pa.array(texts)))[2])
    got = [[] for _ in texts]
    for i in range(len(w.start)):
        got[w.doc[i]].append(w.text(i))
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_exact_dedup(spark, docs, empty):
    df, rows = docs
    out = exact_dedup.DigestIndex(spark).ingest(df).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = {}
    for key, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        want |= {r[0]: (keep, len(g), r[0] == keep, hashlib.sha256(key.encode()).hexdigest()) for r in g}
    assert all(want[r.doc_id] == (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.exact_dedup(df.where("doc_id < 60"), index).count()
    second = exact_dedup.exact_dedup(df, index)
    assert second.where("doc_id < 60").isEmpty() and first + second.count() == len(groups) and second.columns == df.columns
    assert exact_dedup.DigestIndex(spark).ingest(empty).isEmpty()


def test_exact_dedup_keeps_each_text_of_null_and_shared_ids(spark):
    rows = [(None, "a b", 1), (None, "c d", 2), (None, "c  d", 3), (None, "a b", 1), (7, "e", 4), (7, "f g", 5), (7, "f  g", 6), (8, "e", 7), (9, None, 8), (None, "h", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = [tuple(r) for r in exact_dedup.exact_dedup(df).collect()]
    assert sorted(got, key=lambda r: r[2]) == [rows[0], rows[2], rows[4], rows[6], rows[8], rows[9]]


def _shingles(text):
    w = text.split()
    n = max(1, len(w) - 4)
    out = {}
    for i in range(n):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def test_near_dup_classes_equal_brute_force(spark, docs, empty):
    df, rows = docs
    rng = random.Random(2)
    base = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    more = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(300)] = f"n{i}"
        more.append((1000 + i, " ".join(w), "en", "s", 0, "", ""))
    df, rows = df.union(spark.createDataFrame(more, SCHEMA)), rows + more
    texts = {r[0]: r[1] for r in rows if r[1] and r[1].split()}
    sets, root = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                i, j = sorted((find(ids[a]), find(ids[b])))
                root[j] = i
    got = {r.doc_id: r.class_id for r in near_dup.near_dup_classes(df, exhaustive=True).collect()}
    assert got == {r[0]: find(r[0]) if r[0] in texts else r[0] for r in rows}
    assert near_dup.near_dup_classes(empty).isEmpty()


def _edits_of_one_text():
    """Texts of which most pairs are a little less alike than 0.8, and twins above it that no leader is like."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(204)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.sample(range(5, 199, 6), 4):
            w[k] = f"n{i}"
        twin = list(w)
        twin[rng.choice([k for k in range(5, 199, 6) if w[k] == base[k]])] = "twin"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(twin))]
    return rows


def _like_pairs(rows, similarity=0.8):
    sets = {i: _shingles(t) for i, t in rows}
    for a in sets:
        for b in sets:
            both = sum(min(n, sets[b].get(k, 0)) for k, n in sets[a].items()) if a < b else 0
            if both and both >= similarity * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                yield a, b


def test_near_dup_finishes_large_buckets(spark):
    rows = _edits_of_one_text()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bucket = {r.doc_id: r.bands[0] for r in near_dup.signatures(df, "doc_id", "text", 1, 1).collect()}  # a few large buckets
    root, pairs = {i: i for i, _ in rows}, [(a, b) for a, b in _like_pairs(rows) if bucket[a] == bucket[b]]
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root.values())) > 30
    got = near_dup.near_dup_classes(df, bands=1, rows=1).collect()
    assert {r.doc_id: r.class_id for r in got} == root


def test_near_dup_deals_all_like_pairs_of_open_buckets_again(spark):
    rows = _edits_of_one_text()
    df = spark.createDataFrame(rows, "doc long, text string")
    sets = near_dup._shingle_sets(df)
    buckets = {}
    for r in near_dup._refined(df.withColumn("class", F.col("doc")), sets, 0.8).collect():
        buckets.setdefault(r.doc, {})[r.bucket] = r.rest
    met = {(a, b) for a in buckets for b in buckets if a < b and buckets[a].keys() & buckets[b].keys()}
    assert set(_like_pairs(rows)) <= met
    for a, b in _like_pairs(rows):  # at the first shingle in common, enough are left in both
        assert max(min(buckets[a][x], buckets[b][x]) for x in buckets[a].keys() & buckets[b].keys()) * 1.8 >= 0.8 * 400


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    row = np.concatenate([np.zeros(len(e), int), np.ones(800, int)])
    weight = np.ones(len(row), int)
    weight[:100] = 3
    s = near_dup.dart_minhash(row, np.concatenate([e, e[:800]]), weight, 2, 4000)
    assert abs((s[0] == s[1]).mean() - 800 / (len(e) + 200)) < 0.03


def test_language(spark, docs, empty):
    df, rows = docs
    train = df.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id % 5 <> 0")
    model = language.LanguageModel.fit(train)
    got = {r.doc_id: r for r in model.predict(df).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[25].lang_pred == "und" and got[3].score == 0
    judged = [r for r in rows if r[0] % 5 == 0 and r[0] > 25 and r[2]]
    assert all(got[r[0]].lang_pred == r[2] for r in judged) and all(0 <= g.score <= 1 for g in got.values())
    assert [r.lang_pred for r in language.LanguageModel.fit(empty).predict(df).limit(3).collect()] == ["und"] * 3
    assert model.predict(empty).isEmpty()


def test_forward_sums_all_segmentations():
    table, n = language.lookup(language.default_vocabulary())
    number = {p: i for i, p in enumerate(language.pieces(language.default_vocabulary()))}
    p = np.random.default_rng(1).dirichlet(np.ones(n + 1), 2)

    def total(s, q):
        return 1.0 if not s else sum(q[number[s[:k]]] * total(s[k:], q) for k in range(1, min(16, len(s)) + 1) if s[:k] in number) + (q[n] * total(s[1:], q) if s[0] not in number else 0)

    for word in ("house", "a", "\U0001f600x"):
        got = language.log_words([word], table, p)[0]
        assert np.allclose(got, [np.log(total("▁" + word, q)) for q in p])


def test_packing(spark, docs, empty):
    df, rows = docs
    ids = packing._Ids(packing.default_tokenizer())
    tokens = packing.token_pieces(df).collect()
    for r in rows[:30]:
        mine = sorted((t.piece, t.start, t.length) for t in tokens if t.doc_id == r[0])
        n = len(ids.tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
        assert sum(x[2] for x in mine) == n and [x[1] for x in mine] == list(range(0, n, packing.LENGTH))
    out = packing.pack(packing.token_pieces(df), part_rows=30).collect()
    assert len(out) == len(tokens)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert len(seqs) <= packing.lower_bound(np.array([r.length for r in out])) + 1
    assert packing.pack(packing.token_pieces(empty)).isEmpty()


def test_lower_bound_is_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        z = rng.integers(1, 2048, 60)
        assert packing.lower_bound(z) <= packing.best_fit_decreasing(z)[0].max() + 1
    assert packing.lower_bound(np.array([1025] * 10)) == 10


def test_pii_spans():
    cases = {
        "a@b.c, x@y": ["email:a@b.c"],
        "999.1.1.1 1.2.3.4": ["ip:1.2.3.4"],
        "4111 1111 1111 1111": ["card:4111 1111 1111 1111"],
        "+1 (988) 555-2485 +12": ["phone:+1 (988) 555-2485"],
    }
    for text, want in cases.items():
        assert [f"{pii.KINDS[k]}:{text[a:b]}" for k, a, b in pii.plain_spans(text)] == want
    hidden = {"joe (at) example (dot) com": "email", "jоe@exаmple.com": "email", "plus one five five five one two three four five six seven": "phone", "1 dot 2 dot 3 dot 4": "ip"}
    for text, kind in hidden.items():
        (k, a, b), = pii.added_spans(text, pii.plain_spans(text))
        assert pii.KINDS[k] == kind and (a, b) == (0, len(text))
    assert not pii.added_spans("look at the dot product", [])


def test_pii_masks_and_keeps_columns(spark, docs, empty):
    df, rows = docs
    more = df.withColumn("text", F.when(F.col("doc_id") == 1, "mail a@b.c now").otherwise(F.col("text")))
    got = {r.doc_id: r.text for r in pii.mask_pii(more).collect()}
    assert got[1] == "mail <EMAIL> now" and got[3] is None and got[20] == rows[20][1]
    assert pii.mask_pii(more).columns == df.columns and pii.find_pii(df).count() == len(rows) and pii.find_pii(empty).isEmpty()


def test_quality_counts_and_verdict(spark, docs, empty):
    df, rows = docs
    noise = [(5000 + i, " ".join(f"###{k}%%%" for k in range(80)), "en", "s0", 0, "", "") for i in range(2)]
    out = {r.doc_id: r for r in quality.judge(df.union(spark.createDataFrame(noise, SCHEMA)), least=10).collect()}
    assert len(out) == len({r[0] for r in rows}) + 2 and out[3].base_failed and out[6].base_failed
    assert not out[5000].kept and not out[5001].kept and not out[5000].base_failed
    clean = [r for r in rows if r[0] > 30 and len((r[1] or "").split()) >= 80]
    assert all(out[r[0]].kept for r in clean)
    assert quality.judge(empty).isEmpty()


def test_quality_judges_small_groups_and_moderate_junk(spark, docs):
    df, rows = docs
    words = lambda i, sign: " ".join(f"w{(i * 7 + k) % 97}{sign if k % 3 == 0 else 'x'}" for k in range(90))
    more = [(6000, words(1, "#"), "en", "s0", 0, "", ""), (6001, words(2, "#"), "en", "rare", 0, "", ""), (6002, words(3, "#"), "xx", "rare", 0, "", ""), (6003, words(4, "x"), "xx", "rare", 0, "", "")]
    out = {r.doc_id: r for r in quality.judge(df.union(spark.createDataFrame(more, SCHEMA)), least=40).collect()}
    assert not any(out[i].base_failed or out[i].kept for i in (6000, 6001, 6002)) and out[6003].kept
    few = quality.judge(df.where("doc_id BETWEEN 30 AND 40"), least=40).collect()
    assert all(r.distance is None for r in few) and all(r.kept != r.base_failed for r in few)


def test_repeats_equal_brute_force(spark, docs, empty):
    df, _ = docs
    rows = {r.doc_id: r.text or "" for r in df.collect()}
    first = {}
    for i in sorted(rows):
        w = rows[i].split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, t in rows.items():
        w = t.split()
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = repeats.without_repeats(df).collect()
    assert len(got) == df.count() and all(want[r.doc_id] == (r.n_words, r.n_removed, r.kept_text) for r in got)
    assert want[24][1] >= 90 and repeats.without_repeats(empty).isEmpty()


def test_shards(spark, docs, tmp_path):
    df, rows = docs
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    for k in range(5):
        store.append(df.where(F.col("doc_id") % 5 == k).coalesce(1))
    old = store.version()
    assert len(store.shards()) == 5 and store.compact() > old and len(store.shards()) < 5
    assert store.read().exceptAll(df).isEmpty() and df.exceptAll(store.read()).isEmpty() and store.read(old).count() == len(rows)
    with pytest.raises(shards.VersionTaken):
        store._commit(store.manifest(old), old)
    late = shards.ShardStore(spark, store.path, publish=lambda aside, name: store._published(aside, name.replace("v" + name[-8:], f"v{old:08d}")))
    before = store.shards(old)
    with pytest.raises(shards.VersionTaken):  # a writer that looks before another has committed, and makes its mark after
        late._commit(store.manifest(), store.version() + 1)
    assert store.shards(old) == before and len(store._fs.listStatus(store._path("manifest"))) == store.version()
    store.vacuum()
    assert store.read().count() == len(rows)


def test_pieces_round_trip_and_best_score(spark, docs, empty):
    df, rows = docs
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows)
    c = pieces.coder(pieces.default_model())

    def best(s):
        top = [0.0] + [-1e300] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                if s[i:j] in c.plain:
                    top[j] = max(top[j], top[i] + c.plain[s[i:j]][0])
            if s[j - 1] not in c.plain:
                top[j] = max(top[j], top[j - 1] + c.unknown)
        return top[-1]

    score = {i: s for s, i in c.plain.values()}
    for word in (" houses", " rivière", "   x"):
        assert sum(score[i] for i in c.best([word])[0]) == best(word)
    assert pieces.digest(empty).isEmpty()


def test_masked_model_beats_unigrams(spark, empty):
    rng = random.Random(4)
    text = lambda: " ".join(" ".join([a, a + "2", a + "3"]) for a in (f"v{rng.randrange(20)}" for _ in range(60)))
    df = spark.createDataFrame([(i, text()) for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string").coalesce(2)
    out = {r.doc_id: r for r in masked_lm.MaskedModel.fit(df, every=2).score(df).collect()}
    assert out[900].n_words == 0 and out[900].log_likelihood == 0 and out[901].mean_log_likelihood is None
    mean = sum(out[i].log_likelihood for i in range(200)) / sum(out[i].n_words for i in range(200))
    assert mean > -np.log(60) + 1
    assert masked_lm.MaskedModel.fit(empty).score(empty).isEmpty()
