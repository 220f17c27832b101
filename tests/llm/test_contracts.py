"""The queries' contracts against plain Python, and the pipeline's stages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import exact_dedup, language, masked_lm, near_dup, packing, pii, quality, repeats, shards
from larkspur.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, digest string"


def _rows():
    rng = random.Random(11)
    words = {"en": ["the", "of", "and", "house", "river", "walks", "green", "#tag", "a|b"], "de": ["der", "und", "haus", "fluß", "geht", "grün", "über"]}
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choice(words[lang]) + rng.choice(["", "", "x", "ly"]) for _ in range(rng.choice([5, 20, 30]))) for _ in range(4)]
        out.append([i, "\n".join(lines + lines[:1] * (i % 3 == 0)), lang, f"s{i % 2}", 0, 0.5, "x", "d"])
    out[3][1], out[4][1], out[5][1], out[6][1] = None, "", " \n\t\x0b ", "12 34"
    out[7][2] = out[8][3] = None
    out[10][1] = out[9][1].replace(" ", "  ")
    out[11][1] = out[9][1]
    out[12][1] = "word " * 6000 + "mail a@b.co"
    out[13][1] += " call +1 (988) 555-2485 or 10.0.0.1 or card 4111 1111 1111 1111"
    out[14][0] = out[15][0] = None
    out.append(list(out[20]))
    long = " ".join(f"w{k}" for k in range(300))
    out[21][1], out[22][1] = long, long.replace("w150 ", "other ")
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and pii.luhn("".join(c for c in m if c.isdigit()))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
}


def _base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m.group())]


def test_plain_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a@.1 2+-(3)09b%4") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["é 1.2.3.4 ü +1 988 555 2485", "4111-1111-1111-1111", "x@y.z@w.v", None, ""]
    for t in texts:
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.plain_spans(t or "")] == _base(t or ""), t
    df = spark.createDataFrame(list(enumerate(texts[-200:])), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        want = _base(texts[len(texts) - 200 + r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(r.spans.split(","))


def test_disguises():
    for text, kind in {
        "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦": "email", "juan arroba correo punto es": "email", "j o h n @ e x a m p l e . c o m": "email", "bob(a)site.org": "email",
        "one nine two dot one six eight dot zero dot 1": "ip", "+1 five five five 123 four five six seven": "phone", "4111 1111 1111 one one one one": "card", "jóhn@exámple.com": "email",
    }.items():
        ((k, a, b),) = pii.added_spans(text, pii.plain_spans(text))
        assert (pii.KINDS[k], a, b) == (kind, 0, len(text))


def test_quality_counts_equal_plain_python(spark, docs, rows, empty):
    got = defaultdict(list)
    for r in quality.judge(docs).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    want = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        n = len(words)
        want[r[0]].append((n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), n < 50 or 100 * len(again) > 50 * n))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_ids_equal_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(list)
    for r in packing.token_pieces(docs.where("doc_id IS NOT NULL")).dropDuplicates(["doc_id", "piece"]).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for r in rows:
        if r[0] is not None:
            ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
            want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
            assert sorted(got[r[0]]) == want


def test_known_words_survive_a_full_table():
    import pyarrow as pa

    told, lists = [], W.IdLists()

    def learn(new):
        told.extend(new)
        lists.add(np.array([len(x) for x in new]), np.frombuffer("".join(new).encode(), np.uint8).astype(np.uint32))

    number = W.WordRows(learn, lists.keep, limit=50)
    rng = random.Random(2)
    for k in range(40):
        words = [f"often{j}" for j in range(10)] + [f"x{rng.random()}" for _ in range(15)]
        w = W.words(next(W.blocks(pa.array([" ".join(words)])))[2])
        flat, n = lists(number(w))
        assert bytes(flat.astype(np.uint8)).decode() == "".join(words) and n.tolist() == list(map(len, words))
        assert len(number.keys) <= 75
    assert Counter(told)["often3"] == 1


def test_expected_counts_equal_all_segmentations():
    voc = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    table, rng = language.Lookup(voc), np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(voc) + 1), 2)

    def cuts(s):
        if not s:
            yield []
        for n in range(1, len(s) + 1):
            if s[:n] in voc or n == 1:
                yield from ([voc.index(s[:n]) if s[:n] in voc else len(voc), *rest] for rest in cuts(s[n:]))

    words, counts = ["abc", "cab", "xabca", "abcabcabcabc"], np.array([[1, 2], [3, 1], [1, 1], [2, 5]], float)
    want = np.zeros_like(p)
    for word, c in zip(words, counts):
        for g in range(2):
            each = [(x, np.prod(p[g][x])) for x in cuts("▁" + word)]
            for x, v in each:
                np.add.at(want[g], x, c[g] * v / sum(v for _, v in each))
    assert np.allclose(language.expected(words, counts, table, p), want)
    assert np.isfinite(language.expected(["abc" * 3000], np.ones((1, 2)), table, p)).all()


def test_masked_net_gradient_and_sum():
    rng = np.random.default_rng(1)
    c = masked_lm.CLASSES
    flat = rng.normal(0, 0.3, masked_lm.Net.size())
    near, target = rng.integers(0, c * c + 1, (7, 4)), rng.integers(0, c * c, 7)
    net = masked_lm.Net(flat.copy())
    every = np.arange(c * c)
    assert np.isclose(np.exp(net.log_prob(np.repeat(near[:1], len(every), 0), every)).sum(), 1)
    past = masked_lm.Net(np.zeros_like(flat))
    masked_lm.Net(flat.copy()).step(near, target, past, 0.1)
    moved = np.flatnonzero(past.flat)
    for i in rng.choice(moved, 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (masked_lm.Net(up).log_prob(near, target).mean() - masked_lm.Net(down).log_prob(near, target).mean()) / 2e-5
        assert np.isclose(slope**2, past.flat[i], rtol=1e-3, atol=1e-10)


def test_rare_words_have_their_own_probability(spark, docs):
    model = masked_lm.MaskedModel.fit(docs, vocabulary=5)
    counts = {r.word: r.n for r in model.counts.collect()}
    top = sorted(counts, key=lambda k: (-counts[k], k))[:5]
    assert set(np.array(top).astype(np.int64).view(np.uint64)) == set(model.known) and model.rare == sum(counts.values()) - sum(counts[k] for k in top)
    base = {(r.doc_id, r.n_words): r.log_likelihood for r in model.score(docs).collect()}
    more = masked_lm.MaskedModel(model.known, model.ids, model.flat, model.counts.withColumn("n", F.col("n") * 2), model.rare)
    for r in more.score(docs).collect():  # doubled counts: log 2 for each rare word
        assert r.log_likelihood - base[r.doc_id, r.n_words] >= -1e-9


def test_a_batch_may_run_again(spark, docs, rows):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    half = docs.where("doc_id < 30 OR doc_id IS NULL")
    first = sorted(map(str, index.ingest(half, batch="a").collect()))
    assert sorted(map(str, index.ingest(half, batch="a").collect())) == first
    kept = exact_dedup.exact_dedup(half, index, batch="a").count()
    assert kept == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows if r[0] is None or r[0] < 30})
    later = index.ingest(docs, batch="b").collect()
    assert sum(r.kept for r in later) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}) - kept
    n = index.table().count()
    index.compact()
    assert index.table().count() == n and len(index.table().inputFiles()) <= 3
    assert sorted(map(str, index.ingest(half, batch="a").collect())) == first
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_hot_digests_join_like_the_others(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(3000)]
    out = {r.doc_id: r for r in exact_dedup.DigestIndex(spark).ingest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(out) == 3000 and all(out[i].group_size == (2000 if i % 3 else 1) and out[i].kept == (i % 3 == 0 or i == 1) for i in range(3000))


def test_text_ids(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(f"id-{i:03d}", " ".join(rng.sample(words, 120))) for i in range(20)]
    rows += [("id-100", rows[3][1] + " tail"), ("id-101", rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_dup_classes(df).collect()}
    assert got["id-100"] == "id-003" and got["id-101"] == "id-004" and sum(k != v for k, v in got.items()) == 2
    cut = {r.doc_id: r.n_removed for r in repeats.without_repeats(df).collect()}
    assert cut["id-100"] == 120 and cut["id-101"] == 120 and cut["id-003"] == 0


def test_near_copies_default_equals_brute_force(spark):
    """Variants of one text around the similarity: what the registered query runs."""
    rng = random.Random(21)
    base, rows = [f"b{k}" for k in range(200)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([2, 5, 9, 14])):
            w[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = [Counter(tuple(t.split()[k : k + 5]) for k in range(196)) for _, t in rows]
    label = list(range(90))
    for a in range(90):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    got = {r.doc_id: r.class_id for r in near_dup.near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=4).collect()}
    assert [got[i] for i in range(90)] == label


def test_pipeline_stages(spark, docs, rows, empty):
    columns = docs.columns
    language_kept = corpus_pipeline.keep_known_language(spark, docs, "")
    assert language_kept.columns == columns and {3, 4, 5, 6}.isdisjoint({r.doc_id for r in language_kept.collect()})
    clean = {r[0] for r in rows if r[0] is not None and r[0] > 22}
    assert clean <= {r.doc_id for r in language_kept.collect()}
    exact = corpus_pipeline.drop_exact_copies(spark, language_kept, "")
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in language_kept.collect()]
    assert exact.columns == columns and exact.count() == len(set(texts))
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert near.columns == columns and 21 in {r.doc_id for r in near.collect()} and 22 not in {r.doc_id for r in near.collect()}
    masked = corpus_pipeline.mask_personal_data(spark, near, "")
    got = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns and got[13].text.endswith("call <PHONE> or <IP> or card <CARD>") and got[12].text.endswith("<EMAIL>")
    assert all(r.n_chars == len(r.text) for r in got.values())
    packed = corpus_pipeline.pack_sequences(spark, masked, "").collect()
    assert {r.doc_id for r in packed} == set(got)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.LENGTH
    whole = packing.certified(spark.createDataFrame(packed)).head()
    assert whole.sequences == len(fill) and whole.bound == packing.lower_bound(np.array([r.length for r in packed])) and whole.gap == whole.sequences - whole.bound
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.isEmpty() and (name == "packing" or out.columns == columns)


def test_sharding_query_returns_every_row(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = shards.op6_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in out) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest() if r.text is not None else None) for r in docs.collect())


def test_masked_net_of_whole_texts_equals_the_net_of_windows():
    rng = np.random.default_rng(5)
    c = masked_lm.CLASSES
    flat = rng.normal(0, 0.3, masked_lm.Net.size())
    ids = rng.integers(0, c * c, 60)
    ids[[0, 1, 20, 21, 40, 41, 58, 59]] = c * c  # missing words around three texts
    on = np.array([i for i in range(2, 58) if ids[i] != c * c]) - 2
    near = np.stack([ids[on + 2 + o] for o in (-2, -1, 1, 2)], 1)
    net = masked_lm.Net(flat.copy())
    assert np.allclose(net.log_prob_of(net.hidden_of(ids)[on], ids[on + 2]), net.log_prob(near, ids[on + 2]))
    a, b, past_a, past_b = (masked_lm.Net(x) for x in (flat.copy(), flat.copy(), np.zeros_like(flat), np.zeros_like(flat)))
    a.step(near, ids[on + 2], past_a, 0.1)
    b.step_of(ids, on, past_b, 0.1)
    assert np.allclose(past_a.flat, past_b.flat, rtol=1e-4, atol=1e-10)
    sure = past_a.flat > 1e-8  # where a gradient is nearly 0 its rounding decides the step
    assert np.allclose(a.flat[sure], b.flat[sure], atol=1e-4)


def test_members_of_a_hub_meet_it_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(words[: 100 + i % 20] + [f"x{rng.random()}"] * (i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dup._shingle_sets(df.select(F.col("doc_id").alias("doc"), "text"))
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, 59) for i in range(1, 50)], "a long, b long")
    want = sorted(map(tuple, near_dup._similar(pairs, sets).collect()))
    for few in (10, 0):
        monkeypatch.setattr(near_dup, "CROWD", 7)
        monkeypatch.setattr(near_dup, "FEW", few)
        assert sorted(map(tuple, near_dup._similar(pairs, sets).collect())) == want and len(want) == 108


def test_a_text_without_blanks_takes_bounded_steps():
    import time

    table, n = language.lookup(language.default_vocabulary())
    p = np.random.default_rng(1).dirichlet(np.ones(n + 1), 4)
    run = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(200_000))
    began = time.time()
    got = language.log_words(["ab", run, "c"], table, p)
    assert time.time() - began < 30 and np.isfinite(got).all()
    cut = language.log_words([run[i : i + language.MOST] for i in range(0, len(run), language.MOST)], table, p)
    assert np.allclose(got[1], cut.sum(0)) and np.allclose(got[0], language.log_words(["ab"], table, p)[0])
    assert np.allclose(language.expected(["ab" * 300], np.ones((1, 4)), table, p), language.expected(["ab" * 128, "ab" * 128, "ab" * 44], np.ones((3, 4)), table, p))
