"""Quality classifier, toxicity and SimHash: planted cases, brute force, edge cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from convrec.llm import quality, simhash, toxicity
from convrec.llm.components import smallest_reachable

WORDS = ["stone", "river", "light", "garden", "window", "paper", "music", "winter", "bridge", "market", "silver", "forest"]


def corpus(n=300, seed=1):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[j] + "aeiou"[rng.integers(5)] for j in rng.integers(0, len(WORDS), rng.integers(20, 60))]
        good, toxic = i % 4 != 0, i % 5 == 0
        if not good:
            words = [w + "%%%" for w in words]
        if toxic:
            for k in rng.integers(0, len(words), 4):
                words[k] = "grumbelf" + "oaei"[rng.integers(4)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(ws):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, " \t\n"), (None, "no id"), (7, docs[7][1]), (9004, "stonea " * 30000)]
    d = ws.createDataFrame(docs + extra, "doc_id bigint, text string").withColumns({"score": F.lit("clash"), "evidence": F.lit(1), "label": F.lit("x")})
    lab = ws.createDataFrame(labels + [(5, None, None), (3, 1, 0), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return d, lab, {i: (q, t) for i, q, t in labels}


def test_quality_held_out_accuracy_and_edges(ws, labelled):
    docs, labels, truth = labelled
    model = quality.fit(docs, labels, "quality", parts=5, rest=0)
    out = quality.score_texts(docs, model)
    assert out.columns[-1] == "score" and out.count() == docs.count()
    rows = out.select("doc_id", "text", "score").collect()
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30
    assert np.mean([(r["score"] >= 0.3) == bool(truth[r["doc_id"]][0]) for r in held]) > 0.95
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[9001] == by[9002] == by[9003] and all(0 <= r["score"] <= 1 for r in rows)
    assert len([r for r in rows if r["doc_id"] == 7]) == 2


def test_quality_features_equal_a_plain_loop():
    texts = ["Ab  cd cd\nü", "", " x ", "one one one"]
    got = defaultdict(int)
    for b, w in zip(*quality.hashed_features(texts, (3,), 20)):
        got[w] += 1
    for i, t in enumerate(texts):
        words = t.split()
        assert got[i] == sum(1 + len(w) for w in words) - 0, (t, got[i])  # word or repeat, and len(w) windows of 3 over " w "


def test_quality_without_training_rows(ws):
    docs = ws.createDataFrame([(1, "a")], "doc_id bigint, text string")
    labels = ws.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.score_texts(docs, quality.fit(docs, labels)).first()["score"] == 0.5
    empty = docs.filter("false")
    assert quality.score_texts(empty, quality.fit(empty, labels)).count() == 0
    assert toxicity.score_texts(docs, toxicity.fit(docs, labels)).first()["score"] == 0.5


def test_toxicity_held_out_accuracy_and_evidence(ws, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels, "toxic", parts=4, rest=2)
    rows = toxicity.score_texts(docs, model).select("doc_id", "score", "evidence").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.3) == bool(truth[r["doc_id"]][1]) for r in held]) > 0.95
    for r in rows:
        assert 0 <= r["score"] <= 1
        cos = [e["cosine"] for e in r["evidence"]]
        assert cos == sorted(cos, reverse=True)
        assert all(zlib.crc32(e["id"].encode()) % 4 != 2 for e in r["evidence"])


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 7), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt(w @ w)))
    vectors += vectors[:40]  # ties
    index = toxicity.BlockMaxIndex.build(vectors, 60, block=16)
    dense = np.zeros((len(vectors), 60))
    for r, (t, w) in enumerate(vectors):
        dense[r, t] = w
    for q in range(0, 740, 7):
        cos = dense @ dense[q]
        cos[q] = 0
        want = [r for r in np.lexsort((np.arange(len(cos)), -cos.round(12)))[:15] if cos[r] > 0]
        rows, found = index.nearest(*vectors[q], 15, skip=q)
        assert rows.tolist() == want and np.allclose(found, cos[want])


def test_toxicity_searches_more_than_two_thousand_examples(ws):
    rng = np.random.default_rng(5)
    texts = [" ".join(WORDS[j] + "aeiou"[rng.integers(5)] for j in rng.integers(0, len(WORDS), 6)) for _ in range(8000)]
    texts = [t + (" grumbel" if i % 2 else " thanks") for i, t in enumerate(texts)]
    docs = ws.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = ws.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.index.examples > 2000


def test_block_max_searches_together_equal_single_searches():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.unique(np.minimum(rng.zipf(1.3, rng.integers(5, 40)), 3000) - 1)
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex.build(vectors, 3000, block=16)
    dense = np.zeros((500, 3000))
    for r, (t, w) in enumerate(vectors):
        dense[r, t] = w
    for q, (rows, cos) in enumerate(index.nearest_many(vectors, 9, range(500))):
        all_cos = dense @ dense[q]
        all_cos[q] = 0
        want = [r for r in np.lexsort((np.arange(500), -all_cos.round(12)))[:9] if all_cos[r] > 0]
        assert rows.tolist() == want and np.allclose(cos, all_cos[want])


def test_toxicity_cosine_is_taken_over_all_terms(ws, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels, "toxic", parts=4, rest=2)
    assert {int(i) for i in model.ids} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {str(r["doc_id"]): r["text"] for r in docs.collect() if r["doc_id"] is not None and r["text"]}
    n = {t: sum(t in set(toxicity.text_terms(x)) for x in [*texts.values(), texts["7"], "no id"]) for t in model.vocabulary}
    rows = docs.count()
    assert set(model.vocabulary) == {t for i in model.ids for t in toxicity.text_terms(texts[i])}

    def vector(text):
        tf = defaultdict(int)
        for t in toxicity.text_terms(text):
            if t in model.vocabulary:
                tf[t] += 1
        w = {t: (1 + np.log(c)) * (np.log((rows + 1) / (n[t] + 1)) + 1) for t, c in tf.items()}
        length = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    shown = {r["doc_id"]: r["evidence"] for r in toxicity.score_texts(docs, model).collect()}
    plain = {i: vector(texts[i]) for i in model.ids}
    for i in (1, 2, 6, 9, 14, 30):  # clean and toxic, held out and not
        q = vector(texts[str(i)])
        cos = sorted((sum(x * v.get(t, 0.0) for t, x in q.items()) for v in plain.values()), reverse=True)
        assert np.allclose([e["cosine"] for e in shown[i]], cos[:3])


def test_terms_are_found_like_in_a_split_text():
    terms = ["loser", "grum-", "grumb-", "one", "two"]
    m = toxicity.ToxicityModel({t: i for i, t in enumerate(terms)}, np.ones(5), toxicity.BlockMaxIndex.build([], 0), [], np.zeros(0), 0.0, 5)
    text = "Loser losers, grumbel GRUM one-two 2one one2 twos two"
    plain = defaultdict(int)
    for t in toxicity.text_terms(text):
        if t in m.vocabulary:
            plain[m.vocabulary[t]] += 1
    assert m.term_frequencies(text) == dict(plain)


def plain_fingerprint(text, n=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_equal_spark_hashes_and_plain_loop(ws):
    texts = ["", " \t", "One two", "a b c d", "A B c d e f É ü x", "w " * 5000, "a b c d a b c d"]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)
    h = ws.sql("SELECT xxhash64('a b c d') AS h").first()["h"]
    assert simhash.fingerprint("A b C d") == h


def test_gray_index_finds_all_pairs_of_a_group():
    rng = np.random.default_rng(0)
    codes = []
    for b in rng.integers(0, 2**63, 60, dtype=np.int64).tolist():
        for _ in range(8):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            codes.append(x)
    codes = np.unique(np.array(codes, np.uint64))
    group = np.sort(rng.integers(0, 3, len(codes)))
    codes = codes[np.lexsort((simhash.gray_rank(codes), group))]
    got = {(int(a), int(b)) for q, e in simhash.GrayIndex(group, codes).search(codes, group, 4, width=500) for a, b in zip(q, e)}
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 4) & (group[:, None] == group[None])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("chunk", [1024, 3])
def test_links_give_the_components_of_all_near_pairs(ws, chunk):
    rng = np.random.default_rng(1)
    codes = {0, 1, 3}
    for b in rng.integers(0, 2**62, 40, dtype=np.int64).tolist():
        for _ in range(6):
            b ^= sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 4)))
            codes.add(b)
    codes = np.array(sorted(codes), np.uint64)
    label = np.arange(len(codes))
    label = simhash.merge_labels(label, *np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 4))
    signed = codes.view(np.int64)
    groups = defaultdict(list)
    for c, at in zip(signed.tolist(), label):
        groups[at].append(c)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    fps = ws.createDataFrame([(c,) for c in signed.tolist()], "fp bigint")
    got = {r["node"]: r["root"] for r in smallest_reachable(simhash.links(fps, 4, chunk)).collect()}
    assert got == want


def test_near_duplicates_edges(ws):
    base = " ".join(f"word{i}" for i in range(6000))
    rows = [(5, base), (2, base.upper()), (9, base.replace("word200 ", "")), (1, None), (3, ""), (4, "something else entirely here"), (None, base), (5, base)]
    df = ws.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "id": F.lit(0), "component_id": F.lit(None)})
    out = [(r["id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(5, 2), (2, 2), (9, 2), (1, 1), (3, 1), (4, 4), (None, 2), (5, 2)], key=str)
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def test_toxicity_examples_stand_for_all_training_rows(ws):
    """More labels than the sample holds, one in ten toxic: the weighted share of toxic examples is
    that of the training rows."""
    n = 6000
    docs = ws.createDataFrame([(i, f"word{i % 50} other{i % 7} " + ("nasty" if i % 10 == 0 else "nice")) for i in range(n)], "doc_id bigint, text string")
    labels = ws.createDataFrame([(i, int(i % 10 == 0)) for i in range(n)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, per_class=300, max_examples=300)
    assert len(model.ids) == 300 and 100 < model.labels.sum() < 200  # the sample's even mix
    share = float((model.importance * model.labels).sum() / model.importance.sum())
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert abs(share - sum(i % 10 == 0 for i in train) / len(train)) < 0.01


def test_toxicity_index_is_made_in_little_more_memory_than_it_takes():
    """Workers share an executor's memory: making the index must not hold several copies of all entries."""
    import pickle
    import tracemalloc

    from convrec.llm.toxicity import BlockMaxIndex, ToxicityModel, unit

    rng = np.random.default_rng(5)
    terms, examples = 3000, 4000
    counts = []
    for _ in range(examples):
        t = np.unique((terms * rng.random(150) ** 3).astype(np.int32))
        counts.append((t, rng.integers(1, 5, len(t)).astype(np.int32)))
    idf = rng.random(terms) + 1
    vectors = [unit(t, n.astype(float), idf) for t, n in counts]
    index = BlockMaxIndex.build(vectors, terms)
    model = ToxicityModel({f"t{i:05d}": i for i in range(terms)}, idf, index, list(range(examples)), np.zeros(examples), 0.5, 15, counts=counts)
    packed = pickle.dumps(model)
    tracemalloc.start()
    read = pickle.loads(packed)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 1.3 * size
    for name in ("row", "weight", "start", "column", "dense", "bound"):  # (norms are summed in another order)
        assert np.allclose(getattr(read.index, name), getattr(index, name), atol=1e-7)
    dense = np.zeros((examples, terms))
    for r, (t, w) in enumerate(vectors):
        dense[r, t] = w
    for q in range(0, 40, 4):
        cos = dense @ dense[q]
        best = np.lexsort((np.arange(examples), -cos.round(12)))[:15]
        rows, found = read.index.nearest(*vectors[q], 15)
        assert rows.tolist() == best.tolist() and np.allclose(found, cos[best])


def test_toxicity_document_frequencies_and_letters():
    from convrec.llm.toxicity import _LETTERS, ToxicityModel, BlockMaxIndex, text_terms, text_words

    texts = ["Élan vital, élan; elanvital elanvitality 12x", "", "ǅ 𝒜𝒷 x_y İstanbul ßtraße", "élan ퟿日本語 ٣abc", "..."]
    for t in texts:
        assert text_words(t) == _LETTERS.findall(t.lower())
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in texts for t in text_terms(x)}))}
    model = ToxicityModel(vocabulary, np.ones(len(vocabulary)), BlockMaxIndex.build([], 0), [], np.zeros(0), 0.0, 5)
    df = model.document_frequencies(texts)
    assert df.tolist() == [sum(t in set(text_terms(x)) for x in texts) for t in vocabulary]
    assert model.document_frequencies(["", "."]).sum() == 0 and len(model.frequencies(["", "."])[0][0]) == 0
    for x, (ids, n) in zip(texts, model.frequencies(texts)):
        assert dict(zip(ids.tolist(), n.tolist())) == {vocabulary[t]: list(text_terms(x)).count(t) for t in text_terms(x)}


def test_worker_keeps_one_operators_words():
    import public_tokenizers

    from convrec.llm import bpe, common, toxicity

    first = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.encoder(first.path) is first
    words = toxicity.shared_words(__import__("zlib").compress(b"a\nb"))
    assert words.vocabulary == {"a": 0, "b": 1} and not common._KEPT


def test_toxicity_scores_from_written_terms(ws, labelled):
    """The terms found for the document frequencies are written once and serve the search as well."""
    docs, labels, *_ = labelled
    extra = ws.createDataFrame([(None, None), (7, ""), (7, "Ünïque 日本 x"), (None, "again again")], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    model, counted = toxicity.fit_and_count(docs, labels, "toxic", parts=4, rest=2, keep=["doc_id"])

    def rows(df):
        found = df.select("doc_id", "score", "evidence").collect()
        return sorted(found, key=lambda r: (r.doc_id is None, r.doc_id, r.score, str(r.evidence)))

    assert rows(toxicity.score_counted(counted, model)) == rows(toxicity.score_texts(docs, model, keep=["doc_id"]))
    assert np.array_equal(toxicity.fit(docs, labels, "toxic", parts=4, rest=2).idf, model.idf)
    assert toxicity.fit_and_count(docs, labels.limit(0), "toxic", keep=["doc_id"])[1] is None
