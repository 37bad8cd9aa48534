"""Mixing, URL filter, HTML extraction, BPE, token files, vector searches and the pipeline."""

import hashlib
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convrec.llm import bpe, token_files
from convrec.llm.exact_topk import BitSlices, top_products
from convrec.llm.html_extract import blocks, extract_text, path_key, style_tree
from convrec.llm.mixing import repeat_rows, sample_mix, source_targets, word_count
from convrec.llm.nn_descent import nearest_products
from convrec.llm.url_filter import judge_urls

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
TEXTS = [
    "Hello  <|endoftext|> World x", "", "   ", "a<|endoftext|>b <|startoftext|><|", "<|ENDOFTEXT|>", "'S 'LL don't we'Ve", "aaaaaaaa banana",
    "é ́x ΑΣ İI ß ﬁ ½ ² 12_3", "\x1cab\x1f c\x85d\xa0e", "日本語 x", "word " * 4000, "a\x00b", None,
]


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, again and again, with those above their cap fixed at it."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 2, None: 50}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets_equal_repeated_resharing(ws, sizes):
    df = ws.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(df, (1, 2, 3)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-5 for s in want)


def test_mix_meets_targets_with_a_hot_source_and_edges(ws):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", 10 + i % 50) for i in range(6000)]
    rows += [(70_000, None, 40), (70_001, None, 0), (70_002, "s1", None), (4, "s4", 14)]
    df = ws.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumns({"target": F.lit("clash"), "epochs": F.lit(-1)})
    out = sample_mix(df, bins=64)
    got = [tuple(r) for r in out.select("doc_id", "source", "size", "source_size", "target", "epochs").collect()]
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted((tuple(r) for r in sample_mix(df.repartition(5), bins=64).select("doc_id", "source", "size", "source_size", "target", "epochs").collect()), key=str)
    by = {}
    for _, s, n, total, target, e in got:
        assert 0 <= e <= 3
        t = by.setdefault(s, [0, total, target])
        t[0] += (n or 0) * e
    for s, (taken, total, target) in by.items():
        assert abs(taken - target) <= 60 and target <= 3 * total, s
    assert sum(v[1] for v in by.values()) == sum(r[2] or 0 for r in rows)
    mixed = repeat_rows(out, ["doc_id", "source", "size"])
    assert mixed.count() == sum(r[5] for r in got)
    assert sample_mix(df.filter("false")).count() == 0


def test_word_count(ws):
    df = ws.createDataFrame([("a b\u00a0c  d\n",), ("",), (None,), ("\t",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [3, 0, 0, 0]


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_url_rules_and_edges(ws):
    urls = {
        1: ("http://A.example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
        2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("x://b.com/q#f", "b.com", "/q", "com/", "allow"),
        4: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        5: ("http://n.net/fr/2://x", "n.net", "/fr/2://x", "net/fr/", "block"),
        6: ("http://com", "com", "", None, None),
        7: ("http://c.com#x/", "c.com", "", None, None),
        8: (None, "", "", None, None),
        9: ("no scheme", "", "", None, None),
        10: ("http://Ünet.NET/ES/", "Ünet.net", "/ES/", None, None),
    }
    df = ws.createDataFrame([(k, v[0]) for k, v in urls.items()] + [(1, urls[1][0])], "page_id bigint, url string").withColumns({"host": F.lit("x"), "rule": F.lit(1)})
    out = judge_urls(df, RULES).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        _, host, path, rule, verdict = urls[r["id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert judge_urls(df.filter("false"), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df.filter("page_id > 7"), RULES, default="block").collect()} == {"block"}


def test_url_model_prefers_the_class_a_url_looks_like(ws):
    rows = [(i, f"http://good{i % 9}.com/news/{i}") for i in range(200)] + [(1000 + i, f"http://spam{i % 9}.net/fr/win{i}") for i in range(200)]
    rows += [(5000, "http://good3.org/news/77"), (5001, "http://spam4.org/fr/win88")]
    got = {r["id"]: r["verdict"] for r in judge_urls(ws.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html_blocks_and_frame_by_meaning(ws):
    body = (
        "<header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad-box ad'>Buy</div><!-- c --><article><h1>T&amp;t &#60;b&#62;</h1>"
        "<p><b>One <i>two</i>\n three<br><p>four&nbsp;five<ul><li>x<li>y</ul><div class=comments>me too</div><form>f<p>g</form></article>"
        "<aside>side</aside><div id=cookie-notice>cookies</div><footer>&copy; f"
    )
    rows = [(1, "http://h.com/1", page(body)), (2, None, None), (3, "http://h.com/3", ""), (4, "u", "plain &lt;text"), (1, "http://h.com/1", page(body))]
    rows.append((5, "http://h.com/5", page("<article>" + "<p>long words</p>" * 20000 + "</article>")[:-24]))
    df = ws.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["id"]: r["text"] for r in extract_text(df).collect()}
    assert got[1] == "T&t <b>\nOne two three\nfour five\nx\ny"
    assert got[2] == got[3] == "" and got[4] == "plain <text"
    assert got[5] == "\n".join(["long words"] * 20000)
    assert extract_text(df).count() == 6 and extract_text(df.filter("false")).count() == 0


def test_style_tree_cuts_what_a_host_repeats(ws):
    """A block without any telling name, the same on every page of a host, goes; the text that
    differs stays; a host of one page, or of copies of one page, keeps all."""
    body = "<div class=a><p>Follow us everywhere</p></div><div class=b><p>Story number {} is about {}</p></div>"
    rows = [(i, f"http://site.com/{i}", page(body.format(i, "x" * i))) for i in range(12)]
    rows += [(100, "http://one.com/", page(body.format(1, "y")))] + [(200 + i, f"http://copy.com/{i}", page(body.format(2, "z"))) for i in range(9)]
    got = {r["id"]: r["text"] for r in extract_text(ws.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} is about {'x' * i}".strip() for i in range(12))
    assert got[100].startswith("Follow us") and all(got[200 + i].startswith("Follow us") for i in range(9))


def texts_of(ws, rows):
    return {r["id"]: r["text"] for r in extract_text(ws.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_measured_importance_decides_in_articles_and_outvotes_hints(ws):
    body = "<article><h1>Title {0}</h1><p>Story {0}</p><div>Pass it on to friends</div></article><div class=share-price><p>{1}</p></div><div class=comments><p>Me {0}</p></div>"
    rows = [(i, f"http://site.com/{i}", page(body.format(i, f"Price of day {i}"))) for i in range(12)]
    rows += [(100 + i, f"http://same.com/{i}", page(body.format(i, "Our shares"))) for i in range(12)]
    rows += [(200 + i, f"http://few.com/{i}", page(body.format(i, f"Price of day {i}"))) for i in range(3)]
    got = texts_of(ws, rows)
    assert all(got[i] == f"Title {i}\nStory {i}\nPrice of day {i}" for i in range(12))
    assert all(got[100 + i] == f"Title {i}\nStory {i}" for i in range(12))
    assert all(got[200 + i] == f"Title {i}\nStory {i}\nPass it on to friends" for i in range(3))


def test_a_wrapper_named_after_a_layout_keeps_its_article(ws):
    names = ["has-sidebar", "with-sidebar", "no-sidebar", "search-results", "share-price", "banner-layout", "response-text"]
    rows = [(i, f"http://h{i}.com/", page(f"<div id=page class={n}><article><p>Whole story</p></article></div>")) for i, n in enumerate(names)]
    rows += [(100 + i, f"http://m{i}.com/", page(f"<div class={n}><p>Long story of a page</p></div><p>end</p>")) for i, n in enumerate(names)]
    rows.append((200, "http://c.com/", page("<main><p>Text</p></main><div class=comments><article>Me too</article></div><div class=main-sidebar>x</div>")))
    rows.append((201, "http://d.com/", page("<div class=sidebar><main><p>Text</p></main></div>")))
    got = texts_of(ws, rows)
    assert all(got[i] == "Whole story" and got[100 + i] == "Long story of a page\nend" for i in range(len(names)))
    assert got[200] == got[201] == "Text"


def test_look_is_the_sequence_of_child_elements(ws):
    kids = ["<hr>", "<table></table>", "<ul></ul>", "<div class=x></div>"]
    rows = [("h", page(f"<section>Same{kids[i]}</section><p>{i}</p>")) for i in range(4)] + [("g", page(f"<section>Same<hr></section><p>{i}</p>")) for i in range(4)]
    tree = {(r["host"], r["path"]): r for r in style_tree(ws.createDataFrame(rows, "host string, html string")).collect()}
    look = {h: tree[h, path_key("/html/body/section")]["look"] for h in "hg"}
    assert abs(look["h"] - 1) < 1e-9 and look["g"] == 0 and tree["h", path_key("/html/body/section")]["content"] == 0


def test_blocks_survive_broken_markup():
    for t in ("<", "<p", "<p class='x", "</p></div>", "<!-- open", "<script>never closed", "a < b > c", "<a href=\"x>y", "<p/><div></p>x"):
        blocks(t)
    assert blocks("a < b")[0][1] == "a < b"


def test_bpe_equals_the_library(ws):
    lib = Tokenizer.from_file(PATH)
    df = ws.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({"ids": F.lit("x"), "id": F.lit(0)})
    for r in bpe.round_trip(df, PATH).collect():
        e = lib.encode(TEXTS[r["id"]] or "", add_special_tokens=False)
        back = lib.decode(e.ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(e.ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    enc = bpe.encode_documents(df, PATH)
    assert {r["id"]: r["text"] for r in bpe.decode_documents(enc, PATH).collect()}[5] == lib.decode(lib.encode(TEXTS[5], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(df.filter("false"), PATH).count() == 0


def test_bpe_random_texts_and_small_cache():
    lib, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH, cache=40)
    rng = np.random.default_rng(4)
    letters = list("abcdeé'sStTθΣ012 ½_-%$#üßÿñ\n\t <|>­²")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(400)]
    for part in (texts[:150], texts[100:300], texts):
        for t, ids in zip(part, bpe.encode_texts(own, part)):
            assert ids == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 9000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.zeros(n, np.int64), rng.integers(0, 65536, n), np.resize([65535, 0, 7], n), rng.zipf(1.3, n) % 49408, rng.integers(0, 3, n) * 32767):
        coded = token_files.encode_blocks(ids)
        assert (token_files.decode_blocks(coded, n) == ids).all()
        if n == 9000 and ids.max() < 8:  # constant ids cost nearly nothing
            assert sum(map(len, coded)) < n / 8


def test_blocks_are_independent_and_checked():
    ids = np.arange(3000) % 500
    data = token_files.pack_segment([4, None, 9], [1000, 1500, 500], ids)
    docs, sizes, back = token_files.unpack_segment(data)
    assert docs == [4, None, 9] and sizes.tolist() == [1000, 1500, 500] and (back == ids).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_segment(bytes(broken))
    one = token_files.encode_blocks(ids)[1]
    assert one == token_files.encode_blocks(np.r_[ids[1024:2048], ids[1024:2048]])[0]


def test_coder_lanes_beyond_one_refresh():
    n = (token_files.LANES + 3) * token_files.BLOCK - 500
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.7, np.resize(rng.zipf(1.3, 3000) % 49408, n), rng.integers(0, 65536, n))
    assert (token_files.decode_blocks(token_files.encode_blocks(ids), n) == ids).all()


def test_token_file_words_reach_the_model_once(monkeypatch):
    pieces, asked = token_files.LibraryPieces(PATH), []
    model_ids = pieces.model_ids
    monkeypatch.setattr(pieces, "model_ids", lambda words: asked.extend(words) or model_ids(words))
    texts = ["Cat, cat. CAT", "", " cat,cat\n", "Mélange mélange"]
    got = [i.tolist() for i in pieces.encode(pa.array(texts), 1, part=14)]
    assert got == [[*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sorted(asked) == [",", ".", "cat", "mélange"]


def test_token_file_ids_of_random_texts_and_small_cache():
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    letters = [*"abcdeé'sStTθΣİ012 ½_-%$#üßÿñ\n\t\x0b\x1c\x85\u2028\u3000\u0301\0 <|>­²—😀", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(600)]
    for cache in (40, 600_000):
        pieces = token_files.LibraryPieces(PATH, cache)
        for part in (texts[:150], texts[100:400], texts):
            for t, ids in zip(part, pieces.encode(pa.array(part), 1, part=900), strict=True):
                assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1], t


def test_token_files_of_documents(ws):
    lib = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 13, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, TEXTS[0])]
    df = ws.createDataFrame(rows, "doc_id bigint, text string").withColumns({"start": F.lit(0), "ids": F.lit("x")})
    got = token_files.store_and_read(df, PATH, end_id=1, with_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["id"] for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    want = sorted(tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    assert sorted(tuple(r["ids"]) for r in got) == want
    assert token_files.store_and_read(df.filter("false"), PATH).count() == 0


def vectors(ws, n=400, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * 0.3
    x[7] = x[8] = x[60]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9020, [None] * dim), (9040, [float("nan")] * dim), (9060, [float("inf")] + [0.0] * (dim - 1)), (None, [1.0] * dim), (20, x[20].tolist())]
    return ws.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumns({"score": F.lit("x"), "id": F.lit(1)}), x


def best(scores, own, k):
    scores = scores.astype(object)
    return sorted(((-s, i) for i, s in enumerate(scores) if i != own))[:k]


def test_exact_topk_equals_brute_force(ws):
    df, x = vectors(ws)
    q = np.floor(64 * x).astype(np.int64)
    got = top_products(df, F.col("id") % 20 == 0, k=7, block_rows=100).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert sorted(by) == list(range(0, 400, 20))
    for i, rows in by.items():
        assert [(s, v) for _, s, v in sorted(rows)] == best(q @ q[i], i, 7)
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 8))
    few = top_products(df.filter("vec_id < 4"), F.col("id") % 20 == 0, k=7)
    assert few.count() == 3 and top_products(df.filter("false"), F.col("id") == 0).count() == 0


def test_bit_slices_with_large_and_negative_components():
    rng = np.random.default_rng(0)
    v = rng.integers(-(1 << 20), 1 << 20, (130, 5))
    v[:, 0] = 3
    s = BitSlices.build(np.arange(130), v)
    sums, offset = s.sums(v[:3])
    for r in range(3):
        rows, total = s.top([p[r] for p in sums], 10, -1)
        assert sorted(zip(-(total + offset[r]), rows)) == [(-a, i) for a, i in sorted(((int(w), i) for i, w in enumerate(v @ v[r])), key=lambda t: (-t[0], t[1]))[:10]]


def test_nn_descent_recall_and_exact_scores(ws):
    df, x = vectors(ws, n=1500, dim=16)
    df = df.unionByName(ws.createDataFrame([(9080, [0.0] * 16)], "vec_id bigint, embedding array<double>").withColumns({"score": F.lit("x"), "id": F.lit(1)}))
    got = nearest_products(df, F.col("id") % 20 == 0, k=20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert sorted(found) == list(range(0, 1500, 20))
    hits = []
    for i, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert len(rows) == 20 and all(r["vec_id"] != i and r["vec_id"] < 1500 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(abs(r["score"] - x[i] @ x[r["vec_id"]]) < 1e-12 for r in rows)
        hits.append(len({r["vec_id"] for r in rows} & {v for _, v in best(x @ x[i], i, 20)}) / 20)
    assert np.mean(hits) >= 0.9
    assert nearest_products(df.filter("vec_id < 5"), F.col("id") % 20 == 0).count() == 4
    assert nearest_products(df.filter("false"), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("lengths", ["outlier", "uneven"])
def test_nn_descent_recall_with_uneven_lengths(ws, lengths):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "outlier":
        x[7] *= 1000
    else:
        x *= np.exp(rng.normal(size=(3000, 1)))
    df = ws.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in nearest_products(df, F.col("id") % 50 == 0, k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[i] & {v for _, v in best(x @ x[i], i, 20)}) / 20 for i in range(0, 3000, 50)]
    assert np.mean(hits) >= 0.9


def test_pipeline_stages_against_plain_versions(ws):
    import corpus_pipeline as cp

    docs = ws.read.parquet(f"{SF}/documents.parquet")
    columns, seen, kept = docs.columns, docs, {}
    for name, stage in cp.STAGES:
        out = stage(ws, seen, SF)
        if name != "bpe":
            assert out.columns == columns
        kept[name] = out.toPandas()
        seen = ws.createDataFrame(kept[name], docs.schema) if name != "bpe" else out
    ids = {n: set(d.doc_id) for n, d in kept.items()}
    assert ids["bpe"] == ids["mixing"] <= ids["near_dups"] <= ids["toxicity"] <= ids["quality"]
    assert len(kept["bpe"]) == len(kept["mixing"])
    # near-duplicates: the survivors have different fingerprints, and every copy has its survivor
    from convrec.llm.simhash import fingerprint

    left = {fingerprint(t) for t in kept["near_dups"].text}
    assert len(left) == len(kept["near_dups"])
    whole = {fingerprint(t) for t in kept["toxicity"].text}
    for f in whole - left:  # what went was linked to another text
        assert any(((f ^ g) & (2**64 - 1)).bit_count() <= 4 for g in whole - {f})
    lib = Tokenizer.from_file(PATH)
    want = sorted((i, len(lib.encode(t, add_special_tokens=False).ids)) for i, t in zip(kept["mixing"].doc_id, kept["mixing"].text))
    assert want == sorted(zip(kept["bpe"].doc_id, kept["bpe"].n_tokens))


def test_registry_without_the_optional_folders():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert not any(m.startswith("convrec.llm") for m in sys.modules if m.startswith("convrec.operators"))


def test_components_of_a_long_path_have_plans_of_one_size(ws, monkeypatch):
    from convrec.llm.components import smallest_reachable
    from convrec.session import Generations

    bits = []
    put = Generations.put

    def measured(self, name, df):
        bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return put(self, name, df)

    monkeypatch.setattr(Generations, "put", measured)
    order = np.random.default_rng(3).permutation(20_000)
    path = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:]) if a != 777]
    cutoff = int(np.flatnonzero(order == 777)[0])
    got = {r["node"]: r["root"] for r in smallest_reachable(ws.createDataFrame(path, "a bigint, b bigint")).collect()}
    want = {int(x): int(part.min()) for part in (order[: cutoff + 1], order[cutoff + 1 :]) if len(part) > 1 for x in part}
    assert got == want
    assert len(bits) > 12 and max(bits) < 128 and max(bits[-5:]) <= max(bits[:10])


def test_markup_that_every_browser_reads():
    said = lambda page: [w for _, w, _ in blocks(page)]
    assert said("<article><p data-x=it's>Story one</p><p>two don't go</p><p>three</p></article>") == ["Story one", "two don't go", "three"]
    assert said('<img alt=5" src=a><p>lost?</p><p class="b">end</p>') == ["lost?", "end"]
    assert said("""<p title="a > b" x='c > d' y=e"f">one</p><p "q">two</p><p a = 'x>y'>three</p>""") == ["one", "two", "three"]
    assert said('<p class="open>kept</p><p>too</p>') == ["kept", "too"]
    assert said('<a href=/x?a="1>2">in</a> <p =>out') == ['2">in', "out"]


def test_deep_nesting_costs_no_more_an_element():
    import time
    import tracemalloc

    def cost(n):
        tracemalloc.start()
        begin = time.perf_counter()
        assert [w for _, w, _ in blocks("<div>" * n + "x" + "</section>" * n)] == ["x"]
        took, peak = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return took, peak

    small, large = cost(5_000), cost(40_000)
    assert large[1] < 12 * small[1] and large[1] < 100e6


def test_entropies_equal_a_plain_recount(ws):
    """Every path of a host: the entropies of the texts under it and of its child sequences, counted
    from the markup by hand (one div per line, lines as page parts)."""
    import math
    from collections import Counter

    rng = np.random.default_rng(5)
    parts = {"a": ["same", "x", "y"], "b": ["one", "two"], "c": ["fixed"]}
    pages, seen = [], {}
    for i in range(40):
        chosen = {k: str(rng.choice(v)) for k, v in parts.items() if rng.random() < 0.9}
        kids = {k: int(rng.integers(0, 3)) for k in chosen}
        body = "".join(f'<div class="{k}">{t}{"<hr>" * kids[k]}</div>' for k, t in chosen.items())
        pages.append(("h", f"<html><body>{body}</body></html>"))
        key = tuple(chosen.items())
        for k, t in chosen.items():
            seen.setdefault(k, {})[(key, t, kids[k])] = (t, kids[k])

    def entropy(values):
        n = Counter(values)
        bits = -sum(c / len(values) * math.log(c / len(values)) for c in n.values())
        return bits / math.log(len(values)) if len(values) > 1 else 1.0

    got = {r["path"]: r for r in style_tree(ws.createDataFrame(pages, "host string, html string")).collect()}
    for k, by_page in seen.items():
        # pages count once per (all texts, look, content), as rows that are equal do
        r = got[path_key(f"/html/body/div.{k}")]
        rows = list(by_page.values())
        assert r["pages"] == len(rows)
        assert abs(r["content"] - entropy([t for t, _ in rows])) < 1e-9
        assert abs(r["look"] - entropy([n for _, n in rows])) < 1e-9


def test_large_components_give_exact_products(ws):
    """Components up to 10^7 and, with scores that still fit 64 bits, far beyond; an error after that."""
    rng = np.random.default_rng(12)
    for size, dims in ((1e7, 5), (2e7, 2), (1e9, 3)):
        v = [[float(x) for x in r] for r in rng.uniform(-size, size, (60, dims)) * (0.6 if size == 1e9 else 1)]
        if size == 1e9:  # scale 1: products of 2^60, sums near the edge of 64 bits
            v = [[float(round(x)) for x in r] for r in v]
        scale = 1 if size == 1e9 else 64
        q = [[int(np.floor(np.float64(x) * scale)) for x in r] for r in v]
        df = ws.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")
        got = [tuple(r) for r in top_products(df, F.col("id") % 20 == 0, k=7, scale=scale, block_rows=16).collect()]
        want = []
        for a in range(0, 60, 20):
            best = sorted(((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in range(60) if b != a))[:7]
            want += [(a, i + 1, b, -s) for i, (s, b) in enumerate(best)]
        assert sorted(got) == want
    for bad in ([[4e9, 4e9], [4e9, 4e9]], [[1e300, 0.0], [1.0, 1.0]]):
        df = ws.createDataFrame(list(enumerate(bad)), "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            top_products(df, F.col("id") == 0, k=1, scale=64).collect()
