"""Block naming, document FP-trees and whitening against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from convrec.llm.block_naming import block_key, blocks_of, exact_duplicates
from convrec.llm.term_tree import DocumentTree, best_documents, share, terms_of
from convrec.llm.whitening import whiten


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_groups(rows):
    """Per row ``(id, keep_id, size, sha)`` and per text the ids, by a dictionary of whole texts."""
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[ascii_lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(ascii_lower(t).encode()).hexdigest()))
    return out, groups


def check_groups(ws, rows, **kw):
    df = ws.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, name string, row int")
    got = exact_duplicates(df, **kw).collect()
    want, groups = plain_groups(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_blocks_of():
    assert blocks_of(b"", 4) == [b""] and blocks_of(b"abcde", 4) == [b"abcd", b"e"] and blocks_of(b"abcd", 4) == [b"abcd"]
    assert -(1 << 63) <= block_key(b"abc") < 1 << 63


def test_naming_edges(ws):
    long = "Wort é " * 30_000
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "É"), (6, "é"), (None, "a"), (None, "zz"), (7, "b"), (7, "b"), (8, " a")]
    rows += [(9, long), (10, long.upper().replace("É", "é")), (11, long + "x"), (12, long[:-1] + "."), (13, "a\x00b"), (14, "A\x00B")]
    check_groups(ws, rows)
    check_groups(ws, [(None, "q"), (None, "Q")])


def test_naming_is_free_of_collisions_whatever_the_key(ws):
    """Texts over two letters in tiny blocks, with keys that hardly tell blocks apart."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:30] + ["ab" * 9] * 60)]
    check_groups(ws, rows, block_bytes=3, key=lambda b: len(b) % 2)
    check_groups(ws, rows, block_bytes=4)


def test_naming_of_an_empty_table(ws):
    out = exact_duplicates(ws.createDataFrame([], "doc_id bigint, text string"))
    assert out.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


# ---- ranked search -----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tree_search_equals_scoring_all(data):
    terms = data.draw(st.integers(1, 12))
    docs = data.draw(st.lists(st.dictionaries(st.integers(0, terms - 1), st.integers(1, 4), min_size=1), min_size=1, max_size=60))
    docs += docs[:1] * data.draw(st.integers(0, 9))
    m = np.array(data.draw(st.lists(st.integers(50, 60), min_size=len(docs), max_size=len(docs))))
    place = np.array(data.draw(st.permutations(range(len(docs)))))
    start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    rank, tf = (np.array([x for d in docs for x in part(d)], np.int64) for part in (dict.keys, dict.values))
    tree = DocumentTree(rank, tf, start, m, place, terms, leaf=data.draw(st.integers(1, 5)))
    asked = np.array(sorted(data.draw(st.sets(st.integers(0, terms - 1)))), np.int64)
    weights = np.array([data.draw(st.integers(1, 3)) for _ in asked], np.int64)
    k = data.draw(st.integers(1, 7))
    score = [sum(w * int(share(np.int64(d[t]), m[i])) for t, w in zip(asked.tolist(), weights.tolist()) if t in d) for i, d in enumerate(docs)]
    want = sorted((i for i in range(len(docs)) if score[i] > 0), key=lambda i: (-score[i], place[i]))[:k]
    got, scores = tree.search(asked, weights, k)
    assert got.tolist() == want and scores.tolist() == [score[i] for i in want]


def test_tree_bounds_hold_below_every_node():
    rng = np.random.default_rng(2)
    docs = [dict(zip(rng.choice(30, rng.integers(1, 9), replace=False).tolist(), rng.integers(1, 6, 9).tolist())) for _ in range(400)]
    start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    rank, tf = (np.array([x for d in docs for x in part(d)], np.int64) for part in (dict.keys, dict.values))
    tree = DocumentTree(rank, tf, start, rng.integers(50, 200, 400), np.arange(400), 30, leaf=8)
    assert max(b - a for (a, b), kids in zip(tree.range, tree.children) if kids is None) <= 8
    for t in range(30):
        most = dict(zip(tree.node[tree.first[t] : tree.first[t + 1]].tolist(), tree.most[tree.first[t] : tree.first[t + 1]].tolist()))
        for v, (a, b) in enumerate(tree.range):
            held = [int(p) for r, p in zip(tree.rank[tree.start[a] : tree.start[b]], tree.part[tree.start[a] : tree.start[b]]) if r == t]
            assert (v in most) == bool(held) and (not held or most[v] >= max(held))


def plain_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
    words = [(i, cut(t)) for i, t in docs if t is not None and cut(t)]
    n, length = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    texts = {}
    for i, t in items:
        if i is not None:
            texts[i] = min(texts.get(i, t or ""), t or "", key=str.encode)
    for item, text in texts.items():
        scored = []
        for i, w in words:
            m = 100 - 50 + (50 * len(w) * n) // length
            s = 0
            for t in set(cut(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += weight * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def test_terms_of():
    got = [t.decode() for t in terms_of("It's É-1 ÀB_c\x7f\x1cd\u0085e")]
    assert got == ["it", "s", "É", "1", "Àb", "c", "d\u0085e"]


def test_search_equals_plain_search(ws):
    rnd = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "ñandú", "x1", "7", "delta", "É", "the", "of"]
    text = lambda a, b: " ".join(rnd.choices(vocab, [5, 4, 3, 1, 1, 1, 1, 1, 30, 20], k=rnd.randint(a, b)))
    docs = [(i, text(1, 40)) for i in range(300)] + [(1000 + i, "alpha gamma the") for i in range(80)]
    docs += [(500, None), (501, ""), (502, "... --"), (None, "alpha beta"), (7, "delta delta"), (503, "the " * 20_000 + "ñandú")]
    items = [(i, text(1, 8)) for i in range(12)] + [(3, "zzz"), (20, None), (21, "nowhere"), (None, "alpha"), (22, "ALPHA, alpha! gamma?")]
    ddf = ws.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id bigint, text string, item_id string, row int")
    idf = ws.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, doc_id int")
    key = lambda r: (r[0], r[1])
    want = sorted(plain_search(docs, items, 20), key=key)
    assert sorted(map(tuple, best_documents(ddf, idf, k=20).collect()), key=key) == want
    assert sorted(map(tuple, best_documents(ddf, idf, k=20, group_bytes=60, block_postings=300).collect()), key=key) == want


def test_search_of_empty_tables(ws):
    docs, items = (ws.createDataFrame([], f"{i} bigint, text string") for i in ("doc_id", "item_id"))
    one = ws.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    for a, b in ((docs, items), (docs, one), (one.withColumnRenamed("item_id", "doc_id"), items)):
        out = best_documents(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


# ---- whitening -----------------------------------------------------------------------------


def plain_whitening(x, k):
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_eigh(ws):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((700, 24)) * np.linspace(3, 0.5, 24)).astype(np.float32)
    rows = [(i, v[i].tolist(), "a", 3) for i in range(700)]
    bad = [(900, None), (901, [float("nan")] + [0.0] * 23), (902, [float("inf")] + [0.0] * 23), (903, [None] + [0.0] * 23)]
    df = ws.createDataFrame(rows + [(i, b, "b", 4) for i, b in bad], "vec_id bigint, embedding array<float>, component string, n int")
    got = whiten(df, k=6).toPandas().sort_values(["id", "component"])
    white, explained, deviation = plain_whitening(np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000, 6)
    assert len(got) == 700 * 6 and set(got["n"]) == {700}
    w = got["whitened"].to_numpy().reshape(700, 6)
    sign = np.sign((w * white).sum(axis=0))
    assert np.abs(w * sign - white).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(700, 6), explained, rtol=1e-9)
    assert (got["deviation"].to_numpy().reshape(700, 6) == deviation[:, None]).all()
    assert got["identity_error"].nunique() == 1 and 0 <= got["identity_error"].iloc[0] < 1e-10


def test_whitening_edges(ws):
    schema = "vec_id bigint, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):  # nothing, or no variance
        out = whiten(ws.createDataFrame(rows, schema))
        assert out.columns[:3] == ["id", "component", "n"] and out.count() == 0
    # a repeated id and a null one are rows; a short vector counts as filled up with zeros
    got = whiten(ws.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 0.0]), (None, [2.0]), (4, [-1.0, 0.0])], schema)).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    big = whiten(ws.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 0.0]), (3, [-1e12, 1.0])], schema)).collect()
    exact = {i: sum(x * x for x in d) for i, d in ((1, (3 * 64 * 10**12, -64)), (2, (0, -64)), (3, (-3 * 64 * 10**12, 128)))}
    assert {r["id"]: r["deviation"] for r in big} == {i: d if d < 1 << 63 else None for i, d in exact.items()}
