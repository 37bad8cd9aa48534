"""Entity mentions (T9-T12) and fuzzy title replacement (T13): expected rows written by hand,
and properties that hold on random input."""

import random
import re

from convrec.functions.text import usplit
from convrec.operators.fuzzy_titles import replace_titles_with_ids
from convrec.operators.mentions import detect_mentions, dialogue_mentions, entity_set

TEXTS = [
    (1, "I watched The Matrix, and Star Wars!"),
    (2, "the matrix"),
    (3, "Star Warz"),
    (4, "   "),
    (5, "(the matrix) was fine; c++ rocks"),
    (6, "Amélie est un film. amelie?"),
    (7, "matrix reloaded"),
    (8, "the matrixx"),
    (9, "a b c"),
    (10, "star wars: episode iv"),
    (11, "they said !! loudly"),
    (12, "the-matrix"),
]
ENTITIES = ["The Matrix", "Star Wars", "c++", "Amélie", "matrix", "by", "of the", "!!", "Star Wars: Episode IV", "b", "the matrix reloaded"]


def test_mentions_golden(spark):
    ents = entity_set(spark.createDataFrame([(e,) for e in ENTITIES], "name string"))
    assert "by" not in [r["entity"] for r in ents.collect()]
    texts = spark.createDataFrame(TEXTS, "text_id int, text string")
    got = {(r["text_id"], r["entity"]): r["score"] for r in detect_mentions(texts, ents, key_cols=["text_id"]).collect()}
    assert got == {
        (1, "star wars"): 1.0,
        (1, "the matrix"): 1.0,
        (2, "matrix"): 1.0,
        (2, "the matrix"): 1.0,
        (3, "star wars"): 6 / 8,
        (6, "amélie"): 1.0,
        (7, "matrix"): 1.0,
        (7, "the matrix reloaded"): 13 / 17,
        (8, "the matrix"): 8 / 9,
        (9, "b"): 1.0,
        (10, "star wars"): 1.0,
        (10, "star wars: episode iv"): 1.0,
    }


def test_mentions_plan_has_no_cartesian(spark):
    ents_df = entity_set(spark.createDataFrame([(e,) for e in ENTITIES], "name string"))
    texts = spark.createDataFrame(TEXTS, "text_id int, text string")
    plan = detect_mentions(texts, ents_df, key_cols=["text_id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dialogue_mentions_nested(spark):
    d = spark.createDataFrame(
        [(1, [("user", "I love the matrix"), ("assistant", "Try Star Wars or the Matrix")]), (2, [("user", "")])],
        "conv_id int, conversation array<struct<role:string,content:string>>",
    )
    ents = entity_set(spark.createDataFrame([("The Matrix",), ("Star Wars",)], "name string"))
    r = {x["conv_id"]: x["conversation"] for x in dialogue_mentions(d, ents).collect()}
    assert [(m["entity"], m["score"]) for m in r[1][0]["mentions"]] == [("the matrix", 1.0)]
    assert [(m["entity"], m["score"]) for m in r[1][1]["mentions"]] == [("star wars", 1.0), ("the matrix", 1.0)]
    assert r[2][0]["mentions"] == []


def test_dialogue_mentions_keep_a_mistyped_turn_in_its_place(spark):
    d = spark.createDataFrame(
        [(1, [("user", "hello"), ("user", "nothing"), ("user", "star warz"), ("user", "bye")])], "conv_id int, conversation array<struct<role:string,content:string>>"
    )
    ents = entity_set(spark.createDataFrame([("Star Wars",)], "name string"))
    r = dialogue_mentions(d, ents).first()["conversation"]
    assert [len(m["mentions"]) for m in r] == [0, 0, 1, 0] and r[2]["mentions"][0]["score"] == 6 / 8


def test_mentions_properties(spark):
    rnd = random.Random(5)
    vocab = ["red", "blue", "ring", "bolt", "the", "of", "red,", "(blue", "rin", "bol", "é", "x"]
    names = sorted({" ".join(rnd.choice(vocab[:6]) for _ in range(rnd.randint(1, 3))) for _ in range(25)})
    texts = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 8)))) for i in range(150)]
    ents = entity_set(spark.createDataFrame([(e,) for e in names], "name string"))
    tdf = spark.createDataFrame(texts, "text_id int, text string")
    found = detect_mentions(tdf, ents, key_cols=["text_id"])
    got = {(r["text_id"], r["entity"]): r["score"] for r in found.collect()}
    shares = found.join(tdf, "text_id").selectExpr("text_id", "entity", "text").withColumn("w", usplit("text")).withColumn("e", usplit("entity"))
    assert shares.selectExpr("min(arrays_overlap(w, e)) ok").first()["ok"]  # every scored pair shares a word
    assert got and all(0.7 <= v <= 1.0 for v in got.values())
    for i, t in texts:  # an entity that is a text's own run of plain words is found with score 1
        for e in names:
            if f" {e} " in f" {t} " and (i, e) not in got:
                assert e in ("the", "of"), (t, e)
            if f" {e} " in f" {t} " and (i, e) in got:
                assert got[i, e] == 1.0


def test_hot_words_meet_through_pairs(spark):
    """Every text holds every word of every entity; only pairs of neighbours tell them apart."""
    from pyspark.sql import functions as F

    from convrec.functions.ngrams import word_runs
    from convrec.operators.mentions import exact_candidates

    words = ["red", "blue", "ring", "bolt", "pin", "cap"]
    names = [f"{a} of {b}" for a in words for b in words if a != b]
    rnd = random.Random(2)
    texts = [(i, f"{rnd.choice(names)}, " + " ".join(rnd.sample(words, 6))) for i in range(200)]
    tdf = spark.createDataFrame(texts, "text_id int, tl string").withColumn("t_runs", word_runs("tl"))
    ents = spark.createDataFrame([(n,) for n in names], "entity string").withColumn("e_runs", word_runs("entity"))
    alone = exact_candidates(tdf, ents, ["text_id"], frequent=10**6)
    paired = exact_candidates(tdf, ents, ["text_id"], frequent=20)
    true = {(i, n) for i, t in texts for n in names if f" {n}," in f" {t}"}
    got = {tuple(r) for r in paired.collect()}
    assert true <= got and all(any(p in t for p in (f"{n.split()[0]} of", f"of {n.split()[2]}")) for i, n in got for t in [dict(texts)[i]])
    assert alone.count() > 3 * paired.count()
    found = detect_mentions(tdf.select("text_id", F.col("tl").alias("text")), ents.select("entity"), key_cols=["text_id"], frequent=20)
    assert {(r["text_id"], r["entity"]) for r in found.collect() if r["score"] == 1.0} == true


def test_fuzzy_candidates_keep_every_similar_pair(spark):
    """Length and place cut candidates of a frequent n-gram, never a pair that is similar enough."""
    from convrec.operators.mentions import fuzzy_candidates

    rnd = random.Random(9)
    draw = lambda: sorted(rnd.sample(range(14), rnd.randint(2, 10)))
    tsets, esets = {i: draw() for i in range(120)}, {f"e{i}": draw() for i in range(60)}
    prefix = lambda s: s[: len(s) - -(-len(s) * 7 // 10) + 1]
    tp = [(i, len(s), str(g), at + 1) for i, s in tsets.items() for at, g in enumerate(prefix(s))]
    ep = [(e, len(s), str(g), at + 1) for e, s in esets.items() for at, g in enumerate(prefix(s))]
    got = fuzzy_candidates(
        spark.createDataFrame(tp, "k int, t_n int, g string, t_at int"), spark.createDataFrame(ep, "entity string, e_n int, g string, e_at int"), ["k"], 0.7
    )
    got = {tuple(r) for r in got.collect()}
    similar = {(i, e) for i, a in tsets.items() for e, b in esets.items() if len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b))}
    plain = {(x[0], y[0]) for x in tp for y in ep if x[2] == y[2]}
    assert similar <= got and len(got) * 2 < len(plain)


TITLES = [("a1", "The Matrix (1999) [DVD]"), ("b2", "Star Wars"), ("c3", "Amélie"), ("d4", "(only brackets)"), ("e5", "Toy Story 2")]


def _cleaned(spark, rows, titles=TITLES, **kw):
    tdf = spark.createDataFrame(titles, "item_id string, title string")
    df = spark.createDataFrame(rows, "rid int, response string, history_items array<string>")
    return {(r["rid"], r["response"]): r["response_clean"] for r in replace_titles_with_ids(df, tdf, row_key="rid", **kw).collect()}


def test_fuzzy_title_replacement_golden(spark):
    far = "x" * 120
    rows = [
        (1, "You might enjoy The Matrix. Also The Matrix again, and the Matrix Reloaded.", ["a1", "b2"]),
        (2, "Star Wars (<id_b2>) is great; Star Wars also", ["b2"]),
        (3, "Try Star Warz or Stor Wars today", ["b2", "a1"]),
        (4, "Amélie!", ["c3", "d4"]),
        (5, "nothing relevant here", ["e5"]),
        (6, f"Toy Story is fun but Toy Story 2 is better. {far} Toy Story 2 again", ["e5"]),
        (7, "no history", None),
    ]
    want = [
        "You might enjoy . Also  again, and t<id_a1> Reloaded.",
        "<id_b2>  is great; <id_b2> also",
        "Try z or Sto<id_b2> today",
        "<id_c3>!",
        "nothing relevant here",
        f"<id_e5> is fun but  is better. {far} <id_e5> again",
        "no history",
    ]
    assert _cleaned(spark, rows) == {(r, t): w for (r, t, _), w in zip(rows, want)}


def test_fuzzy_titles_one_user_two_responses_and_repeated_titles(spark):
    rows = [(1, "I like Star Wars", ["b2"]), (1, "I like Amélie", ["c3"])]
    got = _cleaned(spark, rows, TITLES + [("b2", "Star Wars again")])
    assert got == {(1, "I like Star Wars"): "I like <id_b2>", (1, "I like Amélie"): "I like <id_c3>"}


def test_fuzzy_titles_leave_far_text_alone(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "(y)", ","]
    rows = []
    for rid in range(40):
        tail = " ".join(rnd.choice(words) for _ in range(5))
        rows.append((rid, "Star Wars " + "-" * 90 + " " + tail, ["b2"]))
    for (_, before), after in _cleaned(spark, rows, span=10).items():
        assert after.startswith("<id_b2>") and after.endswith(before[100:])


def _replaced_plainly(text, items, titles, span=50, passes=5):
    """T13 by brute force: of all pieces longer than half the title the longest, at its first place."""
    clean = {k: re.sub(r"[\(\[].*?[\)\]]", "", t) for k, t in titles}
    for _ in range(passes):
        for k in items:
            t, tag = clean[k], f"<id_{k}>"
            cuts = {t[i : i + w] for w in range(len(t) // 2 + 1, len(t) + 1) for i in range(len(t) - w + 1)}
            hits = [(-len(c), text.find(c), c) for c in cuts if c in text]
            if not hits or not min(hits)[2].strip():
                continue
            size, at, block = min(hits)
            s0, e0 = max(0, at - span - len(tag)), at - size + span + len(tag)
            w = text[s0:e0]
            if tag in w:
                w = re.sub(r"\(?" + re.escape(tag) + r"\)?", "", w).strip()
            text = text[:s0] + w.replace(block.strip(), tag).strip() + text[e0:]
    return text


def test_fuzzy_titles_as_by_brute_force(spark):
    """Titles that share words, of every small length, whole, cut and mistyped in the texts."""
    rnd = random.Random(11)
    words = ["red", "é", "blue ring", "bolt", "aa", "a", "of the", "pins"]
    titles = [(f"k{i}", "".join(rnd.choice("ab é") for _ in range(i))) for i in range(1, 9)]
    titles += [(f"t{i}", " ".join(rnd.sample(words, rnd.randint(1, 5))) + rnd.choice(["", " (x)", "  [y] (z)"])) for i in range(14)]
    rows = []
    for rid in range(150):
        items = [k for k, _ in rnd.sample(titles, rnd.randint(0, 6))]
        piece = lambda t: t[rnd.randint(0, 3) : len(t) - rnd.randint(0, 3)]
        said = [piece(rnd.choice(titles)[1]) for _ in range(rnd.randint(0, 6))] + [rnd.choice(["<id_t1>", "(<id_k3>)", ", ", "-" * 30])]
        rows.append((rid, " ".join(rnd.sample(said, len(said))), items))
    got = _cleaned(spark, rows, titles, span=5)
    assert got == {(r, t): _replaced_plainly(t, items, titles, span=5) for r, t, items in rows}
    assert sum(t != c for (_, t), c in got.items()) > 50


def test_fuzzy_titles_look_for_pieces_as_bytes(spark):
    """Whether a piece occurs is not asked with ``instr``, which counts characters up to the place, and
    an item's pieces are found once per row, not at every look."""
    tdf = spark.createDataFrame(TITLES, "item_id string, title string")
    df = spark.createDataFrame([(1, "Star Wars", ["b2"])], "rid int, response string, history_items array<string>")
    plan = replace_titles_with_ids(df, tdf, row_key="rid")._jdf.queryExecution().analyzed().toString()
    assert "instr(" in plan and not re.search(r"instr\([^()]*(\([^()]*(\([^()]*\))*[^()]*\))*[^()]*\) > 0", plan)
    assert "seeds" in plan
