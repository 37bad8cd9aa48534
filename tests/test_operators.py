"""Golden rows and invariants for the DataFrame operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convrec import config as C
from convrec.config import SPECIAL_TOKEN
from convrec.operators import dialogue as dl
from convrec.operators import graph as g
from convrec.operators import interactions as ops
from convrec.operators.catalog import build_catalogue
from convrec.operators.split import check_ratios, random_split, stratified_split


def test_kcore_golden(spark):
    # users 1, 2 and items a, b support each other; 3 falls with c, then d with 3
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "d"), (1, "d")]
    res = ops.k_core(spark.createDataFrame(rows, "user_id int, item_id string"), 2)
    assert sorted(map(tuple, res.core.collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert res.rows == 4


def test_kcore_is_a_maximal_core(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 30), rnd.randint(0, 20), n) for n in range(600)] + [(None, 1, 0), (1, None, 0)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, n int")
    before = None
    for k in (3, 8, 15, 18, 40):
        res = ops.k_core(df, k)
        got = {tuple(r) for r in res.core.collect()}
        assert res.rows == len(got)
        for at in (0, 1):  # all counts reach k
            assert all(v >= k for v in Counter(r[at] for r in got).values())
        assert before is None or got <= before  # cores are nested
        if got:  # a core is its own core; with any part of the rest it still is
            assert ops.k_core(res.core, k).rounds == 0
            mixed = res.core.unionByName(df.filter(F.col("n") % 2 == 0)).distinct()
            assert got <= {tuple(r) for r in ops.k_core(mixed, k).core.collect()}
        before = got


def test_kcore_round_limit(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id int, item_id int")
    with pytest.raises(RuntimeError):
        ops.k_core(df, 2, max_rounds=1)


def test_kcore_rounds_stay_alike(spark, monkeypatch):
    """A path loses its two ends a round: many rounds, none of whose plans may carry a size
    estimate that grows, and no more than the last table of each name stays."""
    from convrec.session import Generations

    bits, kept = [], []
    put, sweep = Generations.put, Generations.sweep

    def measured(self, name, df):
        bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return put(self, name, df)

    def swept(self):
        sweep(self)
        kept.append(len(self.current) + len(self.replaced))

    monkeypatch.setattr(Generations, "put", measured)
    monkeypatch.setattr(Generations, "sweep", swept)
    df = spark.createDataFrame([(j // 2, f"i{(j + 1) // 2}") for j in range(44)], "user_id int, item_id string")
    res = ops.k_core(df, 2)
    assert res.rounds >= 20 and res.rows == 0 and res.core.count() == 0
    assert max(bits) < 64 and max(bits[-5:]) <= max(bits[:5]) + 4
    assert max(kept) <= 2


def test_kcore_empty(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id int, item_id int")
    res = ops.k_core(df, 5)
    assert res.rows == 0 and res.core.count() == 0


def test_latest_interactions_edges(spark):
    one = spark.createDataFrame([(1, 10, 5, "a")], "user_id int, ts int, rating int, item_id string")
    s = ops.latest_interactions(one, 10, order_cols=("ts", "rating", "item_id")).first()
    assert s["target"]["item_id"] == "a" and s["sampled"] == [] and s["interaction_len"] == 1
    twelve = spark.createDataFrame([(1, t, 3, f"i{t:02d}") for t in range(1, 13)], "user_id int, ts int, rating int, item_id string")
    s = ops.latest_interactions(twelve, 10, order_cols=("ts", "rating", "item_id")).first()
    assert s["target"]["item_id"] == "i12"
    assert [x["item_id"] for x in s["sampled"]] == [f"i{t:02d}" for t in range(3, 12)]


def test_hot_user_history_positions(spark):
    # one user holds a third of all rows: positions stay exact and the user is ranked by many tasks
    rows = [(0, t, t % 5, f"i{t}") for t in range(3000)] + [(u, t, 1, f"j{t}") for u in range(1, 601) for t in range(10)]
    df = spark.createDataFrame(rows, "user_id int, ts int, rating int, item_id string")
    h = ops.history_positions(df, order_cols=("ts", "rating", "item_id"))
    hot = h.filter("user_id = 0")
    assert sorted(r["pos"] for r in hot.select("pos").collect()) == list(range(1, 3001))
    assert hot.filter("pos = 3000").first()["item_id"] == "i2999"
    assert {r["interaction_len"] for r in hot.select("interaction_len").distinct().collect()} == {3000}
    spread = df.repartitionByRange(8, "user_id", "ts").withColumn("p", F.spark_partition_id()).filter("user_id = 0")
    assert spread.select("p").distinct().count() > 1
    s = ops.latest_interactions(df, 10, order_cols=("ts", "rating", "item_id")).filter("user_id = 0").first()
    assert s["target"]["item_id"] == "i2999" and [x["item_id"] for x in s["sampled"]] == [f"i{t}" for t in range(2990, 2999)]


def test_top_actors_stable_ties(spark):
    meta = spark.createDataFrame(
        [("1", "t", "{'cast': [{'name': 'a', 'known_for_department': 'Acting', 'popularity': 5},"
          " {'name': 'b', 'known_for_department': 'Acting', 'popularity': 5},"
          " {'name': 'c', 'known_for_department': 'Acting', 'popularity': 9},"
          " {'name': 'd', 'known_for_department': 'Sound', 'popularity': 99},"
          " {'name': 'e', 'known_for_department': 'Acting', 'popularity': None}],"
          " 'crew': [{'name': 'x', 'department': 'Directing'}, {'name': 'y', 'department': 'Sound'}, {'name': 'x', 'department': 'Directing'}]}")],
        "asin string, title string, casts string",
    )
    c = build_catalogue(meta).first()
    assert c["Acting"] == ["c", "a", "b", "e"]
    assert c["Directing"] == ["x", "x"] and c["Sound"] == ["y"] and c["Production"] == []
    assert c["parent_asin"] == "1" and c["Collection"] == "" and c["Genres"] == []


def test_stratified_split_edges(spark):
    rows = [("s1", 0)] + [("s2", i) for i in range(1, 3)] + [("s10", i) for i in range(3, 13)]
    df = spark.createDataFrame(rows, "scenario string, conv_id int")
    out = stratified_split(df, "scenario", "conv_id", valid=0.1, test=0.1).groupBy("scenario", "split").count().collect()
    got = {(r["scenario"], r["split"]): r["count"] for r in out}
    assert got == {("s1", "test"): 1, ("s2", "valid"): 1, ("s2", "test"): 1, ("s10", "train"): 8, ("s10", "valid"): 1, ("s10", "test"): 1}


def test_split_partitions_input(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "conv_id")
    out = random_split(df, "conv_id", 0.8, 0.1, 0.1, bucket_hex=2)
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 4000, "valid": 500, "test": 500}
    assert out.select("conv_id").distinct().count() == 5000


def test_split_ratio_check():
    with pytest.raises(ValueError):
        check_ratios(0.8, 0.1, 0.2)


def _dialogue(spark, turns, target="1"):
    return spark.createDataFrame(
        [(1, [(r, c) for r, c in turns], target)], "conv_id int, conversation array<struct<role:string,content:string>>, target_asin string"
    )


def test_id_to_title_golden(spark):
    dic = spark.createDataFrame([("1", "One")], "key string, title string")
    d = _dialogue(spark, [("AI", "see <id_1> <id_1> <id_9>"), ("user", "<id_1>"), ("user", "  plain  ")])
    r = dl.replace_ids_with_titles(d, dic).first()
    assert r["conversation"][0]["content"] == f"see {SPECIAL_TOKEN} One {SPECIAL_TOKEN} One <id_9>"
    assert r["conversation"][1]["content"] == "One"
    assert r["conversation"][2]["content"] == "  plain  "
    assert r["not_found"] == 1 and r["named_items"] == ["<id_1>"] and r["recommended"] == ["<id_1>"]
    assert r["target"] == ["<id_1>"]


def test_toolkit_movies_w8(spark):
    dic = spark.createDataFrame([("1", "X"), ("2", "Y")], "key string, title string")
    d = _dialogue(spark, [("system", "s"), ("user", "I like <id_1>"), ("assistant", f"{SPECIAL_TOKEN} <id_1> or <id_2> <id_2> <id_7>")])
    r = dl.toolkit_rows(d, dic, mentions_col=None).first()
    conv = r["conv"]
    assert [m["utt_id"] for m in conv] == [0, 1]
    assert conv[0]["role"] == "Seeker" and conv[0]["movies"] == ["X"]
    assert conv[1]["role"] == "Recommender" and conv[1]["movies"] == ["Y", "Y", "<id_7>"]
    assert conv[1]["word"] == ["1", "or", "2", "2", "7"]


def test_names_to_ids_roundtrip(spark):
    dic = spark.createDataFrame([("1", "Alpha"), ("2", "Beta")], "key string, title string")
    d = _dialogue(spark, [("AI", "try <id_1> and <id_2>"), ("user", "I saw <id_1>")], target="2")
    r = dl.replace_ids_with_titles(d, dic)
    r = dl.format_dialogues(r).drop("conversation").withColumnRenamed("messages", "conversation")
    back = dl.names_to_ids(r, dic).first()["conversation"]
    assert back[1]["content"] == f"try {SPECIAL_TOKEN} Alpha and {SPECIAL_TOKEN} <id_2>"
    assert back[2]["content"] == "I saw <id_1>"


def test_concept_upsert_golden(spark):
    old = spark.createDataFrame([("a", 1), ("b@c", 2), ("d", 3)], "concept string, concept_id bigint")
    new = spark.createDataFrame([("d", 4)], "concept string, concept_id bigint")
    got = sorted(tuple(r) for r in g.upsert_concepts(old, new).collect())
    assert got == [("a", 1), ("d", 4)]
    assert g.upsert_concepts(None, new).count() == 1


def test_entity_mapping_items_win(spark):
    kg = spark.createDataFrame([("7", "x"), ("8", "z")], "id string, name string")
    items = spark.createDataFrame([("7", "y")], "id string, title string")
    got = dict((r["id"], r["name"]) for r in g.entity_mapping(kg, items).collect())
    assert got == {"7": "y", "8": "z"}


def test_group_triples(spark):
    t = spark.createDataFrame([("1", 2, "b"), ("1", 0, "a"), ("2", 1, "c")], "head_id string, relation_id int, tail_id string")
    got = sorted(tuple(r) for r in g.group_triples(t).collect())
    assert got == [("1", 1, 0, "a", 2), ("1", 2, 2, "b", 2), ("2", 1, 1, "c", 1)]


def test_group_triples_hot_head(spark):
    rows = [("h", i % 3, f"t{i:04d}") for i in range(2500)] + [("x", 0, "a")]
    t = spark.createDataFrame(rows, "head_id string, relation_id int, tail_id string")
    hot = sorted((r["pos"], r["relation_id"], r["tail_id"]) for r in g.group_triples(t).filter("head_id = 'h'").collect())
    assert [p for p, _, _ in hot] == list(range(1, 2501))
    assert [(r, tl) for _, r, tl in hot] == sorted((r, tl) for _, r, tl in rows[:2500])


def test_rank_within_keeps_every_row_and_column(spark):
    # 400,000 rows over 16 partitions, a user with a third of them, a column beyond group and order
    n = 400_000
    rows = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id") % 500).alias("user_id"),
        (F.xxhash64("id", F.lit(1)) % 1_000_000).alias("ts"),
        F.col("id").alias("row"),
        F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )
    from pyspark.sql import Window

    out = ops.rank_within(rows, ["user_id"], ["ts", "row"])
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "row")))
    both = out.join(want.select("row", "want", F.col("text").alias("t2")), "row")
    r = both.agg(F.count("*").alias("n"), F.sum((F.col("__pos") != F.col("want")).cast("int")).alias("bad"), F.sum((F.col("text") != F.col("t2")).cast("int")).alias("bad_text")).first()
    assert out.count() == n and r["n"] == n and r["bad"] == 0 and r["bad_text"] == 0


def test_semi_join_ships_distinct_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    out = ops.semi_join(left, right, "k")
    assert [tuple(r) for r in out.collect()] == [(1, "a")]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_filter_report_counts_a_step_that_keeps_nothing(spark):
    from convrec.operators.report import FilterReport

    rep = FilterReport()
    df = spark.createDataFrame([(1,), (2,)], "k int")
    out = rep.step(df, lambda d: ops.semi_join(d, spark.createDataFrame([], "k int"), "k"), "none")
    assert out.count() == 0
    assert [tuple(r) for r in rep.frame(spark).collect()] == [("none", 2, 0, 2, 1.0)]


def test_prompt_prints_a_repeated_catalogue_id_once(spark):
    from convrec.operators.prompts import build_prompts

    users = spark.createDataFrame(
        [(1, "s", [(5.0, "i1")], (4.0, "i2"))],
        "user_id int, scenario string, sampled array<struct<rating:double,item_id:string>>, target struct<rating:double,item_id:string>",
    )
    cat = spark.createDataFrame([("i1", "A one"), ("i1", "A two"), ("i2", "B")], "parent_asin string, Title string")
    text = ("Collection", "Overview", "Visual Caption")
    others = {c for c, _ in C.FEATURE_COLUMNS.values()} - {"Title"}
    cat = cat.withColumns({c: F.lit("") if c in text else F.array().cast("array<string>") for c in others})
    sc = spark.createDataFrame([("s", [], [])], "scenario string, history array<string>, target array<string>")
    p = build_prompts(users, cat, sc).first()["prompt"]
    assert p.count("<id_i1>") == 1 and "A one" in p and "A two" not in p


def test_literal_with_escaped_backslash(spark):
    from pyspark.sql import types as T

    from convrec.functions.literals import parse_literal

    names = ["a\\x41b", "A", "q\\\\x41", "caf\xe9"]
    rows = [(repr([n]),) for n in names] + [("['\\x41\\x42']",)]
    got = spark.createDataFrame(rows, "s string").select(parse_literal("s", T.ArrayType(T.StringType())).alias("v")).collect()
    assert [r["v"][0] for r in got] == [*names, "AB"]


def test_only_newline_ends_a_line(spark):
    from convrec.functions.text import clean_title

    rows = [("A (b\rc) d",), ("A (b\u2028c) d",), ("A (b\nc) d",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(clean_title("t")).collect()]
    assert got == ["A  d", "A  d", "A (b\nc) d"]


def test_prompt_lists_are_joined_once_per_item(spark):
    """The looked-up rows carry the text of an item's lines, not its lists; empty lists give no line."""
    from convrec import config as C
    from convrec.operators.prompts import build_prompts

    item = "struct<item_id:string,rating:double>"
    users = spark.createDataFrame(
        [("u1", "s", [("a", 5.0), ("b", 1.0)], ("c", 4.0))], f"user_id string, scenario string, sampled array<{item}>, target {item}"
    )
    lists = {c for c, _ in C.FEATURE_COLUMNS.values()} - {"Title", "Collection", "Overview", "Visual Caption"}
    cat = spark.createDataFrame([("a", "A", ["x", None, "y"]), ("b", "B", []), ("c", "C", None)], "parent_asin string, Title string, l array<string>")
    cat = cat.withColumns({c: F.col("l") for c in lists} | {c: F.lit("") for c in ("Collection", "Overview", "Visual Caption")}).drop("l")
    sc = spark.createDataFrame([("s", ["Genres"], ["Genres"])], "scenario string, history array<string>, target array<string>")
    p = build_prompts(users, cat, sc)
    label = C.FEATURE_COLUMNS["Genres"][1]
    assert p.first()["prompt"].count(f"{label}: ") == 1 and f"{label}: x, y\n" in p.first()["prompt"]
    folded = [x for x in p._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in x]
    assert folded and "array_join" not in "".join(folded)
    shown = [x for x in p._jdf.queryExecution().optimizedPlan().toString().split("\n") if "LeftOuter" in x or "array_join" in x]
    assert any("CASE WHEN (size(" in x for x in shown)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dialogue_chain_runs_each_step_once(spark):
    """Names to ids, toolkit rows: the dialogues before a step are not computed again for its look-up
    (one look-up join and one join back stand in the plan), nor is the step for the filter of explode."""
    dic = spark.createDataFrame([("1", "Alpha"), ("2", "Beta")], "key string, title string")
    d = _dialogue(spark, [("AI", "try <id_1> and <id_2>"), ("user", "I saw <id_1>"), ("AI", "<id_2>")], target="2")
    r = dl.format_dialogues(dl.replace_ids_with_titles(d, dic)).drop("conversation").withColumnRenamed("messages", "conversation")
    back = dl.names_to_ids(r, dic)
    rows = dl.toolkit_rows(back, dic, mentions_col=None).select(F.explode("conv").alias("u"))
    assert _plan(back).count("Join") == 2 and _plan(rows).count("Join") == 2
    assert _plan(back.select(F.posexplode("conversation"))).count("regexp_extract(") == 3  # keys, user turns, others
    assert _plan(rows).count("<id_(.*?)>") == 1
    assert [(x["u"]["utt_id"], x["u"]["movies"]) for x in rows.collect()] == [(0, ["Beta"]), (1, ["Alpha"]), (2, [])]


def test_names_to_ids_of_a_long_dialogue(spark):
    """The last tag of a title wins; hundreds of titles in one dialogue take seconds."""
    import time

    n = 600
    dic = spark.createDataFrame([(str(i), f"title {i % (n - 1):04d}") for i in range(n)], "key string, title string")
    tags = [f"<id_{i}>" for i in range(n)]
    d = spark.createDataFrame([(1, [("user", f"title {i:04d}") for i in range(n - 1)], tags, [])],
                              "conv_id int, conversation array<struct<role:string,content:string>>, named_items array<string>, target array<string>")
    begin = time.time()
    got = [m["content"] for m in dl.names_to_ids(d, dic).first()["conversation"]]
    assert time.time() - begin < 20
    assert got == [f"<id_{i or n - 1}>" for i in range(n - 1)]


def test_title_dictionary_sorts_after_the_shuffle(spark):
    """However few files the catalogue has, its titles are cleaned and sorted in shuffled parts."""
    cat = spark.createDataFrame([(1, "B (x)"), (1, "A [y]"), (2, None)], "item_id int, title string").coalesce(1)
    dic = dl.title_dictionary(cat, "item_id", "title")
    plan = dic._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "regexp_replace" not in plan[plan.index("Exchange") :]
    assert sorted(map(tuple, dic.collect())) == [("1", "A "), ("2", "None")]


def _prompt_inputs(spark, users):
    item = "struct<item_id:string,rating:double,title:string,text:string>"
    users = spark.createDataFrame(users, f"user_id string, scenario string, sampled array<{item}>, target {item}")
    lists = {c for c, _ in C.FEATURE_COLUMNS.values()} - {"Title", "Collection", "Overview", "Visual Caption"}
    cat = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "parent_asin string, Title string")
    cat = cat.withColumns({c: F.array(F.lit("l"), F.col("Title")) for c in lists} | {c: F.col("Title") for c in ("Collection", "Overview", "Visual Caption")})
    sc = [("s", ["Genres", "Review"], []), ("cold", None, ["Genres"]), ("open", ["Genres"], None)]
    return users, cat, spark.createDataFrame(sc, "scenario string, history array<string>, target array<string>")


def test_prompts_read_their_users_once(spark):
    """Users, scenarios and catalogue each stand once in the plan, and what is folded per user is text."""
    from convrec.operators.prompts import build_prompts

    users, cat, sc = _prompt_inputs(spark, [("u", "s", [("a", 5.0, "t", "fine")], ("b", 4.0, "t", "x"))])
    plan = _plan(build_prompts(users, cat, sc))
    assert plan.count("LogicalRDD") == 3
    assert "info" not in next(x for x in plan.split("\n") if "collect_list" in x)


def test_prompts_of_repeated_null_and_empty_rows(spark):
    from convrec.operators.prompts import build_prompts

    a, b, c = ("a", 5.0, "ta", "liked it"), ("b", 1.0, None, "bad one"), ("c", None, "tc", "x")
    rows = [
        ("twice", "s", [a], c), ("twice", "open", [b], a), (None, "s", [a], b), ("none", "s", None, c), ("bare", "cold", [], c),
        ("lost", "no such", [a], b), ("gone", "s", [("z", 4.0, "t", "text"), (None, 4.0, "t", "text")], None), ("hidden", "cold", [a, b], c),
    ]
    got = {(r["user_id"], r["scenario"]): (r["target_item"], r["prompt"]) for r in build_prompts(*_prompt_inputs(spark, rows)).collect()}
    line = lambda t, *more: f"Item: {t}, ID: <id_{t.lower()}>\n" + "".join(more)
    genres = lambda t: f"Genres: l, {t}\n"
    review = lambda t, x: f"User Review Title: {t}\nUser Review: {x}\n"
    head, good, poor, goal = C.PROMPT_HISTORY_HEADER, C.PROMPT_LIKED_HEADER, C.PROMPT_DISLIKED_HEADER, C.PROMPT_TARGET_HEADER
    told = [line("A", genres("A"), review("ta", "liked it")), line("B", genres("B"), review("None", "bad one"))]
    brief = [line("A", genres("A")), line("B", genres("B"))]
    want = {
        ("twice", "s"): ("a", head + good + told[0] + "\n\n" + poor + told[1] + "\n\n" + goal + line("A").rstrip()),
        ("twice", "open"): ("a", (head + good + brief[0] + "\n\n" + poor + brief[1]).rstrip()),
        ("none", "s"): (None, None),
        ("bare", "cold"): ("c", (goal + line("C", genres("C"))).strip()),
        ("lost", "no such"): ("b", ""),
        ("gone", "s"): (None, None),
        ("hidden", "cold"): ("c", (goal + line("C", genres("C"))).strip()),
    }
    assert got == want


def test_last_rows_take_one_shuffle_and_no_unread_length(spark):
    rows = [(u, t, t % 5, f"i{t}") for u in (1, 2, None) for t in range(30)]
    df = spark.createDataFrame(rows, "user_id int, ts int, rating int, item_id string")
    s = ops.latest_interactions(df, 10, order_cols=("ts", "rating", "item_id"))
    plan = s.select("user_id", "target", "sampled")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2
    many = ops.latest_interactions(df, 2000, order_cols=("ts", "rating", "item_id"))  # beyond Spark's group limit
    for got, n in ((s, 9), (many, 29)):
        assert [(r["user_id"], r["interaction_len"], r["target"]["ts"], [x["ts"] for x in r["sampled"]]) for r in got.orderBy("user_id").collect()] == [
            (u, 30, 29, list(range(29 - n, 29))) for u in (1, 2)
        ]


def test_kcore_broadcasts_fallen_keys_by_their_number(spark, monkeypatch):
    """Whatever the optimizer would do, the joins with at most BROADCAST_KEYS fallen keys are broadcast
    (no shuffle of the pairs), more are not, and the core is the same."""
    from convrec.session import Generations

    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, *(f"i{n}" for n in range(60))])) for _ in range(420)]
    rows += [(100 + j // 2, f"p{(j + 1) // 2}") for j in range(16)]
    left = rows
    while True:  # plainly: whoever has fewer than 5 rows goes
        left = [r for r in left if None not in r]
        many = lambda n: {k for k in {r[n] for r in left} if sum(r[n] == k for r in left) >= 5}
        kept = [r for r in left if r[0] in many(0) and r[1] in many(1)]
        if kept == left:
            break
        left = kept
    plans, put = [], Generations.put
    monkeypatch.setattr(Generations, "put", lambda self, name, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, name, df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, broadcast in ((500_000, True), (8, True), (0, False)):
            monkeypatch.setattr(ops, "BROADCAST_KEYS", limit)
            plans.clear()
            core = ops.k_core(spark.createDataFrame(rows, "user_id int, item_id string"), 5).core
            assert sorted(tuple(r) for r in core.collect()) == sorted(left) and len(left) > 50
            assert any("BroadcastHashJoin" in p for p in plans) == broadcast
            if limit > 8:
                assert not any("SortMergeJoin" in p for p in plans if "Union" in p)
                # texts are looked up by one whole number, not by a row of a number and a text
                assert any("BroadcastHashJoin [xxhash64(item_id" in p and "HashedRelationBroadcastMode(List(xxhash64(" in p for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
