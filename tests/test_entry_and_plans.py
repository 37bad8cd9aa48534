"""Driver contract, plan checks and source/sink round trips."""

import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001, SF01

PY_EVAL = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "scenario", "target_item", "prompt"]
    assert df.count() > 0


def test_every_query_has_a_name_prefix_and_most_have_oracles():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    own = {q for q in qs if q != "pipeline" and not q.startswith("op")}
    assert len(own - set(orc)) <= 1
    for name in own:
        assert name[0] in "afjknptuw" and "_" in name


@pytest.mark.parametrize("name", ["t8_j9_id_to_title", "p2_stratified_split", "t4_marker_parse", "u2_entity_set"])
def test_plans_have_no_python_evaluation(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in PY_EVAL), plan


def test_scan_prunes_columns(spark):
    df = E.queries()["a2_user_counts"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["a1_kcore_k23", "t8_j9_id_to_title", "p2_stratified_split", "t4_marker_parse", "j10_t9_t11_mentions_text_p"])
def test_oracle_matches_at_sf0_01(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(str(v) if not isinstance(v, float) else round(v, 6) for v in r) for r in res.fetchall())
    df = E.queries()[name](spark, SF01).select(*cols)
    got = sorted(tuple(str(v) if not isinstance(v, float) else round(v, 6) for v in r) for r in df.collect())
    assert got == want


def test_sources_and_sinks_roundtrip(spark):
    from convrec.sources import readers as R
    from convrec.sources import sinks as K

    base = tempfile.mkdtemp(prefix="convrec-io-")
    rows = spark.createDataFrame(
        [("t1", ["<id_1>"], ["<id_1>"], "Cold-Start Browser", "train"), ("t2", ["<id_2>"], [], "History-Only Explorer", "test")],
        "text string, target array<string>, named_items array<string>, scenario string, split string",
    )
    path = K.write_splits(rows, base, "Movies_and_TV", "llama3.1")
    assert path.endswith("Movies_and_TV_llama3.1_reserved_special_token_10")
    back = R.read_splits(spark, path)
    assert sorted((r["text"], r["split"]) for r in back.collect()) == [("t1", "train"), ("t2", "test")]

    kg = os.path.join(base, "kg.csv")
    with open(kg, "w") as f:
        f.write("id,name\n1,Tom Hanks\n2,Drama\n")
    ents = R.read_kg_entities(spark, kg)
    assert [tuple(r) for r in ents.orderBy("id").collect()] == [("1", "Tom Hanks", "Tom Hanks"), ("2", "Drama", "Drama")]

    movies = os.path.join(base, "movies.json")
    with open(movies, "w") as f:
        f.write('[{"asin": "m1", "title": "T", "genres": [{"name": "Drama"}], "casts": "{\'cast\': [], \'crew\': []}"}]')
    m = R.read_movie_json(spark, movies)
    from convrec.operators.catalog import build_catalogue

    c = build_catalogue(m).first()
    assert c["Genres"] == ["Drama"] and c["parent_asin"] == "m1" and c["Acting"] == []

    bad = os.path.join(base, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"prompt": "p", "response": "r"}\n{not json\n')
    with pytest.raises(Exception):
        R.read_responses(spark, bad).collect()

    new = spark.createDataFrame([("<id_1>", 5)], "concept string, concept_id bigint")
    out = K.upsert_concept_dictionary(spark, new, os.path.join(base, "missing"), os.path.join(base, "c1"))
    assert out.count() == 1
    out2 = K.upsert_concept_dictionary(spark, spark.createDataFrame([("<id_2>", 6)], "concept string, concept_id bigint"), os.path.join(base, "c1"), os.path.join(base, "c2"))
    assert sorted(r["concept"] for r in out2.collect()) == ["<id_1>", "<id_2>"]


def test_top_actors_parses_casts_once(spark):
    """The filter on the actors stays above the projection that parses them."""
    import re

    from convrec.plans.q_stage_a import w1_top_actors

    plan = w1_top_actors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", plan)) == 1
