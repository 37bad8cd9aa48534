"""Every reader and writer once, through files."""

import json
import os

import pytest

from convrec.sources import readers as R
from convrec.sources import sinks as K


def lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    return str(path)


def test_ratings_and_metadata(spark, tmp_path):
    spark.createDataFrame([("u1", "p1", 9)], "user_id string, parent_asin string, other int").write.parquet(str(tmp_path / "r"))
    r = R.read_ratings(spark, str(tmp_path / "r"))
    assert [tuple(x[c] for c in ("user_id", "parent_asin")) for x in r.collect()] == [("u1", "p1")]
    m = R.read_item_meta(spark, lines(tmp_path / "m.jsonl", [{"parent_asin": "p1", "title": "Amélie"}, {"parent_asin": "p2"}]))
    assert {x["parent_asin"]: x["title"] for x in m.collect()} == {"p1": "Amélie", "p2": None}


def test_reviews(spark, tmp_path):
    row = {"user_id": "u", "parent_asin": "p", "rating": 4.0, "title": "t", "text": "é\nx", "timestamp": 1588615855070}
    got = R.read_reviews(spark, lines(tmp_path / "v.jsonl", [row])).first()
    assert got["user_id"] == "u" and got["text"] == "é\nx" and got["rating"] == 4.0


def test_prompts_written_then_read(spark, tmp_path):
    path = str(tmp_path / "prompts")
    K.write_prompts(spark.createDataFrame([("u1", "s", "a\nb", 1)], "user_id string, scenario string, text string, extra int"), path)
    assert [(r["user_id"], r["scenario"], r["text"]) for r in R.read_prompts(spark, path).collect()] == [("u1", "s", "a\nb")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{broken\n")
    with pytest.raises(Exception):
        R.read_prompts(spark, str(bad)).collect()


def test_snapshot_written_then_read(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "user_id int, items array<string>")
    path = K.write_snapshot(df, str(tmp_path), "Movies", "users", 23, 10)
    assert path.endswith("Movies_users_core23_items10")
    assert R.read_snapshot(spark, path).collect() == df.collect()


def test_text_toolkit_and_dictionaries(spark, tmp_path):
    K.write_sft(spark.createDataFrame([("é x", 1)], "text string, n int"), str(tmp_path / "sft"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "sft")).collect()] == [("é x",)]
    K.write_toolkit(spark.createDataFrame([(7, [("u", "tëxt")])], "conv_id int, conv array<struct<role:string,text:string>>"), str(tmp_path / "kit"))
    parts = [p for p in os.listdir(tmp_path / "kit") if p.startswith("part")]
    assert "tëxt" in "".join((tmp_path / "kit" / p).read_text(encoding="utf-8") for p in parts)
    K.write_dictionary(spark.createDataFrame([("a", 1)], "id string, movie_id bigint"), str(tmp_path / "ids"))
    assert [(r["id"], r["movie_id"]) for r in spark.read.json(str(tmp_path / "ids")).collect()] == [("a", 1)]


def test_triples_and_relations(spark, tmp_path):
    (tmp_path / "t.csv").write_text("head_id,relation_id,tail_id\n1,0,5\n")
    (tmp_path / "r.csv").write_text("relation_id,relation_name\n0,directed_by\n")
    from convrec.operators.graph import with_relation_names

    rel = R.read_relations(spark, str(tmp_path / "r.csv"))
    out = with_relation_names(R.read_kg_triples(spark, str(tmp_path / "t.csv")), rel).first()
    assert out["relation_name"] == "directed_by" and str(out["tail_id"]) == "5"


def test_json_array_is_read_by_ranges(spark, tmp_path):
    """Objects with braces, brackets, quotes and backslashes in their strings, cut into ranges of a
    few bytes: the rows of a whole-file read, from many tasks."""
    import random

    rnd = random.Random(8)
    bits = ["}", "{", "]", "[", '"', "\\", "\\\\", ",", "a", "é", "\n", " ", '\\"', "}}", "'x': {"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
    rows = [
        {"asin": f"a{i}", "title": text(), "genres": [{"id": i, "name": text()}, {}], "casts": text(), "keywords": {"k": [text(), {"z": text()}]}}
        for i in range(120)
    ]
    rows += [{}, {"asin": None}]
    data = tmp_path / "movies"
    data.mkdir()
    (data / "one.json").write_text(json.dumps(rows[:70], ensure_ascii=False), encoding="utf-8")
    (data / "two.json").write_text(json.dumps(rows[70:], indent=2), encoding="utf-8")
    (data / "none.json").write_text(" [ ]\n", encoding="utf-8")

    def read_rows(df):
        nested = lambda r: {c: json.loads(r[c]) if r[c] and c in ("genres", "keywords") else r[c] for c in r.__fields__}
        return sorted(str(nested(r)) for r in df.collect())

    whole = read_rows(R._read(spark, str(data), R.MOVIE_TEXT_SCHEMA, multiLine="true"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("400", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            if size == "400":
                assert spark.read.option("lineSep", "}").text(str(data)).rdd.getNumPartitions() > 20
            got = R.json_array_records(spark, str(data)).collect()
            read = read_rows(R.read_movie_json(spark, str(data)))
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        assert read == whole and len(got) == len(rows)
        assert sorted((json.loads(r["record"]) for r in got), key=str) == sorted(rows, key=str)
