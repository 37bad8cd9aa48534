"""Golden rows for scalar / array functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec import schemas
from convrec.functions.dialogue import last_marker_line, parse_chat, parse_markers, render_chat
from convrec.functions.literals import parse_literal, safe_list, safe_string
from convrec.functions.ngrams import char_ngrams
from convrec.functions.text import clean_title, replace_all, stable_id, usplit, ustrip


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_marker_parse_golden(spark):
    cases = {
        "pre [USR] [AI] hi [USR]: a [AI]": [("user", "[AI]"), ("user", "a")],
        "[AI][AI]:[USR]q": [("AI", "[AI]:"), ("user", "q")],
        "[USR]::b [AI] c": [("user", ":b"), ("AI", "c")],
        "no markers": [],
        "": [],
        "a[USR]:": [],
        "[USR]: hello there\n[AI]: hi!\n[USR]: bye": [("user", "hello there"), ("AI", "hi!"), ("user", "bye")],
    }
    for text, want in cases.items():
        got = one(spark, parse_markers(F.col("v")), text)
        assert [(m["role"], m["content"]) for m in got] == want, text


def test_last_marker_line(spark):
    r = one(spark, last_marker_line(F.col("v")), "intro\n[USR]: a [USR]: b\n[AI]: c\nnoise")
    assert (r["role"], r["content"]) == ("AI", "c")
    assert one(spark, last_marker_line(F.col("v")), "nothing here") is None


def test_clean_title(spark):
    assert one(spark, clean_title(F.col("v")), "Alien (1979) [DVD) x") == "Alien   x"
    assert one(spark, clean_title(F.col("v")), "(all)") == ""


def test_safe_list(spark):
    df = spark.createDataFrame([(None,), ("['US','GB']",), ("US",), ("5",)], "v string")
    got = [r["r"] for r in df.select(safe_list(F.col("v")).alias("r")).collect()]
    assert got == [[], ["US", "GB"], ["US"], ["5"]]


def test_safe_string(spark):
    df = spark.createDataFrame([(None,), ("null",), ("x",)], "v string")
    assert [r["r"] for r in df.select(safe_string(F.col("v")).alias("r")).collect()] == ["", "", "x"]


def test_python_literal_parse(spark):
    cast_schema = T.ArrayType(
        T.StructType([T.StructField("name", T.StringType()), T.StructField("adult", T.BooleanType()), T.StructField("profile_path", T.StringType())])
    )
    r = one(spark, parse_literal(F.col("v"), cast_schema), "[{'name': \"O'Hara\", 'adult': False, 'profile_path': None}]")
    assert len(r) == 1 and r[0]["name"] == "O'Hara" and r[0]["adult"] is False and r[0]["profile_path"] is None
    r = one(spark, parse_literal(F.col("v"), cast_schema), "[{'name': 'He said \"None, True\"', 'adult': True}]")
    assert r[0]["name"] == 'He said "None, True"' and r[0]["adult"] is True
    r = one(spark, parse_literal(F.col("v"), schemas.NAMED), "[{'name': 'caf\\xe9'}]")
    assert r[0]["name"] == "café"
    assert one(spark, parse_literal(F.col("v"), schemas.NAMED), "not a literal (") is None


def test_python_literal_paths_agree(spark):
    """Plain text, text with double quotes or escapes, and strings that hold keywords."""
    import ast

    from convrec.functions.literals import python_literal_to_json

    plan = spark.range(1).select(python_literal_to_json(F.lit("[None]").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "contains(" in plan.lower()  # plain text is not cut into placeholders
    values = [
        [None, "a", True], ["None", "True False"], ["O'Hara", None], ["a\\xNone", None], ["caf\xe9 \\ x", False], ["xNone", "None1"],
        ["it's \"None\"", True, None], [],
    ]
    rows = [(repr(v),) for v in values] + [("['caf\\xe9', None]",), ("['open, None]",), ("[None, 'x'",), (None,)]
    got = [r["v"] for r in spark.createDataFrame(rows, "s string").select(parse_literal("s", T.ArrayType(T.StringType())).alias("v")).collect()]
    text = lambda x: x if x is None or isinstance(x, str) else str(x).lower()
    assert got[: len(values)] == [[text(x) for x in v] for v in values]
    assert got[len(values)] == [text(x) for x in ast.literal_eval(rows[len(values)][0])]
    assert got[-3] is None and got[-1] is None


def test_strip_split_unicode(spark):
    assert one(spark, ustrip(F.col("v")), "　 a b\n\t") == "a b"
    assert one(spark, usplit(F.col("v")), "  a　b\n c ") == ["a", "b", "c"]
    assert one(spark, usplit(F.col("v")), "   ") == []


def test_replace_all_sequential(spark):
    df = spark.createDataFrame([("a b a",)], "v string")
    pairs = F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("b").alias("old"), F.lit("c").alias("new")))
    assert df.select(replace_all(F.col("v"), pairs).alias("r")).first()["r"] == "c c c"


def test_ngrams(spark):
    assert one(spark, char_ngrams(F.col("v"), 3), "ab") == []
    assert sorted(one(spark, char_ngrams(F.col("v"), 3), "Ab-c!")) == ["ab ", "b c"]


def test_stable_id_is_stable(spark):
    a = one(spark, stable_id(F.col("v")), "x")
    assert a == one(spark, stable_id(F.col("v")), "x") and a >= 0


def test_chat_render_parse_roundtrip(spark):
    msgs = [("system", "be kind"), ("user", "hi\nthere"), ("assistant", "hello")]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    text = df.select(render_chat(F.col("m")).alias("t")).first()["t"]
    back = spark.createDataFrame([(text,)], "v string").select(parse_chat(F.col("v")).alias("r")).first()["r"]
    assert [(x["role"], x["content"]) for x in back] == msgs


def test_strip_looks_at_the_ends_only(spark):
    """The same as the pattern of Unicode white space for every character at the ends and inside, without a
    pattern (one that ends in ``$`` is tried at every character)."""
    from convrec.functions.text import ustrip

    chars = spark.range(1, 0x11000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    t = chars.selectExpr("stack(4, concat(c, '\\n', c, ' a ', c, 'b', c, '\\n', c), c, concat(' ', c), concat(c, 'a', c, '\\r\\n')) as t")
    assert t.filter(~ustrip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert t.filter(ustrip("t") == "").count() > 40
    ends = spark.createDataFrame([(None,), ("",), (" 　\n",)], "t string").select(ustrip("t").alias("s"))
    assert [r["s"] for r in ends.collect()] == [None, "", ""]
    assert "regexp" not in ends._jdf.queryExecution().analyzed().toString()
