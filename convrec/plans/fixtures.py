"""Stand-in inputs built from the driver's TPC-H-like tables.

Each function only reshapes driver tables into the schema an operator
expects (the same definitions are written in SQL in ``oracle.py``); none of
them does any of the operator's own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convrec.sources.readers import with_arrival


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inter(spark: SparkSession, sf_dir: str, arrival: bool = False) -> DataFrame:
    """Interactions: ``user_id, item_id, rating, ts`` from lineitem joined with orders, with the
    ``arrival`` of the lineitem row if asked for."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    if arrival:
        li = with_arrival(li)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.lit(1) + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).cast("int").alias("rating"),
        F.col("l_shipdate").alias("ts"),
        *(["arrival"] if arrival else []),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews (D5): ``user_id, item_id, rating, title, text, timestamp``; review title and
    body are built from the order row (priority, status, dates)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.lit(1) + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).cast("int").alias("rating"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("l_returnflag") == "R", F.lit("ok"))
        .otherwise(F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus")))
        .alias("text"),
        F.col("l_shipdate").alias("timestamp"),
    )


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item titles: ``item_id, title`` = ``p_name (p_brand) [p_type]``."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ["), F.col("p_type"), F.lit("]")).alias("title"),
    )


def titled_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata ``parent_asin, title`` from part; some titles are null, some too short."""
    p = table(spark, sf_dir, "part")
    full = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ["), F.col("p_type"), F.lit("]"))
    kind = F.col("p_size") % 10
    title = F.when(kind == 1, F.lit("ab")).when(kind != 0, full)
    return p.select(F.col("p_partkey").cast("string").alias("parent_asin"), title.alias("title"))


def movie_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movie file's ids ``asin``: some parts have no entry in it."""
    return table(spark, sf_dir, "part").filter(F.col("p_size") % 10 != 2).select(F.col("p_partkey").cast("string").alias("asin"))


def movie_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested movie metadata (D3) with Python-literal text columns, built from part,
    lineitem (which suppliers deliver a part), supplier and nation.

    cast = the part's distinct suppliers in key order: name, department ('Writing' for keys
    divisible by 4, else 'Acting'), popularity = account balance; crew = the suppliers'
    distinct nations in key order with a department by nation key mod 3.
    """
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    ps = li.join(s, li.l_suppkey == s.s_suppkey)
    cast_entry = F.concat(
        F.lit("{'name': '"), F.col("s_name"), F.lit("', 'known_for_department': '"),
        F.when(F.pmod(F.col("s_suppkey"), F.lit(4)) == 0, F.lit("Writing")).otherwise(F.lit("Acting")),
        F.lit("', 'popularity': "), F.col("s_acctbal").cast("string"),
        F.lit(", 'adult': False, 'profile_path': None}"),
    )
    casts = ps.groupBy(F.col("l_partkey").alias("c_partkey")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", cast_entry.alias("e"))))["e"], ", ").alias("cast_txt")
    )
    pn = ps.join(n, ps.s_nationkey == n.n_nationkey).select("l_partkey", "n_nationkey", "n_name").distinct()
    crew_entry = F.concat(
        F.lit("{'name': '"), F.col("n_name"), F.lit("', 'department': '"),
        F.when(F.pmod(F.col("n_nationkey"), F.lit(3)) == 0, F.lit("Directing"))
        .when(F.pmod(F.col("n_nationkey"), F.lit(3)) == 1, F.lit("Sound"))
        .otherwise(F.lit("Production")),
        F.lit("'}"),
    )
    crews = pn.groupBy(F.col("l_partkey").alias("w_partkey")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", crew_entry.alias("e"))))["e"], ", ").alias("crew_txt")
    )
    key = F.col("p_partkey").cast("string")
    return (
        p.join(casts, F.col("p_partkey") == F.col("c_partkey"), "left")
        .join(crews, F.col("p_partkey") == F.col("w_partkey"), "left")
        .select(
            key.alias("asin"),
            key.alias("parent_asin"),
            F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ["), F.col("p_type"), F.lit("]")).alias("title"),
            F.concat(F.lit("A "), F.lower("p_type"), F.lit(" "), F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string")).alias("overview"),
            F.when(F.pmod(F.col("p_size"), F.lit(2)) == 0, F.concat(F.lit("['"), F.col("p_brand"), F.lit("']")))
            .otherwise(F.col("p_brand")).alias("origin_country"),
            F.concat(F.lit("[{'id': "), F.col("p_size").cast("string"), F.lit(", 'name': '"), F.col("p_type"), F.lit("'}]")).alias("genres"),
            F.concat(F.lit("{'id': 1, 'keywords': [{'name': '"), F.replace(F.col("p_name"), F.lit(" "), F.lit("'}, {'name': '")), F.lit("'}]}")).alias("keywords"),
            F.concat(F.lit("{'cast': ["), F.coalesce(F.col("cast_txt"), F.lit("")), F.lit("], 'crew': ["), F.coalesce(F.col("crew_txt"), F.lit("")), F.lit("]}")).alias("casts"),
            F.when(F.col("p_size") > 25, F.concat(F.lit("{'id': "), F.col("p_size").cast("string"), F.lit(", 'name': '"), F.col("p_type"), F.lit(" collection'}")))
            .otherwise(F.lit("null")).alias("belongs_to_collection"),
            F.concat(F.col("p_name"), F.lit(" on a "), F.lower("p_type"), F.lit(" shelf")).alias("Visual Caption"),
        )
    )


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form dialogue turns ``conv_id, turn, role, text`` (roles user / assistant / system)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def tag_range(spark: SparkSession, sf_dir: str) -> int:
    """Item tags of the stand-in dialogues run over 1.2 times the parts, so some name no item."""
    return table(spark, sf_dir, "part").count() * 12 // 10


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with two item tags appended; generated-dialogue roles (assistant -> AI)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", F.lit("AI")).otherwise(F.col("role")).alias("role"),
        F.concat(
            F.col("text"),
            F.lit(" <id_"), F.pmod(F.col("conv_id") * 37 + F.col("turn") * 11, F.lit(tag_range(spark, sf_dir))).cast("string"), F.lit(">"),
            F.lit(" <id_"), F.pmod(F.col("conv_id") * 5, F.lit(tag_range(spark, sf_dir))).cast("string"), F.lit(">"),
        ).alias("text"),
    )


UNMARKED = (25, 3)  # responses of dialogues whose number leaves this remainder have no markers


def marked(user: str, ai: str):
    plain = F.pmod(F.col("conv_id"), F.lit(UNMARKED[0])) == UNMARKED[1]
    role = F.col("role")
    return F.when(plain, "").when(role == user, "[USR]: ").when(role == ai, "[AI]: ").otherwise("")


def marker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated responses with markers: per dialogue, ``[USR]: `` / ``[AI]: `` + text joined by
    newlines in turn order; a system turn is unmarked text, and some responses have no marker
    at all (``marked``).  Columns ``conv_id, response``."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(marked("user", "assistant"), F.col("text"))
    return c.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n").alias("response")
    )


def tagged_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tagged`` folded into one row per dialogue: ``conv_id, conversation array<struct<role, content>>``
    (system turns kept, turn order) and ``target_asin`` = the second tag's key of the dialogue."""
    t = tagged(spark, sf_dir)
    return t.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")),
        ).alias("conversation"),
        F.pmod(F.col("conv_id") * 5, F.lit(tag_range(spark, sf_dir))).cast("string").alias("target_asin"),
    )


def tagged_marker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated responses (D8 of stage C): ``[USR]: ``/``[AI]: `` lines of the tagged turns (system
    turns unmarked, some responses without markers), ``target_asin`` and a scenario name from
    the conv_id."""
    from convrec.config import SCENARIOS
    from convrec.functions.text import seeded_bucket

    c = tagged(spark, sf_dir)
    line = F.concat(marked("user", "AI"), F.col("text"))
    g = c.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n").alias("response")
    )
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    return g.select(
        "conv_id",
        "response",
        F.pmod(F.col("conv_id") * 5, F.lit(tag_range(spark, sf_dir))).cast("string").alias("target_asin"),
        F.element_at(names, (seeded_bucket("conv_id", 5) + 1).cast("int")).alias("scenario"),
    )


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat``: per dialogue, the chat-template text of all its turns (``conv_id, text``)."""
    from convrec.functions.dialogue import render_chat

    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")),
        ).alias("m")
    )
    return g.select("conv_id", render_chat(F.col("m")).alias("text"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ent_p`` source: one ``name`` row per part name."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_p``: per part, ``'i like the <name>, and <name of part (key*7) mod parts>!'``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    p2 = p.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("n2"))
    return p.join(p2, F.pmod(F.col("p_partkey") * 7, F.lit(p.count())) == F.col("k2")).select(
        F.col("p_partkey").alias("text_id"),
        F.concat(F.lit("i like the "), F.col("p_name"), F.lit(", and "), F.col("n2"), F.lit("!")).alias("text"),
    )


def part_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fuzzy_p``: per part, its name with the last character replaced by ``x``."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("text_id"),
        F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("x")).alias("text"),
    )


def mention_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ent_m`` source: the whole names of parts, suppliers, nations and regions."""
    out = None
    for t, c in (("part", "p_name"), ("supplier", "s_name"), ("nation", "n_name"), ("region", "r_name")):
        names = table(spark, sf_dir, t).select(F.col(c).alias("name"))
        out = names if out is None else out.unionByName(names)
    return out


def mention_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns that name things: each whole turn with a part's name behind it, and a last
    turn per dialogue that is a part's name with its last letter mistyped."""
    c = table(spark, sf_dir, "conversations")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = part.count()
    said = c.join(part, F.pmod(F.col("conv_id") * 37 + F.col("turn") * 11, F.lit(n)) == F.col("p_partkey"))
    said = said.select("conv_id", "turn", "role", F.concat("text", F.lit(" "), "p_name").alias("text"))
    typo = F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("x")).alias("text")
    last = c.select("conv_id").distinct().join(part, F.pmod(F.col("conv_id") * 7, F.lit(n)) == F.col("p_partkey"))
    return said.unionByName(last.select("conv_id", F.lit(100_000).cast("bigint").alias("turn"), F.lit("user").alias("role"), typo))


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kg``: ``(s_nationkey, 0, s_suppkey)`` per supplier and ``(n_regionkey, 1, n_nationkey)`` per nation."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("head_id"), F.lit(0).alias("relation_id"), F.col("s_suppkey").cast("string").alias("tail_id")
    )
    n = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("head_id"), F.lit(1).alias("relation_id"), F.col("n_nationkey").cast("string").alias("tail_id")
    )
    return s.unionByName(n)


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KG entity table ``id, name``: nations and regions (ids of regions offset by 1000)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("string").alias("id"), F.col("r_name").alias("name"))
    return n.unionByName(r)


def old_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing concept dictionary: ``<id_k>`` -> 0 for every part and a
    ``@``-key per nation (which the upsert drops)."""
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.col("n_name"), F.lit("@kg")).alias("concept"), F.col("n_nationkey").cast("bigint").alias("concept_id")
    )
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("<id_"), F.col("p_partkey").cast("string"), F.lit(">")).alias("concept"), F.lit(0).cast("bigint").alias("concept_id")
    )
    return n.unionByName(p)


def item_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata (D2) from part: description = [type], features = the words of the name,
    details = size text, price = retail price text (null for sizes above 45), categories =
    [type, brand] for even sizes (null otherwise)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ["), F.col("p_type"), F.lit("]")).alias("title"),
        F.array(F.col("p_type")).alias("description"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("details"),
        F.split(F.col("p_name"), " ").alias("features"),
        F.when(F.col("p_size") <= 45, F.col("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_type"), F.col("p_brand"))).alias("categories"),
    )
