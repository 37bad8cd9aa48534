"""Entity-mention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convrec.functions.ngrams import char_ngrams
from convrec.operators.mentions import detect_mentions, dialogue_mentions, entity_set, mentions_per_text
from convrec.plans import fixtures as fx
from convrec.plans import oracle as sql
from convrec.plans.registry import register


def _rounded(df):
    return df.select("text_id", "entity", F.round("score", 6).alias("score"))


@register("j10_t9_t11_mentions_text_p", sql.with_(sql.ENT_P, sql.TEXT_P) + sql.mentions_sql())
def mentions_text_p(spark, sf_dir):
    ents = entity_set(fx.part_names(spark, sf_dir))
    return _rounded(detect_mentions(fx.part_texts(spark, sf_dir), ents, key_cols=["text_id"]))


_HOT = """ents AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1) || ' of ' || split_part(p_name, ' ', 2)) AS entity FROM part),
texts AS (SELECT p.p_partkey AS text_id, 'the ' || split_part(p.p_name, ' ', 1) || ' of ' || split_part(p.p_name, ' ', 2) || ' and the '
                 || split_part(p.p_name, ' ', 2) || ', of ' || split_part(p2.p_name, ' ', 1) || '!' AS text
          FROM part p JOIN part p2 ON p2.p_partkey = (p.p_partkey * 7) % (SELECT count(*) FROM part))"""


@register("t9_hot_word_entities", sql.with_(_HOT) + sql.mentions_sql())
def hot_word_entities(spark, sf_dir):
    """Entities "a of b" whose words all stand in many texts: found through pairs of neighbours."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    first, second = F.element_at("w", 1), F.coalesce(F.try_element_at("w", F.lit(2)), F.lit(""))
    ents = entity_set(p.select(F.lower(F.concat(first, F.lit(" of "), second)).alias("name")))
    other = p.select(F.col("p_partkey").alias("k"), first.alias("o"))
    t = p.join(other, F.col("k") == F.pmod(F.col("p_partkey") * 7, F.lit(p.count())))
    text = F.concat(F.lit("the "), first, F.lit(" of "), second, F.lit(" and the "), second, F.lit(", of "), F.col("o"), F.lit("!"))
    return _rounded(detect_mentions(t.select(F.col("p_partkey").alias("text_id"), text.alias("text")), ents, key_cols=["text_id"], frequent=20))


@register("t11_fuzzy_mentions_p", sql.with_(sql.ENT_P, sql.FUZZY_P) + sql.mentions_sql())
def mentions_fuzzy_p(spark, sf_dir):
    ents = entity_set(fx.part_names(spark, sf_dir))
    return _rounded(detect_mentions(fx.part_typos(spark, sf_dir), ents, key_cols=["text_id"]))


@register(
    "u2_entity_set",
    "SELECT DISTINCT lower(p_name) AS entity FROM part WHERE p_name NOT IN ('about', 'by', 'of', 'for')",
)
def u2_entity_set(spark, sf_dir):
    return entity_set(fx.part_names(spark, sf_dir))


@register(
    "t10_char_ngrams",
    f"SELECT p_partkey AS item_id, CAST(len({sql.ngram_sql('p_name')}) AS BIGINT) AS n_grams,"
    f" array_to_string(list_sort({sql.ngram_sql('p_name')}), '|') AS grams FROM part",
)
def t10_ngrams(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    g = char_ngrams("p_name", 3)
    return p.select(
        F.col("p_partkey").alias("item_id"), F.size(g).cast("bigint").alias("n_grams"), F.array_join(F.array_sort(g), "|").alias("grams")
    )


@register(
    "w6_mentions_sorted_text_p",
    sql.with_(sql.ENT_P, sql.TEXT_P)
    + sql.mentions_sql().replace("SELECT text_id, entity, CASE", "SELECT text_id, entity, CASE", 1)
    .replace(", tw AS", ", tw AS", 1)
    .rsplit("SELECT text_id, entity, CASE", 1)[0]
    + """, m AS (SELECT text_id, entity, CASE WHEN exact THEN 1.0 ELSE round(i / u, 6) END AS score FROM pairs
WHERE exact OR (len(eg) >= 2 AND i >= 0.7 * len(eg) AND i / u >= 0.7))
SELECT text_id, string_agg(entity || ':' || CAST(score AS VARCHAR), ',' ORDER BY score DESC, entity) AS mentions FROM m GROUP BY text_id""",
)
def w6_sorted(spark, sf_dir):
    ents = entity_set(fx.part_names(spark, sf_dir))
    m = mentions_per_text(_rounded(detect_mentions(fx.part_texts(spark, sf_dir), ents, key_cols=["text_id"])), ["text_id"])
    return m.select(
        "text_id",
        F.array_join(F.transform("mentions", lambda x: F.concat(x["entity"], F.lit(":"), F.format_number(x["score"], 1).cast("string"))), ",").alias("mentions"),
    )


def t12_dialogue_mentions(spark, sf_dir):
    """T12 over the whole conversations table with the names of parts, suppliers, nations, regions."""
    c = fx.mention_turns(spark, sf_dir)
    d = c.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")),
        ).alias("conversation")
    )
    ents = entity_set(fx.mention_names(spark, sf_dir))
    return dialogue_mentions(d, ents)


_T12_SQL = (
    sql.with_(sql.MENTION_NAMES, sql.MENTION_TURNS)
    + """, msgs AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx, role, text FROM mturns)"""
    + sql.unicode_mentions_sql()
    + """
SELECT g.conv_id, g.idx, g.role,
       coalesce((SELECT string_agg(m.entity || ':' || CAST(m.score AS VARCHAR), ',' ORDER BY m.score DESC, m.entity)
                 FROM m WHERE m.conv_id = g.conv_id AND m.idx = g.idx), '') AS mentions
FROM msgs g"""
)


@register("t12_dialogue_mentions", _T12_SQL)
def t12_query(spark, sf_dir):
    r = t12_dialogue_mentions(spark, sf_dir)
    return r.select("conv_id", F.posexplode("conversation").alias("idx", "m")).select(
        "conv_id",
        F.col("idx").cast("bigint").alias("idx"),
        F.col("m.role").alias("role"),
        F.array_join(
            F.transform("m.mentions", lambda x: F.concat(x["entity"], F.lit(":"), F.round(x["score"], 6).cast("string"))), ","
        ).alias("mentions"),
    )
