"""Knowledge-graph and dictionary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convrec.config import RELATIONS
from convrec.operators import graph as g
from convrec.operators import interactions as ops
from convrec.operators.dialogue import title_dictionary
from convrec.plans import fixtures as fx
from convrec.plans import oracle as sql
from convrec.plans.registry import register

UNROLL = 24


@register(
    "a8_n19_grouped_triples",
    sql.with_(sql.KG)
    + "SELECT CAST(head_id AS VARCHAR) AS head_id, row_number() OVER (PARTITION BY head_id ORDER BY relation_id, tail_id) AS pos,"
    " relation_id, tail_id, count(*) OVER (PARTITION BY head_id) AS n FROM kg",
)
def a8_triples(spark, sf_dir):
    return g.group_triples(fx.kg_triples(spark, sf_dir))


@register(
    "j12_relation_names",
    sql.with_(sql.KG)
    + ", rel AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in RELATIONS)
    + ") v(relation_id, relation_name))"
    " SELECT head_id, relation_id, tail_id, relation_name FROM kg LEFT JOIN rel USING (relation_id)",
)
def j12_relations(spark, sf_dir):
    return g.with_relation_names(fx.kg_triples(spark, sf_dir)).select("head_id", "relation_id", "tail_id", "relation_name")


def _core_items(spark, sf_dir, k=23):
    c = ops.k_core(fx.inter(spark, sf_dir).select("user_id", "item_id"), k).core  # all that the sets hold
    return g.user_item_sets(c)


_CORE = sql.with_(sql.INTER, sql.kcore_cte(23, UNROLL))


@register("a9_user_item_sets_k23", _CORE + "SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, CAST(item_id AS VARCHAR) AS item FROM core")
def a9_sets(spark, sf_dir):
    return _core_items(spark, sf_dir)


@register("a10_all_items_k23", _CORE + "SELECT DISTINCT CAST(item_id AS VARCHAR) AS id FROM core")
def a10_all(spark, sf_dir):
    return g.all_items(_core_items(spark, sf_dir))


@register(
    "j13_u1_entity2id_k23",
    sql.with_(sql.INTER, sql.kcore_cte(23, UNROLL), sql.CAT, sql.DICT, sql.KG_ENT)
    + """, items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id FROM core),
named AS (SELECT i.id, d.title AS name FROM items i JOIN dict d ON i.id = d.k)
SELECT id, name FROM named
UNION ALL SELECT id, min(name) FROM kgent WHERE id NOT IN (SELECT id FROM named) GROUP BY id""",
)
def u1_entity2id(spark, sf_dir):
    dic = title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    items = g.item_names(g.all_items(_core_items(spark, sf_dir)), dic)
    return g.entity_mapping(fx.kg_entities(spark, sf_dir), items)


@register(
    "n17_movie_ids_k23",
    _CORE + f", items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id FROM core) SELECT id, {sql.sid('id')} AS movie_id FROM items",
)
def n17_movie_ids(spark, sf_dir):
    return g.movie_ids(g.all_items(_core_items(spark, sf_dir)))


@register(
    "t17_concept2id",
    sql.with_(sql.CAT, sql.DICT) + f"SELECT '<id_' || k || '>' AS concept, {sql.sid('title')} AS concept_id FROM dict",
)
def t17_concepts(spark, sf_dir):
    return g.concept_ids(title_dictionary(fx.cat(spark, sf_dir), "item_id", "title"))


@register(
    "k7_concept_upsert",
    sql.with_(sql.CAT, sql.DICT)
    + f""", new AS (SELECT '<id_' || k || '>' AS concept, {sql.sid('title')} AS concept_id FROM dict),
old AS (SELECT n_name || '@kg' AS concept, CAST(n_nationkey AS BIGINT) AS concept_id FROM nation
        UNION ALL SELECT '<id_' || CAST(p_partkey AS VARCHAR) || '>', CAST(0 AS BIGINT) FROM part)
SELECT * FROM old WHERE concept NOT LIKE '%@%' AND concept NOT IN (SELECT concept FROM new) UNION ALL SELECT * FROM new""",
)
def k7_upsert(spark, sf_dir):
    new = g.concept_ids(title_dictionary(fx.cat(spark, sf_dir), "item_id", "title"))
    return g.upsert_concepts(fx.old_concepts(spark, sf_dir), new)
