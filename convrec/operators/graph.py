"""Knowledge-graph and dictionary operators.

Dictionaries stay two-column DataFrames (never driver maps); writes go through
``convrec.sources.sinks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from convrec.config import relations_table
from convrec.functions.text import item_tag, stable_id


def group_triples(triples: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """A8 + N19: triples grouped by head, in long form: ``head_id string, pos, relation_id,
    tail_id`` with ``pos`` from 1 in ``order_cols`` order (file order when given, else
    relation_id, tail_id), and ``n``, the head's triples.

    One row per triple whatever the head's size, so a head holding a third of all triples is
    neither one row nor one task (``rank_within`` splits it by ranges)."""
    from convrec.operators.interactions import rank_within

    order = order_cols or ["relation_id", "tail_id"]
    t = triples.withColumn("head_id", F.col("head_id").cast("string"))
    r = rank_within(t, ["head_id"], order)
    return r.select("head_id", F.col("__pos").alias("pos"), "relation_id", "tail_id", F.col("__len").alias("n"))


def with_relation_names(triples: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Relation name per triple.  The library's own relation dictionary has 15 fixed rows and
    is broadcast; of a table the caller passes in AQE decides by its size."""
    rel = relations if relations is not None else F.broadcast(relations_table(triples.sparkSession))
    return triples.join(rel, "relation_id", "left")


def user_item_sets(inter: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """The distinct items of each user, as distinct ``(user, item)`` rows (a set per user
    in long form: de-duplicated by a partial aggregate, never gathered per user)."""
    return inter.select(user_col, F.col(item_col).cast("string").alias("item")).distinct()


def all_items(user_items: DataFrame, item_col: str = "item") -> DataFrame:
    """A10: distinct items over all users (``id``)."""
    return user_items.select(F.col(item_col).alias("id")).distinct()


def item_names(items: DataFrame, dictionary: DataFrame, strict: bool = False) -> DataFrame:
    """``id, title`` for every item id; an id missing from the dictionary is dropped
    (``strict=True`` raises instead, as the reference's lookup does)."""
    j = items.join(dictionary.select(F.col("key").alias("id"), "title"), "id", "left")
    if strict:
        missing = j.filter(F.col("title").isNull()).limit(1).count()
        if missing:
            raise KeyError("item id missing from the title dictionary")
    return j.filter(F.col("title").isNotNull())


def entity_mapping(kg_entities: DataFrame, items: DataFrame) -> DataFrame:
    """Id -> name over KG entities and catalogue items; for an id in both, the item wins
    (among several KG rows of one id the smallest name wins)."""
    kg = kg_entities.select(F.col("id").cast("string").alias("id"), F.col("name"), F.lit(0).alias("__src"))
    it = items.select(F.col("id").cast("string").alias("id"), F.col("title").alias("name"), F.lit(1).alias("__src"))
    w = Window.partitionBy("id").orderBy(F.col("__src").desc(), F.col("name"))
    return kg.unionByName(it).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("id", "name")


def movie_ids(items: DataFrame) -> DataFrame:
    """T17 ``movie_ids``: item id -> stable integer of the id."""
    return items.select("id", stable_id("id").alias("movie_id"))


def concept_ids(dictionary: DataFrame) -> DataFrame:
    """T17 ``concept2id``: ``<id_X>`` -> stable integer of the cleaned title (equal titles share one, Q27)."""
    return dictionary.select(item_tag("key").alias("concept"), stable_id("title").alias("concept_id"))


def upsert_concepts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """K7: keep old keys that contain no ``@``, add or overwrite with the new ones; no old
    dictionary -> the new one."""
    if old is None:
        return new
    kept = old.filter(~F.col("concept").contains("@")).join(new.select("concept"), "concept", "left_anti")
    return kept.unionByName(new)

