"""The registered queries of this subpackage: name -> (function, oracle SQL or None).

Each query applies one operator, with its production parameters, to its whole table and
derives the result columns its contract names."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convrec.llm import bpe, oracles, quality, toxicity
from convrec.llm.block_naming import exact_duplicates
from convrec.llm.common import cut, table, workers_import
from convrec.llm.exact_topk import top_products
from convrec.llm.html_extract import extract_text
from convrec.llm.mixing import sample_mix, word_count
from convrec.llm.nn_descent import nearest_products
from convrec.llm.simhash import near_duplicates
from convrec.llm.term_tree import best_documents
from convrec.llm.token_files import store_and_read
from convrec.llm.url_filter import judge_urls
from convrec.llm.whitening import whiten

LLM_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def llm_query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return fn(spark, sf_dir)

        LLM_REGISTRY[name] = (query, oracle)
        return query

    return deco


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@llm_query("op2_url_filter", oracles.URL_FILTER)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def quality_weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with a ``weight``: labelled good 1, unlabelled 0.5, labelled bad 0.25."""
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("__q"))
    weight = F.when(F.col("__q") == 1, 1.0).when(F.col("__q") == 0, 0.25).otherwise(0.5)
    return docs.join(good, "doc_id", "left").withColumn("weight", weight).drop("__q")


@llm_query("op4_sample_mix", oracles.SAMPLE_MIX)
def op4_sample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = cut(quality_weighted(spark, docs, sf_dir))  # read for the key ranges and for the result
    out = sample_mix(docs, weight_col="weight")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@llm_query("op5_simhash_groups")
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def scored_as_contract(out: DataFrame, parts: int, rest: int) -> DataFrame:
    return out.select(
        "doc_id",
        F.coalesce(quality.held_out("doc_id", parts, rest), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@llm_query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", parts=5, rest=0)
    return scored_as_contract(quality.score_texts(docs, model, keep=["doc_id"]), 5, 0)


@llm_query("op3_toxicity_neighbours")
def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counted = toxicity.fit_and_count(docs, table(spark, sf_dir, "labels"), "toxic", parts=4, rest=2, keep=["doc_id"])
    scored = toxicity.score_texts(docs, model, keep=["doc_id"]) if counted is None else toxicity.score_counted(counted, model)
    return scored_as_contract(scored, 4, 2)


VOCABULARY = "word_bpe_49k.json"


@llm_query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumnRenamed("id", "doc_id")


@llm_query("op8_exact_topk", oracles.EXACT_TOPK)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


@llm_query("op9_nn_descent")
def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@llm_query("op1_site_style_tree")
def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@llm_query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=1)
    return out.withColumnRenamed("id", "doc_id")


@llm_query("op11_block_naming", oracles.BLOCK_NAMING)
def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


@llm_query("op12_term_tree", oracles.TERM_TREE)
def op12_term_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@llm_query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), k=32).withColumnRenamed("id", "vec_id")
