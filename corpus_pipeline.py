"""A small training-data pipeline: STAGES over ``documents``, each stage's result written as
Parquet and read again by the next.

``quality``   documents that the quality classifier rejects (score below 0.3) go
``toxicity``  documents whose nearest labelled examples say toxic (score 0.3 or more) go
``near_dups`` one document of each SimHash group (4-word shingles, 4 bits) stays
``mixing``    documents are repeated or left out until the sources have their target weights
``bpe``       token counts and digests of the encoded and the decoded texts

Every stage works on all rows its predecessor kept and on whole texts.  Null texts count as
empty; other columns are carried along; an empty table stays empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from convrec.llm import bpe, quality, toxicity
from convrec.llm.common import cut, table, workers_import
from convrec.llm.mixing import length_weight, repeat_rows, sample_mix, word_count
from convrec.llm.simhash import near_duplicates
from convrec.session import scratch_path

REJECT_QUALITY_BELOW = 0.3
REJECT_TOXIC_FROM = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", parts=5, rest=0)
    scored = quality.score_texts(docs.drop("score"), model)
    return scored.filter(F.col("score") >= REJECT_QUALITY_BELOW).select(*docs.drop("score").columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import(spark)
    # whole texts and all columns travel to the workers, which hold the index of all examples beside
    # them: batches of this many rows, from here on, keep both within an executor's memory
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", parts=4, rest=2)
    scored = toxicity.score_texts(docs.drop("score", "evidence"), model, shown=0)
    return scored.filter(F.col("score") < REJECT_TOXIC_FROM).select(*docs.drop("score", "evidence").columns)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (of repeated rows with that id,
    the one that comes first by text and then by its other columns).  Rows without an id have no smallest one and stay."""
    workers_import(spark)
    groups = cut(near_duplicates(docs, shingle=4, max_bits=4).select("id", "component_id"))
    # written, so that the join knows their size: few or many decide whether documents are shuffled
    gone = cut(groups.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("doc_id")).distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.filter("id is not null").groupBy("id").count().filter("count > 1").select(F.col("id").alias("doc_id"))
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    first = F.struct(F.coalesce("text", F.lit("")), *[F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    once = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), first).alias("r")).select("r.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = word_count(F.col("text"))
    sized = docs.withColumns({"__size_of": size, "__weight": length_weight(F.col("text"), size)})
    mixed = sample_mix(sized, size_col="__size_of", weight_col="__weight")
    return repeat_rows(mixed, docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dups", near_dups_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# The classifiers are trained models, which SQL cannot express; tests compare the stages with
# plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
