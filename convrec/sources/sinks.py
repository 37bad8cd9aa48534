"""Sinks K1-K7.  All writes are distributed DataFrame writes (no driver-side files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convrec.config import SPECIAL_TOKEN
from convrec.functions.text import file_label
from convrec.operators.graph import upsert_concepts


def snapshot_name(dataset: str, kind: str, k: int, items: int | None = None) -> str:
    """K1 naming: dataset, kind, core k and items per prompt."""
    return f"{dataset}_{kind}_core{k}" + (f"_items{items}" if items is not None else "")


def write_snapshot(df: DataFrame, base: str, dataset: str, kind: str, k: int, items: int | None = None) -> str:
    """K1: Parquet snapshot of user groups or the catalogue."""
    path = f"{base.rstrip('/')}/{snapshot_name(dataset, kind, k, items)}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_prompts(df: DataFrame, path: str) -> None:
    """K2: ``{user_id, scenario, text}`` JSON lines."""
    df.select("user_id", "scenario", "text").write.mode("overwrite").json(path)


def write_sft(df: DataFrame, path: str) -> None:
    """K3: ``{text}`` JSON lines."""
    df.select("text").write.mode("overwrite").json(path)


def split_base_name(domain: str, model: str, special_token: str = SPECIAL_TOKEN) -> str:
    """Base name = domain + model + cleaned special token."""
    return f"{domain}_{model}_{file_label(special_token)}"


def write_splits(df: DataFrame, base: str, domain: str, model: str, special_token: str = SPECIAL_TOKEN) -> str:
    """K4: train / valid / test rows under one folder, one partition per split."""
    path = f"{base.rstrip('/')}/{split_base_name(domain, model, special_token)}"
    df.select("text", "target", "named_items", "scenario", "split").write.mode("overwrite").partitionBy("split").json(path)
    return path


def write_toolkit(df: DataFrame, path: str) -> None:
    """K5: one dialogue document per line (``conv_id``, ``conv``); non-ASCII kept."""
    df.select("conv_id", "conv").write.mode("overwrite").json(path)


def write_dictionary(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K6: two-column dictionaries (movie_ids, entity2id, concept2id, grouped triples)."""
    df.write.mode("overwrite").format(fmt).save(path)


def upsert_concept_dictionary(spark: SparkSession, new: DataFrame, old_path: str | None, out_path: str) -> DataFrame:
    """K7: read the old dictionary when it exists, keep its keys without ``@``, add or
    overwrite with ``new`` and write to ``out_path`` (a new path: the input is never
    overwritten while it is read)."""
    old = None
    if old_path:
        try:
            old = spark.read.schema("concept string, concept_id bigint").json(old_path)
            old.limit(1).count()
        except Exception:  # noqa: BLE001 - a missing dictionary means "create"
            old = None
    merged = upsert_concepts(old, new)
    merged.write.mode("overwrite").json(out_path)
    return spark.read.schema("concept string, concept_id bigint").json(out_path)
