"""What both vector searches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def one_per_id(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with v as doubles: usable rows with an id; of rows that repeat an id, the
    smallest vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best ``(query_id, vec_id, score)`` rows of every query, best first, ties to the
    smaller vec_id, with their ``rank`` from 1."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
