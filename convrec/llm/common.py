"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convrec.session import staged

# ASCII letters only: the contracts lower-case A-Z and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A word is a run of characters other than the space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, whatever their working
    folder (a cluster that has it installed does not need this and is not disturbed)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task (made by ``make`` when ``key`` is new).  It keeps
    one such thing: a worker that turns to another operator's tasks forgets what it learned for
    the one before, so the stages of a session do not add up in memory."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    _KEPT.clear()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, so that several readers (or later rounds) do
    not recompute it and a lost executor costs nothing."""
    return staged(df, "cut")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; null texts become empty.
    Whatever else the input carries (clashing names included) is left behind."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
