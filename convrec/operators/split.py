"""Reproducible splits.

Rows are ordered by a seeded md5 of their key (W12), which Spark and SQL engines
compute alike and which does not depend on partitioning.  The first so many rows of
a stratum in this order are train, and so on, so a split is known by two order keys
per stratum: the last of train and the last of valid.  Only stratum and key are read
to find them; the rows themselves are never shuffled, they are compared with the two
keys of their stratum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convrec.functions.text import seeded_order_key
from convrec.session import staged


def check_ratios(*shares: float) -> None:
    """The shares of a split make up the whole (to ten decimals)."""
    if not math.isclose(sum(shares), 1.0, rel_tol=0.0, abs_tol=1e-10):
        raise ValueError(f"shares {shares} do not make up the whole")


def _cuts(rows: DataFrame, key: str, stratum: Column, seed: int, bucket_hex: int, ends: Callable[[Column], list[Column]]) -> DataFrame:
    """One row a stratum, ``(__s, __c0, __c1)``: the order keys of the rows at the places
    ``ends(size of the stratum)``; null where the place is 0.

    Rows are counted per stratum and bucket (a prefix of the order key; a partial aggregate), prefix
    sums say in which bucket a place lies, and only the rows of that bucket are ranked."""
    ok = seeded_order_key(key, seed)
    narrow = rows.select(stratum.alias("__s"), F.struct(ok.alias("ok"), F.col(key).alias("key")).alias("__o"), F.substring(ok, 1, bucket_hex).alias("__b"))
    sizes = narrow.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__bn"))
    w = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__bn").over(w), F.lit(0))).withColumn("__n", F.sum("__bn").over(Window.partitionBy("__s")))
    places = F.array(*[F.struct(F.lit(i).alias("which"), (e - F.col("__off")).cast("long").alias("at")) for i, e in enumerate(ends(F.col("__n")))])
    holding = sizes.select("__s", "__b", "__bn", F.explode(places).alias("p")).filter((F.col("p.at") >= 1) & (F.col("p.at") <= F.col("__bn")))
    holding = holding.select(F.col("__s").alias("s"), F.col("__b").alias("b"), "p.which", "p.at")
    near = narrow.join(holding, F.col("__s").eqNullSafe(F.col("s")) & F.col("__b").eqNullSafe(F.col("b")))
    place = F.row_number().over(Window.partitionBy("__s", "__b", "which").orderBy("__o"))
    found = near.withColumn("__r", place).filter(F.col("__r") == F.col("at"))
    return found.groupBy("__s").agg(*[F.max(F.when(F.col("which") == i, F.col("__o"))).alias(f"__c{i}") for i in (0, 1)])


def _labelled(df: DataFrame, key: str, stratum: Column, seed: int, bucket_hex: int, written: bool, ends: Callable[[Column], list[Column]]) -> DataFrame:
    rows = df if written else staged(df, "split-rows")
    cuts = staged(_cuts(rows, key, stratum, seed, bucket_hex, ends), "split-cuts")
    own = F.struct(seeded_order_key(key, seed).alias("ok"), F.col(key).alias("key"))
    label = F.when(own <= F.col("__c0"), "train").when(own <= F.col("__c1"), "valid").otherwise("test")
    return rows.join(cuts, stratum.eqNullSafe(F.col("__s")), "left").select(*df.columns, label.alias("split"))


def stratified_split(
    df: DataFrame,
    stratum: str = "scenario",
    key: str = "conv_id",
    valid: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    bucket_hex: int = 3,
    written: bool = False,
) -> DataFrame:
    """Per stratum of size n: ``n_test = max(1, floor(n*test))``, ``n_val = max(1,
    floor(n*valid))``, ``n_train = n - n_test - n_val``; in seeded order the first n_train rows
    are train, the next n_val valid, the rest test (a stratum of 1 goes to test).  Rows of one
    key stay together: where several stand at a cut, all of them are on its earlier side.

    The input is computed once: it is written (unless it is ``written`` files already), its
    stratum and key are read for the cuts, and the whole rows once for their label."""

    def ends(n: Column) -> list[Column]:
        n_test = F.greatest(F.lit(1), F.floor(n * F.lit(test)))
        n_val = F.greatest(F.lit(1), F.floor(n * F.lit(valid)))
        return [F.greatest(n - n_test - n_val, F.lit(0)), n - n_test]

    return _labelled(df, key, F.col(stratum), seed, bucket_hex, written, ends)


def random_split(
    df: DataFrame,
    key: str = "conv_id",
    train: float = 0.8,
    valid: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    bucket_hex: int = 3,
    written: bool = False,
) -> DataFrame:
    """Seeded order; first ``floor(n*train)`` train, next ``floor(n*valid)`` valid, rest test.
    Rows of one key stay together, and the input is computed once, as in ``stratified_split``."""
    check_ratios(train, valid, test)

    def ends(n: Column) -> list[Column]:
        n_train = F.floor(n * F.lit(train))
        return [n_train, n_train + F.floor(n * F.lit(valid))]

    return _labelled(df, key, F.lit(0), seed, bucket_hex, written, ends)


def split_dataset(df, *, stratify: bool, key: str, stratum: str = "scenario", train=0.8, valid=0.1, test=0.1, seed=42, written=False):
    """Stage-C split entry point: ratio check (P3), then P2 or P1."""
    check_ratios(train, valid, test)
    if stratify:
        return stratified_split(df, stratum, key, valid=valid, test=test, seed=seed, written=written)
    return random_split(df, key, train, valid, test, seed, written=written)
