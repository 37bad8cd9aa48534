"""Mixing sources to target weights: exponential-key sampling to word budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convrec.llm.common import WORD, cut


def word_count(text: Column) -> Column:
    """Number of words (runs outside space and U+0009..U+000D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(text: Column, size: Column) -> Column:
    """A quality weight from the text alone, 0 to 1: the closer the mean length of its words to
    six characters, the larger."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(1.0 / (1.0 + F.abs(F.log(F.greatest(mean, F.lit(0.1)) / 6.0))), F.lit(0.1))


def uniform(c: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the value and the seed only."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(seed))), 1, 12), 16, 10)
    return (h.cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from one ``(source, source_size)`` row per source.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share 100% of
    all sizes; a target stops at ``max_epochs`` times its source's size and the excess is
    reshared by weight until none is above.  That fixed point has a level L with
    target = min(cap, L * weight): with sources ordered by cap / weight, the first one whose
    cap is not below its share of what the earlier (capped) ones leave gives L.

    One row per source is all the global windows see; documents never do."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(everything) - 1) % n + 1)
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    t = t.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_w", F.sum("w").over(whole))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("share", left / left_w)
    fits = F.col("share") * F.col("w") <= F.col("cap")
    # the first source that fits: shares fall behind it no further, so its share is the smallest of those that fit
    t = t.withColumn("rank", F.row_number().over(by_cap)).withColumn("fit_rank", F.min(F.when(fits, F.col("rank"))).over(whole))
    t = t.withColumn("level", F.max(F.when(F.col("rank") == F.col("fit_rank"), F.col("share"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return t.select("source", "source_size", F.round(target, 6).alias("target"))


def sample_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "size",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix-1",
    bins: int = 4096,
) -> DataFrame:
    """The input's rows with ``source_size``, ``target`` and ``epochs`` (how often the mix takes
    the document: 0 to ``max_epochs``).

    Every source takes ``floor(target / source_size)`` complete epochs of all its documents
    and fills the rest by Efraimidis-Spirakis sampling without replacement: each document
    draws an exponential key, -ln(u) over its quality weight, with u a hash of id and seed;
    in key order (ties: smaller id, then size) documents are taken while the prefix sum
    of sizes keeps to the word budget, and the one that crosses it if that ends nearer.  Whole documents only.
    Input columns named like a result column are replaced.

    A source may hold a third of all rows, so it is never sorted in one task: keys fall into
    ``bins`` ranges of the exponential distribution, range sizes are partial sums, a range
    wholly before or after the budget's end is decided by its offset, and only the rows of
    the one range per source where the budget ends meet in a window.

    Defined cases: null source: a source of its own, last; size 0 or null: never changes a
    budget, taken with its neighbours in key order; null or non-positive weight: smallest
    weight (1e-6); repeated rows: each is a row of its own (same key); empty table: empty
    result; a source of empty documents has target 0."""
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(1e-6))
    key = -F.log(uniform(F.col(id_col), seed)) / weight
    rows = docs.withColumns({"__k": key, "__src": F.col(source_col), "__n": F.coalesce(F.col(size_col).cast("long"), F.lit(0))})
    rows = rows.withColumn("__bin", F.floor((F.lit(1.0) - F.exp(-F.col("__k"))) * bins))
    binned = cut(rows.groupBy(F.col("__src").alias("source"), "__bin").agg(F.sum("__n").alias("bin_size")))
    targets = source_targets(binned.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("__full", full).withColumn("__rest", F.col("target") - F.col("__full") * F.col("source_size"))
    targets = targets.withColumnRenamed("source", "__s")
    upto = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.withColumn("__off", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("__s"))).filter(F.col("__off") < F.col("__rest"))
    last = offsets.groupBy(F.col("source").alias("__s2")).agg(F.max(F.struct("__bin", "__off")).alias("__edge"))
    plan = targets.join(last, F.col("__s").eqNullSafe(F.col("__s2")), "left").select(
        "__s", "__full", "__rest", F.col("source_size").alias("__size"), F.col("target").alias("__target"),
        F.col("__edge.__bin").alias("__edge"), F.col("__edge.__off").alias("__off"),
    )
    plan = cut(plan)  # one row per source: the joins below ship this, not documents
    rows = rows.join(plan, F.col("__src").eqNullSafe(F.col("__s")))
    at_edge = F.coalesce(F.col("__bin") == F.col("__edge"), F.lit(False))
    decided = rows.filter(~at_edge).withColumn("__drawn", F.coalesce(F.col("__bin") < F.col("__edge"), F.lit(False)))
    edge = rows.filter(at_edge)  # the key range of each source in which its budget ends
    in_bin = Window.partitionBy("__src", "__bin").orderBy("__k", F.col(id_col).asc_nulls_last(), "__n")
    before = F.col("__off") + F.coalesce(F.sum("__n").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("__before", before)
    over = F.col("__before") + F.col("__n") - F.col("__rest")
    edge = edge.withColumn("__drawn", (F.col("__before") < F.col("__rest")) & ((over <= 0) | (over < F.col("__rest") - F.col("__before"))))
    out = decided.unionByName(edge.drop("__before"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("source_size", "target", "epochs")],
        F.col("__size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__full") + F.col("__drawn").cast("int")).cast("int").alias("epochs"),
    )


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row as often as its ``epochs`` say."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("epochs")))
    return mixed.select(*columns, times.alias("__copy")).select(*columns)
