"""Interaction-log operators: metadata filters, semi joins, k-core, per-user history.

Covers F1, F2, J1-J5, A1-A7, W2-W4.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec.session import Generations, staged

BROADCAST_KEYS = 500_000  # of k-core's fallen keys: some 50 MB


def filter_titled(meta: DataFrame, title_col: str = "title", min_len: int = 2) -> DataFrame:
    """F1 + F2: keep metadata rows whose title is present and longer than ``min_len``."""
    return meta.filter(F.col(title_col).isNotNull() & (F.length(title_col) > min_len))


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key exists in ``right`` (never collects keys).  Only the
    distinct keys of ``right`` are shuffled, whatever its rows."""
    keys = right.select(F.col(right_key or left_key).alias("__k")).distinct()
    return left.join(keys, F.col(left_key) == F.col("__k"), "left_semi")


@dataclass
class KCoreResult:
    core: DataFrame
    rounds: int
    rows: int


def k_core(
    ratings: DataFrame,
    k: int,
    user_col: str = "user_id",
    item_col: str = "item_id",
    max_rounds: int | None = None,
) -> KCoreResult:
    """A1: iterated k-core of an interaction log.

    Users and items below ``k`` rows are taken out together until none is left, which is
    when both minima reach ``k`` (A3).  Rows are counted once (A2, partial aggregates: a
    hot user costs one row per task); after that a round only looks for the rows that leave
    with the keys that have just fallen below ``k``, and subtracts them from the counts of
    their other ends.  The state is one written table, ``(key, rows left, round in which it
    fell)``; a row leaves in the earlier round of its two ends.  A round is one shuffle, of the
    state and the leaving rows added up; the fallen keys are joined, by a broadcast where their
    number, which is known, is at most ``BROADCAST_KEYS``: if all that have fallen are more, the rows of the newly
    fallen are found by those alone, and the few found are compared with the older ones.  The pairs are written anew,
    and the fallen keys forgotten, only when at least half of the rows have gone, so all
    rewritings together cost less than two of the log.  Two numbers a round, observed on
    the rows written, reach the driver; replaced tables are deleted (``Generations``).

    Rows without user or item belong to no core.  An input where nobody reaches ``k`` gives an
    empty DataFrame; a ``max_rounds`` that is reached raises instead of returning a
    partial core."""
    base = staged(ratings.filter(F.col(user_col).isNotNull() & F.col(item_col).isNotNull()), "kcore-log")
    tables = Generations(ratings.sparkSession, "kcore")

    def both_ends(rows: DataFrame, n: int) -> DataFrame:
        """Two rows a pair, ``(u, i, n, fell)`` with one of u and i null: its user and its item."""
        ends = F.array(
            F.struct(F.col(user_col).alias("u"), F.lit(None).cast(base.schema[item_col].dataType).alias("i")),
            F.struct(F.lit(None).cast(base.schema[user_col].dataType).alias("u"), F.col(item_col).alias("i")),
        )
        return rows.select(F.explode(ends).alias("e")).select("e.u", "e.i", F.lit(n).cast("long").alias("n"), F.lit(None).cast("int").alias("fell"))

    def one_end(rows: DataFrame, key: str, other: str) -> DataFrame:
        ends = {key: F.col(key), other: F.lit(None).cast(base.schema[other].dataType)}
        return rows.select(ends[user_col].alias("u"), ends[item_col].alias("i"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("int").alias("fell"))

    def settle(changes: DataFrame, turn: int) -> tuple[DataFrame, int, int]:
        """The state after adding up ``changes`` (one aggregate, combined before its shuffle), the
        number of keys that fall in this ``turn``, and the rows that are left."""
        sums = changes.groupBy("u", "i").agg(F.sum("n").alias("n"), F.max("fell").alias("fell"))
        fell = F.coalesce("fell", F.when(F.col("n") < k, F.lit(turn)))
        falls = F.col("fell") == turn
        seen = Observation()
        state = sums.withColumn("fell", fell).observe(
            seen,
            F.count(F.when(falls, 1)).alias("falls"),
            F.sum(F.when(F.col("u").isNotNull() & (F.col("fell").isNull() | falls), F.col("n"))).alias("rows"),
        )
        state = tables.put("state", state)
        return state, seen.get["falls"], seen.get["rows"] or 0

    pairs = base.select(user_col, item_col)
    # the first count reads all rows: their two ends as two scans of the written log, without a generator
    state, falls, left = settle(one_end(pairs, user_col, item_col).unionByName(one_end(pairs, item_col, user_col)), 1)
    rounds = 0
    written, since = left, 0  # rows of ``pairs`` when last written; keys fallen up to then are out of them
    older = 0  # keys that fell after ``since`` and before this round
    while falls:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"k-core not reached within {max_rounds} rounds")
        if 2 * left <= written:
            pairs = tables.put("pairs", _without(pairs, state.filter(F.col("fell") <= rounds), user_col, item_col))
            written, since, older = left, rounds, 0
        rounds += 1
        if older + falls <= BROADCAST_KEYS:
            gone = state.filter(F.col("fell") > since)
            leaving = _joined(pairs, gone, older + falls, user_col, item_col).filter(F.least("__fu", "__fi") == rounds)
        else:
            gone = state.filter((F.col("fell") > since) & (F.col("fell") < rounds))
            leaving = _joined(pairs, state.filter(F.col("fell") == rounds), falls, user_col, item_col)
            leaving = leaving.filter(F.coalesce("__fu", "__fi").isNotNull()).select(user_col, item_col)
            if older:
                leaving = _joined(leaving, gone, older, user_col, item_col).filter(F.coalesce("__fu", "__fi").isNull())
        older += falls
        state, falls, left = settle(state.unionByName(both_ends(leaving, -1)), rounds + 1)
        tables.sweep()
    core = base.select(*ratings.columns)
    if rounds:
        core = staged(_without(base, state.filter("fell is not null"), user_col, item_col).select(*ratings.columns), "kcore-core")
    for name in list(tables.current):
        tables.drop(name)
    return KCoreResult(core=core, rounds=rounds, rows=left)


def _joined(rows: DataFrame, gone: DataFrame, n: int, user_col: str, item_col: str) -> DataFrame:
    """``rows`` with the rounds ``__fu`` and ``__fi`` in which their ends fell; ``gone`` holds ``n`` keys.  Texts are looked up by
    a hash, which is faster, and compared too (not as a key: two keys would be looked up as a row of both)."""
    for col, end, fell in ((user_col, "u", "__fu"), (item_col, "i", "__fi")):
        keys = gone.filter(F.col(end).isNotNull()).select(F.col(end).alias("__k"), F.col("fell").alias(fell))
        same = F.col(col) == F.col("__k")
        if n <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
            if isinstance(rows.schema[col].dataType, T.StringType):
                same = (F.xxhash64(col) == F.xxhash64("__k")) & (F.col(col) >= F.col("__k")) & (F.col(col) <= F.col("__k"))
        rows = rows.join(keys, same, "left").drop("__k")
    return rows


def _without(rows: DataFrame, gone: DataFrame, user_col: str, item_col: str) -> DataFrame:
    users = gone.filter(F.col("u").isNotNull()).select(F.col("u").alias(user_col))
    items = gone.filter(F.col("i").isNotNull()).select(F.col("i").alias(item_col))
    return rows.join(users, user_col, "left_anti").join(items, item_col, "left_anti")


def core_stats(core: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """A4: number of items, users and ratings of a core (one row)."""
    return core.agg(
        F.count_distinct(item_col).cast("bigint").alias("n_items"),
        F.count_distinct(user_col).cast("bigint").alias("n_users"),
        F.count(F.lit(1)).cast("bigint").alias("n_ratings"),
    )


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """A2: rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def min_count(df: DataFrame, key: str) -> DataFrame:
    """A3: minimum of the per-key row counts (the k-core stop test)."""
    return key_counts(df, key).agg(F.min("n").alias("min_n"))


def min_counts(df: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """A3 for both keys in one pass: ``min_user``, ``min_item`` (one row).  Users and items are
    counted by one partial aggregate over a tagged stack of the two key columns."""
    stacked = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("u").alias("kind"), F.col(user_col).cast("string").alias("key")),
                F.struct(F.lit("i").alias("kind"), F.col(item_col).cast("string").alias("key")),
            )
        ).alias("s")
    ).select("s.*")
    counts = stacked.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min(F.when(F.col("kind") == "u", F.col("n"))).cast("bigint").alias("min_user"),
        F.min(F.when(F.col("kind") == "i", F.col("n"))).cast("bigint").alias("min_item"),
    )


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based position (``__pos``) of every row inside its group by ``order_cols``
    ascending, and the group size (``__len``), without sending a group to one task.

    The rows are range-partitioned on ``group + order`` (Spark samples the key
    distribution, so a group holding a third of all rows is cut into many
    partitions, each a contiguous slice of the group's order) and ranked inside
    ``(group, partition)``.  This ranking is written once (``staged``): both
    branches below read the very same slices.  Each slice's offset is the prefix sum of
    the slice sizes of the same group, a table with one row per group and partition; every
    row must find its slice, else the job fails."""
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(parts, *[F.col(c).asc() for c in group_cols + order_cols]).withColumn(
        "__part", F.spark_partition_id()
    )
    w = Window.partitionBy(*group_cols, "__part")
    r = r.withColumn("__lr", F.row_number().over(w.orderBy(*order_cols))).withColumn("__pc", F.count(F.lit(1)).over(w))
    r = staged(r, "ranked")
    slices = r.groupBy(*group_cols, "__part").agg(F.max("__pc").alias("__pc"))
    wo = Window.partitionBy(*group_cols).orderBy("__part")
    offsets = slices.withColumn(
        "__off", F.coalesce(F.sum("__pc").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("__len", F.sum("__pc").over(Window.partitionBy(*group_cols)))
    offsets = offsets.select(*[F.col(c).alias(f"__g{n}") for n, c in enumerate(group_cols)], F.col("__part").alias("__p"), "__off", "__len")
    on = F.col("__part") == F.col("__p")
    for n, c in enumerate(group_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{n}"))
    found = F.when(F.col("__off").isNotNull(), F.col("__off") + F.col("__lr")).otherwise(
        F.raise_error(F.lit("a row's slice is missing")).cast("bigint")
    )
    return r.join(offsets, on, "left").withColumn("__pos", found).select(*df.columns, "__pos", "__len")


def history_positions(
    inter: DataFrame,
    user_col: str = "user_id",
    order_cols: tuple[str, ...] = ("timestamp", "rating", "item_id", "title", "text"),
) -> DataFrame:
    """A6 + W2 + A7 in long form: every interaction with its position in the user's history
    sorted by the whole tuple ascending (``pos``, 1-based) and the user's ``interaction_len``.

    The reference keeps five parallel lists per user; here the history stays one row per
    interaction, so no user's history is ever gathered into one row or one task (a user
    with a third of all rows is ranked by many tasks, see ``rank_within``)."""
    r = rank_within(inter, [user_col], list(order_cols))
    return r.withColumnRenamed("__pos", "pos").withColumnRenamed("__len", "interaction_len")


def latest_interactions(
    inter: DataFrame,
    n: int,
    user_col: str = "user_id",
    order_cols: tuple[str, ...] = ("timestamp", "rating", "item_id", "title", "text"),
    salt_buckets: int = 64,
    arrival_cols: tuple[str, ...] | None = None,
) -> DataFrame:
    """W2 + W3 + W4: per user the ``target`` (last interaction by the whole tuple) and the
    history window ``sampled`` = ``all[-k:-1]`` with ``k = min(len, n)`` (at most n-1 items,
    in order; empty for a user with one interaction), plus ``interaction_len``.

    With ``arrival_cols`` (parity, Q1) the window is cut from the user's rows in their order of
    arrival instead (``sources.readers.with_arrival``), so it may hold the target and miss
    recent rows; the target is still the last by the tuple.

    Only the last ``n`` rows of a user matter, so each task keeps the last ``n`` it sees of a user
    before the one shuffle (the group limit that Spark puts under a filter on ``row_number``): a hot user
    comes as at most ``n`` rows per task.  Where Spark would not (an ``n`` over its threshold), the rows of a
    user are first cut to the last ``n`` per ``salt_buckets`` hashes of the row.  The user's length (and the target,
    under parity) is a partial aggregate, joined on the left: a caller that does not read it does
    not pay for it.  Every collected array holds at most ``n`` rows."""
    inter = inter.filter(F.col(user_col).isNotNull())
    by = arrival_cols or order_cols
    desc = [F.col(c).desc() for c in by]

    def last_n(rows, *group):
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*desc))).filter(F.col("__r") <= n)

    top = inter
    if n > int(inter.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        top = last_n(top.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salt_buckets))), user_col, "__salt")
    top = last_n(top, user_col)
    whole = F.struct(*[F.col(c) for c in order_cols])
    lens = inter.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("interaction_len"), *([F.max(whole).alias("__target")] if arrival_cols else [])
    )
    if arrival_cols:
        s = F.struct(*[F.col(c).alias(f"__a{i}") for i, c in enumerate(arrival_cols)], whole.alias("__row"))
        last = F.transform(F.array_sort(F.collect_list(s)), lambda x: x["__row"])
    else:
        last = F.array_sort(F.collect_list(whole))
    g = top.groupBy(user_col).agg(last.alias("__last"))  # <= n rows, ascending
    g = g.join(lens, user_col, "left")
    h = F.col("__last")
    size = F.size(h)
    return g.select(
        user_col,
        "interaction_len",
        F.col("__target").alias("target") if arrival_cols else F.element_at(h, -1).alias("target"),
        F.when(size > 1, F.slice(h, 1, size - 1)).otherwise(F.array().cast(g.schema["__last"].dataType)).alias("sampled"),
    )
