"""Queries over the interaction log: k-core, counts, histories, sampling, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from convrec.operators import interactions as ops
from convrec.operators.distill import first_per_key
from convrec.operators.prompts import assign_scenario
from convrec.plans import fixtures as fx
from convrec.plans import oracle as sql
from convrec.plans.registry import TS_FMT, TS_FMT_DUCK, register
from convrec.sources.readers import with_arrival

UNROLL = 24  # oracle rounds; >= the rounds any k below needs at sf0.01 (k=23 needs 7)


def _core(spark, sf_dir, k):
    return ops.k_core(fx.inter(spark, sf_dir), k).core


for _k in (12, 20, 23):

    def _mk(k):
        def q(spark, sf_dir):
            c = _core(spark, sf_dir, k)
            return c.select("user_id", "item_id", "rating", F.date_format("ts", TS_FMT).alias("ts"))

        return q

    register(
        f"a1_kcore_k{_k}",
        sql.with_(sql.INTER, sql.kcore_cte(_k, UNROLL))
        + f"SELECT user_id, item_id, rating, strftime(ts, '{TS_FMT_DUCK}') AS ts FROM core",
    )(_mk(_k))


@register(
    "a4_core_stats_k23",
    sql.with_(sql.INTER, sql.kcore_cte(23, UNROLL))
    + "SELECT CAST(count(DISTINCT item_id) AS BIGINT) AS n_items, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,"
    " CAST(count(*) AS BIGINT) AS n_ratings FROM core",
)
def a4_core_stats(spark, sf_dir):
    return ops.core_stats(_core(spark, sf_dir, 23))


@register(
    "a2_user_counts",
    sql.with_(sql.INTER) + "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM inter GROUP BY user_id",
)
def a2_user_counts(spark, sf_dir):
    return ops.key_counts(fx.inter(spark, sf_dir), "user_id")


@register(
    "a3_min_counts",
    sql.with_(sql.INTER)
    + "SELECT (SELECT min(c) FROM (SELECT count(*) AS c FROM inter GROUP BY user_id)) AS min_user,"
    " (SELECT min(c) FROM (SELECT count(*) AS c FROM inter GROUP BY item_id)) AS min_item",
)
def a3_min_counts(spark, sf_dir):
    i = fx.inter(spark, sf_dir)
    return ops.min_counts(i, "user_id", "item_id").select(
        F.col("min_user").alias("min_user"), F.col("min_item").alias("min_item")
    )


@register(
    "a5_core_sets_k23",
    sql.with_(sql.INTER, sql.kcore_cte(23, UNROLL))
    + "SELECT 'user' AS kind, user_id AS id FROM core GROUP BY user_id UNION ALL SELECT 'item', item_id FROM core GROUP BY item_id",
)
def a5_core_sets(spark, sf_dir):
    c = _core(spark, sf_dir, 23)
    u = c.select(F.lit("user").alias("kind"), F.col("user_id").alias("id")).distinct()
    i = c.select(F.lit("item").alias("kind"), F.col("item_id").alias("id")).distinct()
    return u.unionByName(i)


_HIST_SQL = sql.with_(sql.INTER, sql.kcore_cte(23, UNROLL))


@register(
    "a6_w2_a7_history_positions_k23",
    _HIST_SQL
    + "SELECT user_id, item_id, rating, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, rating, item_id) AS INTEGER) AS pos,"
    " CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS interaction_len FROM core",
)
def a6_history_positions(spark, sf_dir):
    h = ops.history_positions(_core(spark, sf_dir, 23), order_cols=("ts", "rating", "item_id"))
    return h.select("user_id", "item_id", "rating", F.col("pos").cast("int").alias("pos"), F.col("interaction_len").cast("bigint").alias("interaction_len"))


@register(
    "w3_w4_sample_n10_k23",
    _HIST_SQL
    + """, ranked AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating DESC, item_id DESC) AS rd
  FROM core)
SELECT user_id,
  max(CASE WHEN rd = 1 THEN item_id END) AS target_item,
  coalesce(string_agg(CASE WHEN rd BETWEEN 2 AND 10 THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY rd DESC), '') AS history_items,
  CAST(count(CASE WHEN rd BETWEEN 2 AND 10 THEN 1 END) AS BIGINT) AS n_history,
  CAST(count(*) AS BIGINT) AS interaction_len
FROM ranked GROUP BY user_id""",
)
def w3_w4_sample(spark, sf_dir):
    return _sampled(ops.latest_interactions(_core(spark, sf_dir, 23), 10, order_cols=("ts", "rating", "item_id")))


def _sampled(s):
    return s.select(
        "user_id",
        F.col("target.item_id").alias("target_item"),
        F.array_join(F.transform("sampled", lambda x: x["item_id"].cast("string")), ",").alias("history_items"),
        F.size("sampled").cast("bigint").alias("n_history"),
        F.col("interaction_len").cast("bigint").alias("interaction_len"),
    )


@register(
    "w4_parity_sample_n10_k23",
    sql.with_(
        """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + (CAST(l_quantity AS INTEGER) % 5) AS INTEGER) AS rating, l_shipdate AS ts, arrival
  FROM (SELECT *, row_number() OVER () AS arrival FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)""",
        sql.kcore_cte(23, UNROLL),
    )
    + """, ranked AS (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating DESC, item_id DESC) AS rt,
         row_number() OVER (PARTITION BY user_id ORDER BY arrival DESC) AS rd
  FROM core)
SELECT user_id,
  max(CASE WHEN rt = 1 THEN item_id END) AS target_item,
  coalesce(string_agg(CASE WHEN rd BETWEEN 2 AND 10 THEN CAST(item_id AS VARCHAR) END, ',' ORDER BY rd DESC), '') AS history_items,
  CAST(count(CASE WHEN rd BETWEEN 2 AND 10 THEN 1 END) AS BIGINT) AS n_history,
  CAST(count(*) AS BIGINT) AS interaction_len
FROM ranked GROUP BY user_id""",
)
def w4_parity_sample(spark, sf_dir):
    """The order of the interactions' file goes through the join with the orders and the k-core."""
    rows = ops.k_core(fx.inter(spark, sf_dir, arrival=True), 23).core
    return _sampled(ops.latest_interactions(rows, 10, order_cols=("ts", "rating", "item_id"), arrival_cols=("arrival",)))


@register(
    "w11_first_row_wins",
    """WITH o AS (SELECT *, row_number() OVER () AS arrival FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY arrival) = 1""",
)
def w11_first_row_wins(spark, sf_dir):
    rows = with_arrival(fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    return first_per_key(rows, "o_custkey", ["arrival"]).drop("arrival")


@register(
    "t2_scenario_k23",
    _HIST_SQL
    + "SELECT user_id, CAST((('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT) % 5 AS INTEGER) AS scenario_idx"
    " FROM core GROUP BY user_id",
)
def t2_scenario(spark, sf_dir):
    users = _core(spark, sf_dir, 23).select("user_id").distinct()
    return assign_scenario(users, "user_id").select("user_id", "scenario_idx")


@register(
    "t2_scenario_sizes_k23",
    _HIST_SQL
    + "SELECT CAST((('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT) % 5 AS INTEGER) AS scenario_idx,"
    " CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM core GROUP BY 1",
)
def t2_scenario_sizes(spark, sf_dir):
    users = _core(spark, sf_dir, 23).select("user_id").distinct()
    return assign_scenario(users, "user_id").groupBy("scenario_idx").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
