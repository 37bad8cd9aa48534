"""Connected components by rounds of contraction, all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convrec.session import Generations


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of the undirected edges ``(a, b)``, with ``root`` the
    smallest node of its component.

    A round sends each node to the smallest of itself and its neighbours, follows these
    pointers twice, replaces the ends of all edges and drops loops and repeats.  Every node
    that is not a local minimum disappears, so the edges run out after a number of rounds
    logarithmic in the nodes.  Each round's map is applied to the roots found so far.  All
    state is written tables whose predecessors are deleted, so a round's plan and estimates are
    those of a few files however many rounds came before.  Minima are partial
    aggregates and joins can be split by AQE, so a hub costs no single task its edges."""
    tables = Generations(edges.sparkSession, "components")
    first = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = tables.put("edges", first)
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        step = tables.put("step", ends.groupBy("node").agg(F.min("other").alias("to")).withColumn("to", F.least("node", "to")))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        twice = tables.put("twice", step.join(hop, "to").select("node", F.col("next").alias("to")))
        hop = twice.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = twice.join(hop, "to").select("node", F.col("next").alias("to"))
        if rounds == 1:
            found = tables.put("found", step.select("node", F.col("to").alias("root")))
            step = found.select("node", F.col("root").alias("to"))
        else:
            step = tables.put("map", step)
            onward = step.select(F.col("node").alias("root"), "to")
            found = found.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            found = tables.put("found", found)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = live.join(left, "a").join(right, "b").filter("to_a <> to_b")
        live = tables.put("edges", moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        tables.sweep()
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return found
