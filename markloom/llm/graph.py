"""Joins on keys that may hold many rows, and connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import materialize

MAX_HUBS = 10_000


def hub_join(rows: DataFrame, facts: DataFrame, on: str, weight: str, total: int, least: int = 1024) -> DataFrame:
    """``rows`` joined with ``facts`` (one row per key ``on``; ``weight`` is at least the key's number of ``rows``).

    Keys heavier than ``least`` and than ``total`` / MAX_HUBS, where ``total`` is the sum of the weights, are
    broadcast, so their rows stay where they are. There cannot be more than MAX_HUBS of them. The others are
    joined by a shuffle in which no key has many rows. Null keys join with nothing."""
    heavy = F.col(weight) > max(least, total / MAX_HUBS)
    hubs, plain = facts.where(heavy), facts.where(~heavy)
    by_broadcast = rows.join(F.broadcast(hubs), on)
    by_shuffle = rows.join(F.broadcast(hubs.select(on)), on, "left_anti").join(plain, on)
    return by_broadcast.unionByName(by_shuffle)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: strings); the component is its least node.

    Alternating large-star and small-star rounds: each node hooks its neighbours onto the least node that it
    knows, so paths halve and the rounds grow with the logarithm of the diameter. A round works on edges only
    (minima are partial aggregates; the neighbours of a hub stay where they are, see ``hub_join``); its result is
    written to the shared folder, so that lineage stays short. Loops and nulls are ignored; no edges give no rows."""
    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    before = None
    n = e.count()
    for _ in range(max_rounds):
        if not n:
            break
        # large star: neighbours above a node hook onto the least of its neighbours and itself
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hub_join(both, least, "u", "n", 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: a node and its lower neighbours hook onto the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = materialize(hooked.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if now == before:
            break
        before, n = now, now["n"]
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    root = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        root.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
