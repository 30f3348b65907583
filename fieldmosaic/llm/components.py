"""Connected components of link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, written


def components(links: DataFrame, most_rounds: int = 60, keep_rounds: bool = True) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node reachable.

    Alternates large-star (every larger neighbour moves to the smallest one around)
    and small-star (every smaller neighbour does) until nothing changes; rounds grow
    with the logarithm of the longest chain. Each round is written, so lost executors
    cost one round at most; without ``keep_rounds`` it replaces the one before. Neighbourhoods are only summarised, never gathered.
    """
    edges = written(_distinct(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large-star: neighbours above the node join its minimum
        large = _distinct(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")))
        # small-star: a node and its neighbours below join the lowest of them
        under = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = under.groupBy("a").agg(F.min("b").alias("low"))
        small = _distinct(
            under.join(root, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(root.select("a", F.col("low").alias("b")))
        )
        before, edges = edges, written(small, "links")
        if not keep_rounds:
            discard(before)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def joined(placed: DataFrame, more: DataFrame) -> DataFrame:
    """``(node, component)`` after further links: only their components are linked anew, not the nodes."""
    ends = more.select("a", "b")
    for end in ("a", "b"):
        known = placed.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root"))
        ends = ends.join(known, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    merged = components(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), keep_rounds=False)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("lower"))
    known = placed.join(moved, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    return known.unionByName(merged.join(placed.select("node"), "node", "left_anti"))


def _distinct(links: DataFrame) -> DataFrame:
    return links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
