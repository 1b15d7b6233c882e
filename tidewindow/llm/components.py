"""Connected components by contraction, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Each round hooks every node onto its smallest smaller neighbour, flattens the forest by pointer
    jumping, and replaces edges by the edges between roots.  Work shrinks each round; aggregations combine
    before the shuffle, and joins read written tables, so that one hot node is split by adaptive execution.
    Self-loops, repeated and null-ended edges are harmless; no edges give an empty table.
    """
    live = scratch.save(_between(edges, "a", "b"), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        # every node hooks onto its smallest neighbour; one that has only larger neighbours is a root for now
        up = scratch.save(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "hook")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = scratch.save(up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jump")
            scratch.drop(up)
            up = jumped
            if up.filter("moved").isEmpty():
                break
            kept = up
            up = _with_path(up.select("node", "up"), kept)
        rounds.append(up.select("node", "up"))
        at = lambda side: rounds[-1].select(F.col("node").alias(side), F.col("up").alias(f"{side}2"))
        half = scratch.save(live.join(at("a"), "a", "left").select(F.coalesce("a2", "a").alias("a"), "b"), "half")
        scratch.drop(live)
        live = scratch.save(_between(half.join(at("b"), "b", "left").select("a", F.coalesce("b2", "b").alias("b")), "a", "b"), "edges")
        scratch.drop(half)
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a root of one round is a node of the next, or a root for good
    top = rounds[-1]
    for lower in reversed(rounds[:-1]):
        above = top.select(F.col("node").alias("up"), F.col("up").alias("top"))
        top = scratch.save(lower.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(top), "roots")
    pairs = top.select("node", F.col("up").alias("root"))
    roots = pairs.select(F.col("root").alias("node")).distinct()
    return scratch.save(pairs.unionByName(roots.select("node", F.col("node").alias("root"))), "components")


def _with_path(df: DataFrame, like: DataFrame) -> DataFrame:
    df._scratch_path = like._scratch_path
    return df


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each link once, from its larger end to its smaller."""
    return edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
