"""Block tables for 64-bit fingerprints: search within a Hamming radius, and connected groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import released

BITS = 64


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the ``blocks - radius`` blocks that stay equal when ``radius`` bits differ.

    64 bits fall into ``blocks`` runs. Two fingerprints that differ in ``radius`` bits touch
    at most ``radius`` runs, so they agree on all the others: on one of these masks at least.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64 must hold")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << (BITS - b) for a, b in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(runs, blocks - radius)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def block_table(fingerprints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """A row (block, key, fp) for each mask: one permuted table after the other."""
    keys = [F.struct(F.lit(i).cast("short").alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(block_masks(radius, blocks))]
    return fingerprints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.block", "k.key", "fp")


def close_pairs(left: DataFrame, right: DataFrame, radius: int, blocks: int, ordered: bool) -> DataFrame:
    """Distinct pairs (a, b) of fingerprints of ``left`` and ``right`` within the radius.

    The Hamming distance is part of the join condition, so pairs that only share a block
    never leave the join. ``ordered`` keeps a < b, for a join of a table with itself.
    """
    a = block_table(left, radius, blocks).withColumnRenamed("fp", "a")
    b = block_table(right, radius, blocks).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    rule = (a["block"] == b["block"]) & (a["key"] == b["key"]) & near
    if ordered:
        rule = rule & (F.col("a") < F.col("b"))
    return a.join(b, rule).select("a", "b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of each edge (a, b), in one pass over them."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("e")).select("e.a", "e.b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node reached.

    Each round hooks every node to its least neighbour, follows these links twice, and
    contracts the edges to what remains between different nodes; a component of any shape
    shrinks several times a round. Only per-node minima and equi-joins; no group is collected.
    """
    edges = released(edges.where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        hook = both_ways(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("q"), F.col("p").alias("pp"))
            hook = hook.join(up, hook["p"] == up["q"]).select("a", F.col("pp").alias("p"))
        hook = released(hook)
        left = hook.select("a", F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = released(
            edges.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if labels is None:  # the first round has hooked every node
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = hook.select(F.col("a").alias("root"), F.col("p").alias("new"))
            labels = released(labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
