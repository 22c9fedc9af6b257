"""Connected components inside groups, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.sources.scratch import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(g, node, root) of each node of the undirected ``edges`` (g, a, b), which stay inside their group g; root is the least node reached.

    Nodes have a random order, by their hashes. A round sends each node to its first
    neighbour in that order, if that comes before it, follows those steps twice, and keeps
    the edges between what is still apart: some two thirds of the nodes go each time, also
    on long chains whose nodes rise one by one. A component of any size is never in one place.
    """
    rank = lambda c: F.struct(F.xxhash64("g", c).alias("h"), F.col(c).alias("n"))
    edges = checkpoint(edges.where("a <> b").distinct())
    roots = checkpoint(edges.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        turned = edges.unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        step = turned.groupBy("g", "a").agg(F.min(rank("b")).alias("m")).select("g", "a", F.least(rank("a"), "m")["n"].alias("to"))
        for _ in range(2):
            on = step.select("g", F.col("a").alias("to"), F.col("to").alias("further"))
            step = step.join(on, ["g", "to"]).select("g", "a", F.col("further").alias("to"))
        step = checkpoint(step)
        of = lambda c: step.select("g", F.col("a").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        apart = edges.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"]).where("a_to <> b_to")
        edges = checkpoint(apart.select("g", F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        roots = checkpoint(roots.join(of("root"), ["g", "root"], "left").select("g", "node", F.coalesce("root_to", "root").alias("root")))
    least = roots.groupBy("g", "root").agg(F.min("node").alias("least"))
    return roots.join(least, ["g", "root"]).select("g", "node", F.col("least").alias("root"))
