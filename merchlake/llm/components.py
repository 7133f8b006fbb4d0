"""Connected components of a graph given as edges, by repeated minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: Rounds after which something must be wrong: each round at least halves the longest chains.
MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the least node that it is connected with.

    Every round hooks each root under the least root next to its tree and then lets each node skip to the root's
    root. Edges are rewritten between roots and those inside one tree are dropped, so they shrink quickly. All steps are
    aggregations with partial sums and joins; nothing is collected, and each round is written to the shared folder, where the one before is then deleted.
    """
    spark = edges.sparkSession
    live = edges.select(F.least(a, b).alias("hi"), F.greatest(a, b).alias("lo")).where("hi <> lo").distinct()
    live = materialize(live, "edges")
    nodes = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    label = materialize(nodes.withColumn("component", F.col("node")), "labels")
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            forget(live)
            return label
        # the least neighbour of every root
        both = live.select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")), F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")))).alias("e"))
        hook = materialize(both.groupBy("e.x").agg(F.min("e.y").alias("y")).select("x", F.least("x", "y").alias("parent")), "hooks")
        jumps = _jump(hook)
        root = jumps.select(F.col("x").alias("component"), "parent")
        done = [label, live, hook, jumps]
        label = materialize(label.join(root, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        moved = live.join(jumps.select(F.col("x").alias("hi"), F.col("parent").alias("p")), "hi").join(jumps.select(F.col("x").alias("lo"), F.col("parent").alias("q")), "lo")
        live = materialize(moved.where("p <> q").select(F.least("p", "q").alias("hi"), F.greatest("p", "q").alias("lo")).distinct(), "edges")
        forget(*done)
    raise RuntimeError("components did not settle")


def _jump(parents: DataFrame) -> DataFrame:
    """(x, parent) with every parent replaced by the root of its chain; parents are less than their children. Two jumps a round."""
    first = parents
    for _ in range(MOST_ROUNDS):
        up = lambda x, y: parents.select(F.col("x").alias(x), F.col("parent").alias(y))
        above = parents.select("x", "parent").join(up("parent", "above"), "parent", "left").select("x", F.coalesce("above", "parent").alias("parent"))
        top = F.coalesce("above", "parent")
        jumped = materialize(above.join(up("parent", "above"), "parent", "left").select("x", top.alias("parent"), (top != F.col("parent")).alias("moved")), "jumps")
        if parents is not first:
            forget(parents)
        parents = jumped
        if jumped.where("moved").isEmpty():
            return parents
    raise RuntimeError("pointers did not settle")
