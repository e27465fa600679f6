"""Reachability in a graph of parents: ancestors in a containment tree, supertypes of a class.

Paths double in length each round (all pairs within 2^k steps), so a chain of n steps takes log2 n rounds whatever
its depth, and cycles end: a pair that is known gives nothing new. The result has a row for each pair of a node and one
above it, and each round is a join on a key and an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.storage import removed, written


def above(edges: DataFrame) -> DataFrame:
    """(node, above, steps): from (node, above), all that can be reached, and in how few steps; a node on a cycle
    reaches itself. Null ends count as none."""
    first = edges.select("node", "above").filter("node IS NOT NULL AND above IS NOT NULL").distinct()
    now = written(first.withColumn("steps", F.lit(1).cast("long")), "above")
    known = now.count()
    while known:
        further = now.select(F.col("node").alias("above"), F.col("above").alias("_next"), F.col("steps").alias("_more"))
        longer = now.join(further, "above").select("node", F.col("_next").alias("above"), (F.col("steps") + F.col("_more")).alias("steps"))
        both = now.unionByName(longer).groupBy("node", "above").agg(F.min("steps").alias("steps"))
        last, now = now, written(both, "above")
        removed(last)
        before, known = known, now.count()
        if known == before:
            break
    return now


#: Steps that marks are handed down one at a time; what is further down is reached by doubled paths.
STEPS = 32


def marked_from_above(nodes: DataFrame, edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, marked): whether a node itself or any above it is among the marked (node).

    Marks go down a step a round and only from nodes that are newly marked, so that no paths are kept: a row for each
    marked node. Chains of over STEPS nodes end with the closure of the edges between nodes that have no mark yet.
    """
    up = written(edges.select("node", "above").filter("node IS NOT NULL AND above IS NOT NULL").distinct(), "edges")
    new = written(marked.select("node").filter("node IS NOT NULL").distinct(), "marked")
    known, n = new, 0
    while not new.isEmpty():
        below = up.join(new.select(F.col("node").alias("above")), "above", "left_semi").select("node").distinct()
        if n == STEPS:
            open_ = up.join(known, "node", "left_anti")
            starts = below.join(known, "node", "left_anti")
            further = above(open_).join(starts.select(F.col("node").alias("above")), "above", "left_semi").select("node")
            known = known.unionByName(written(further.unionByName(starts).distinct(), "marked"))
            break
        new, n = written(below.join(known, "node", "left_anti"), "marked"), n + 1
        known = known.unionByName(new)
    return nodes.select("node").join(known.withColumn("_marked", F.lit(True)), "node", "left").select("node", F.coalesce("_marked", F.lit(False)).alias("marked"))
