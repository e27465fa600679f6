"""From candidates to matches: distance, best candidates in both directions, one-sided rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two objects at more than this distance aren't versions of each other.
TOO_FAR = 0.5


def text_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(longest, F.lit(1)).cast("double"))


def unlike(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)


def weighted_distance(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the features' distances."""
    total = sum(weight for _, weight in parts)
    out = F.lit(0.0)
    for distance, weight in parts:
        out = out + distance * F.lit(float(weight))
    return out / F.lit(float(total))


def best(candidates: DataFrame, of: str, other: str) -> DataFrame:
    """For each object its nearest candidate; of equal ones the one with the lowest id.

    An aggregate with a minimum, not a window: it combines before the shuffle, so that an object with very
    many candidates costs one row from each task.
    """
    least = F.min(F.struct("dist", F.col(other).alias("other"))).alias("least")
    return candidates.groupBy(of).agg(least).select(of, F.col("least.other").alias(other), F.col("least.dist").alias("dist"))


def mutual_best(candidates: DataFrame) -> DataFrame:
    """Pairs that are each other's best: (left_id, right_id, dist)."""
    near = candidates.filter(F.col("dist") <= TOO_FAR)
    forward = best(near, "left_id", "right_id")
    back = best(near, "right_id", "left_id").select("left_id", "right_id")
    return forward.join(back, ["left_id", "right_id"], "left_semi")


def completed(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """All objects of both sides: matches, and one-sided rows for the rest."""
    l = left.select(F.col("id").alias("left_id")).join(matches.select("left_id", "right_id"), "left_id", "left")
    r = right.select(F.col("id").alias("right_id")).join(matches.select("right_id"), "right_id", "left_anti")
    return l.select("left_id", "right_id").unionByName(r.select(F.lit(None).cast("long").alias("left_id"), "right_id"))


def three_sides(left: DataFrame, right: DataFrame, origin: DataFrame, matched: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(left_id, right_id, origin_id), every object in one row: left objects with their right and origin partners, then
    what is left of both with each other. matched(a, b): (left_id, right_id) of two sides, a table that may be read often."""
    to_right, to_origin = matched(left, right), matched(left, origin)
    rest_r = right.join(to_right.select(F.col("right_id").alias("id")), "id", "left_anti")
    rest_o = origin.join(to_origin.select(F.col("right_id").alias("id")), "id", "left_anti")
    between = matched(rest_r, rest_o)
    none = F.lit(None).cast("long")
    l = left.select(F.col("id").alias("left_id")).join(to_right.select("left_id", "right_id"), "left_id", "left")
    l = l.join(to_origin.select("left_id", F.col("right_id").alias("origin_id")), "left_id", "left")
    r = rest_r.select(F.col("id").alias("right_id")).join(between.select(F.col("left_id").alias("right_id"), F.col("right_id").alias("origin_id")), "right_id", "left")
    o = rest_o.select(F.col("id").alias("origin_id")).join(between.select(F.col("right_id").alias("origin_id")), "origin_id", "left_anti")
    every = l.unionByName(r.withColumn("left_id", none)).unionByName(o.withColumn("left_id", none).withColumn("right_id", none))
    return every.select("left_id", "right_id", "origin_id")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per left object whether two match results differ on it."""
    x = a.select("left_id", F.col("right_id").alias("a_right"), F.lit(True).alias("in_a"))
    y = b.select("left_id", F.col("right_id").alias("b_right"), F.lit(True).alias("in_b"))
    joined = x.join(y, "left_id", "full_outer")
    same = F.col("in_a").eqNullSafe(F.col("in_b")) & F.col("a_right").eqNullSafe(F.col("b_right"))
    return joined.select("left_id", "a_right", "b_right", (~same).alias("differs"))


def ranked(candidates: DataFrame, of: str, other: str, k: int) -> DataFrame:
    """The k nearest candidates of each object, ties by id."""
    order = Window.partitionBy(of).orderBy("dist", other)
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
