"""Similarity joins of codes, blocked by type.

Objects with one code are one row until the very end: the distinct codes of both sides are joined, and
the pairs of codes are expanded over their objects only where asked. Every join has an equality key, so no
pair of unlike types, and none that can't reach the threshold, is formed.

Codes within a Hamming distance meet under 16-bit blocks: of four blocks whose radii and one more each add
up to more than the distance, one differs within its radius. A cosine bounds the distance of a code by its
popcount; codes for which that bound is too wide for blocks meet under the popcounts that they can reach.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import similarity


def distinct_codes(rows: DataFrame, side: str) -> DataFrame:
    """(type, <side>_code, <side>_bits, <side>_n)."""
    counted = rows.groupBy("type", "code").agg(F.count("*").alias(f"{side}_n"))
    return counted.select("type", F.col("code").alias(f"{side}_code"), F.bit_count("code").alias(f"{side}_bits"), f"{side}_n")


def band(bits: Column, least: float) -> Column:
    """The popcounts that a code can have to be cosine-similar: the smaller is at least least squared of the larger."""
    low = F.ceil(bits * (least * least) - 1e-9).cast("int")
    high = F.least(F.floor(bits / (least * least) + 1e-9), F.lit(64)).cast("int")
    return F.sequence(F.least(low, high), high)


#: The widest distance for which blocks are keys: beyond it a code would have thousands of them.
WIDEST = 14
BLOCK = 16


def radii(most: int) -> list[int]:
    """For each of four blocks in how many bits it may differ; -1 for a block that needn't be looked at."""
    return [(most + 1 + 3 - k) // 4 - 1 for k in range(4)]


def _flips(spark: SparkSession, distances: list[int]) -> DataFrame:
    """(reach, block, flip): what the blocks of a code are changed by to meet all codes within a reach."""
    rows = [
        (most, block, sum(1 << b for b in bits))
        for most in distances
        for block, radius in enumerate(radii(most))
        for n in range(radius + 1)
        for bits in combinations(range(BLOCK), n)
    ]
    return spark.createDataFrame(rows, "reach int, block int, flip long")


def blocks(code: Column) -> Column:
    """(number, value) of the four 16-bit blocks of a code."""
    value = lambda k: F.shiftrightunsigned(code, BLOCK * k).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("block"), value(k).alias("value")) for k in range(4)])


def _met(l: DataFrame, r: DataFrame, distances: list[int]) -> DataFrame:
    """Pairs of the left codes, each with its reach, and the right ones that share a block within its radius; a pair may
    come several times."""
    l = l.select("*", F.explode(blocks(F.col("left_code"))).alias("c")).select("*", "c.block", "c.value").drop("c")
    # at most some thousand rows for each distance
    l = l.join(F.broadcast(_flips(l.sparkSession, distances)), ["reach", "block"])
    l = l.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    r = r.select("*", F.explode(blocks(F.col("right_code"))).alias("c")).select("*", "c.block", "c.value").drop("c")
    return l.join(r, ["type", "block", "value"]).drop("block", "value")


def similar_codes(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct codes of one type with cosine at least the threshold; code 0 meets only itself.

    A code with p bits differs from a similar one in at most p (1 - t^2) / t^2. Up to WIDEST that many are
    found by blocks; other codes are sent to each popcount that the bound allows.
    """
    l, r = distinct_codes(left, "left"), distinct_codes(right, "right")
    reach = {p: cosine_to_hamming(p, least) for p in range(65)}
    far = [p for p, most in reach.items() if most > WIDEST]
    table_ = F.array(*[F.lit(reach[p]) for p in range(65)])
    keys = ["type", "left_code", "right_code"]
    near = l.withColumn("reach", F.element_at(table_, F.col("left_bits") + 1)).filter(F.col("reach") <= WIDEST)
    pairs = _met(near, r, sorted({most for most in reach.values() if most <= WIDEST})).drop("reach").dropDuplicates(keys)
    if far:
        wide = l.filter(F.col("left_bits") >= far[0]).withColumn("right_bits", F.explode(band(F.col("left_bits"), least)))
        pairs = pairs.unionByName(wide.join(r, ["type", "right_bits"]))
    sim = similarity.cosine(F.col("left_code"), F.col("right_code"))
    return pairs.withColumn("sim", sim).filter(F.col("sim") >= least)


def near_codes(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs of distinct codes of one type that differ in at most so many bits."""
    l, r = distinct_codes(left, "left").withColumn("reach", F.lit(most)), distinct_codes(right, "right")
    distance = similarity.hamming(F.col("left_code"), F.col("right_code"))
    met = _met(l, r, [most]).drop("reach").withColumn("distance", distance).filter(F.col("distance") <= most)
    return met.dropDuplicates(["type", "left_code", "right_code"])


def cosine_to_hamming(bits: int, least: float) -> int:
    """Bits in which a code may differ from one with so many bits and still reach the cosine."""
    return math.floor(bits * (1 - least * least) / (least * least) + 1e-9)


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of codes as pairs of objects."""
    l = left.select(F.col("id").alias("left_id"), "type", F.col("code").alias("left_code"))
    r = right.select(F.col("id").alias("right_id"), "type", F.col("code").alias("right_code"))
    return l.join(pairs, ["type", "left_code"]).join(r, ["type", "right_code"])
