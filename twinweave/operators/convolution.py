"""Two-round hashing: an object's final code is its own one with what its neighbours' codes agree on.

First all objects are hashed. Then codes travel along the edges, and at each object two votes are held, one by the
objects that it contains and one by those that it refers to; a bit counts if enough of the neighbours that have a code (not
zero) have it. The final code is the OR of the three. An index over final codes is a join on them.

An object with very many neighbours is summed up by each task that holds some of them before anything is shuffled. Objects
without a code have 0; edges to objects that don't exist, and repeated edges, count as what they are: nothing, and each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions import kernels as K

#: A bit's share of the neighbours that must be exceeded (numerator, denominator): weights 10 for and 5 against
#: among contained objects, 5 and 2 among those referred to.
CONTAINED, REFERRED = (1, 3), (2, 7)


def voted_around(edges: DataFrame, codes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(type, key, around): of edges (type, key, to_type, to_key) and codes (type, key, code)."""
    more, of = share
    ends = codes.filter("code <> 0").select(F.col("type").alias("to_type"), F.col("key").alias("to_key"), "code")
    sums = [F.sum(F.shiftrightunsigned("code", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"_b{k}") for k in range(64)]
    votes = edges.join(ends, ["to_type", "to_key"]).groupBy("type", "key").agg(F.count("*").alias("_n"), *sums)
    # a disjunction of 64 terms, in four steps, as Catalyst copies what it puts together
    out, parts = votes, []
    for k in range(0, 64, 16):
        bits = [F.when(F.col(f"_b{b}") * of > F.col("_n") * more, K.bit(F.lit(b))).otherwise(F.lit(0).cast("long")) for b in range(k, k + 16)]
        whole = bits[0]
        for x in bits[1:]:
            whole = whole.bitwiseOR(x)
        out, parts = out.withColumn(f"_p{k}", whole), [*parts, F.col(f"_p{k}")]
    return out.select("type", "key", parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3]).alias("around"))


def final_codes(codes: DataFrame, contained: DataFrame, referred: DataFrame) -> DataFrame:
    """(type, key, code, final_code) of objects (type, key, code), a row for each; edges are (type, key, to_type, to_key)."""
    out = codes.withColumn("final_code", F.coalesce("code", F.lit(0).cast("long")))
    for edges, share in ((contained, CONTAINED), (referred, REFERRED)):
        met = out.join(voted_around(edges, codes, share), ["type", "key"], "left")
        out = met.withColumn("final_code", F.col("final_code").bitwiseOR(F.coalesce("around", F.lit(0).cast("long")))).drop("around")
    return out


def same_final_code(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, final_code, left_n, left_key, right_n, right_key): codes that both sides have, how often, and the lowest key
    of each; pairs of objects are never listed."""
    own = lambda d, side: d.groupBy("type", "final_code").agg(F.count("*").alias(f"{side}_n"), F.min("key").alias(f"{side}_key"))
    return own(left, "left").join(own(right, "right"), ["type", "final_code"])
