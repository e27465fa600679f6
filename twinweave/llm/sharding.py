"""Shards of equal bytes by a k-d tree over document metadata.

A node of the tree is split along its widest dimension (relative to the whole table's width) at the
weighted median of its bytes, or at the share that its two sides' shard counts ask for, until each leaf is
one shard. The medians come from histograms that Spark sums: bins of the sort key, then bins of the bin
that holds the median, until that bin is too light to matter. Only the split points reach the driver.

Points are groups of equal texts, so copies share a shard. Only a group heavier than a whole shard is cut, into
as many points as shards it would fill, by a hash of doc_id. Points above GROUP_SHARE of a shard would tip it over wherever
the tree put them: they are placed first, the heaviest first to the lightest shard, and the tree splits all others by
the bytes that this leaves to each shard. There are at most 1 / GROUP_SHARE of them for each shard.

Slots are numbered in two steps, within (shard, bucket) and by the buckets' running counts, so that no
task sorts a whole shard.

Defined cases: a null text has size 1 and crc32 0; null ids, langs and sources are values like others;
repeated rows are rows each and get slots of their own; an empty table gives no rows; further columns are
ignored; shards without rows occur only if there are fewer points than shards.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.llm.common import table, written

SHARDS = 16
#: A group of copies above this share of a shard's bytes is placed before the others.
GROUP_SHARE = 0.02
#: The median is searched until the bin around it has at most this share of the node's bytes.
TOLERANCE = 0.0005
#: Bits of a sort key: of the dimension's value, of the hash that orders equal values, of a histogram's bins.
VALUE_BITS, TIE_BITS, BIN_BITS = 20, 43, 14
#: Rows in one bucket of slots.
SLOT_ROWS = 20_000

DIMENSIONS = ("log_size", "source_code", "lang_code")


def _key() -> Column:
    """A number below 2 ** 63 that orders a node's points by its dimension's value, then by their hash."""
    value = F.element_at("values", F.col("dimension") + 1)
    span = F.col("high") - F.col("low")
    scaled = F.when(span > 0, F.floor((value - F.col("low")) / span * ((1 << VALUE_BITS) - 1))).otherwise(0)
    return F.shiftleft(scaled.cast("long"), TIE_BITS).bitwiseOR(F.shiftrightunsigned("tie", 64 - TIE_BITS))


def _cuts(keyed: DataFrame, asked: dict[int, int]) -> dict[int, int]:
    """For each node the sort key below which about the asked bytes lie."""
    spark = keyed.sparkSession
    at = {n: (0, 63, 0) for n in asked}  # first key of the interval, its bits, bytes below it
    cuts: dict[int, int] = {}
    while at:
        state = [(n, f, (1 << bits) - 1, max(0, bits - BIN_BITS), below, asked[n]) for n, (f, bits, below) in at.items()]
        # a row for each node at most
        steps = spark.createDataFrame(state, "node int, first long, span long, shift int, below long, target long")
        inside = keyed.select("node", "key", "bytes").join(F.broadcast(steps), "node")
        inside = inside.filter((F.col("key") - F.col("first")).between(0, F.col("span")))
        bin_ = F.expr("shiftrightunsigned(key - first, shift)").alias("bin")
        sums = inside.groupBy("node", bin_, "below", "target").agg(F.sum("bytes").alias("b"))
        # at most 2 ** BIN_BITS rows for each node
        own = Window.partitionBy("node")
        run = sums.withColumn("upto", F.sum("b").over(own.orderBy("bin")) + F.col("below"))
        run = run.withColumn("last", F.max("bin").over(own))
        reached = (F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("b") < F.col("target"))
        short = (F.col("bin") == F.col("last")) & (F.col("upto") < F.col("target"))
        for r in run.filter(reached | short).collect():
            start, bits, _ = at.pop(r.node)
            shift = max(0, bits - BIN_BITS)
            low, before = start + (r.bin << shift), r.upto - r.b
            if shift == 0 or r.b <= TOLERANCE * 2 * r.target:
                cuts[r.node] = low if r.target - before < r.upto - r.target else low + (1 << shift)
            else:
                at[r.node] = (low, shift, before)
    return cuts


def lightest_first(weights: list[tuple], shards: int) -> tuple[dict, list[int]]:
    """Of (bytes, name) a shard for each name, the heaviest first to the lightest shard; and the shards' bytes."""
    loads, out = [(0, k) for k in range(shards)], {}
    for weight, name in sorted(weights, key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(loads)
        out[name] = k
        heapq.heappush(loads, (load + weight, k))
    return out, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def tree_shards(points: DataFrame, shards: int, room: list[int] | None = None) -> DataFrame:
    """Adds node, the number of a point's leaf from left to right: points have bytes, tie and values (an array). room: what
    the leaves shall get of all bytes, in proportion; by default the same."""
    room = room if room and sum(room) else [1] * shards
    spark = points.sparkSession
    placed = points.withColumn("node", F.lit(0))
    dimensions = len(DIMENSIONS)
    whole: list[float] = []
    open_ = {0: shards}  # the first shard of a node that is to be split: its shards
    while open_ := {k: n for k, n in open_.items() if n > 1}:
        spread = [f(F.element_at("values", d + 1)).alias(f"{f.__name__}{d}") for d in range(dimensions) for f in (F.min, F.max)]
        # a row for each node
        held = placed.groupBy("node").agg(F.sum("bytes").alias("total"), *spread).filter(F.col("node").isin(*open_))
        plan, asked, cuts = [], {}, {}
        for r in held.collect():
            width = [r[f"max{d}"] - r[f"min{d}"] for d in range(dimensions)]
            whole = whole or [x or 1.0 for x in width]
            d = max(range(dimensions), key=lambda k: width[k] / whole[k])
            n = open_[r.node]
            plan.append((r.node, d, float(r[f"min{d}"]), float(r[f"max{d}"])))
            left, both = sum(room[r.node : r.node + n // 2]), sum(room[r.node : r.node + n])
            left, both = (left, both) if both else (n // 2, n)
            if left:
                asked[r.node] = max(1, r.total * left // both)  # a cut at 0 bytes is never reached
            else:
                cuts[r.node] = 0
        if not plan:
            break
        splits = spark.createDataFrame(plan, "node int, dimension int, low double, high double")
        keyed = placed.join(F.broadcast(splits), "node", "left").withColumn("key", _key())
        keyed = written(keyed.select(*points.columns, "node", "key"), "level")
        found = [(k, cut, k + open_[k] // 2) for k, cut in (cuts | _cuts(keyed, asked)).items()]
        sides = spark.createDataFrame(found, "node int, cut long, right int")
        node = F.when(F.col("key") >= F.col("cut"), F.col("right")).otherwise(F.col("node"))
        placed = keyed.join(F.broadcast(sides), "node", "left").select(*points.columns, node.alias("node"))
        open_ = {j: m for k, n in open_.items() for j, m in ((k, n // 2), (k + n // 2, n - n // 2))}
    return placed


def shards_for(total_bytes: int, target_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def partition(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document, for so many shards or leaves of about so many bytes."""
    text = F.col("text")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
            F.crc32(F.coalesce(F.col("source"), F.lit(""))).cast("double").alias("source_code"),
            F.crc32(F.coalesce(F.col("lang"), F.lit(""))).cast("double").alias("lang_code"),
        ),
        "rows",
    )
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = whole.bytes or 0
    shards = shards or shards_for(total, target_bytes or 1 << 30)
    share = max(1, total // shards)
    group = ["text_hash", "text_crc32", "size"]
    # fewer groups than shards are heavier than one
    heavy = rows.groupBy(*group).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share)
    parts = heavy.select(*group, F.ceil(F.col("bytes") / share).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")
    cut = rows.join(F.broadcast(parts) if shards <= 4096 else parts, group, "left").withColumn("part", part)
    member = [*group, "part"]
    points = cut.groupBy(*member).agg(
        F.sum("size").alias("bytes"), F.min("source_code").alias("source_code"), F.min("lang_code").alias("lang_code")
    )
    values = F.array(F.log2(F.col("size").cast("double")), "source_code", "lang_code")
    points = written(points.select(*member, "bytes", F.xxhash64(*member).alias("tie"), values.alias("values")), "points")
    large = F.col("bytes") > max(1, int(GROUP_SHARE * share))
    # at most shards / GROUP_SHARE rows
    found = [(r.bytes, tuple(r)[:-1]) for r in points.filter(large).select(*member, "bytes").collect()]
    first, loads = lightest_first(found, shards)
    by_hand = docs.sparkSession.createDataFrame(
        [(*name, k) for name, k in first.items()], "text_hash long, text_crc32 long, size long, part int, shard int"
    )
    rest = tree_shards(points.filter(~large), shards, [max(0, share - load) for load in loads])
    placed = rest.select(*member, F.col("node").alias("shard")).unionByName(by_hand)
    joined = cut.select("doc_id", *member).join(placed, member)
    return numbered(joined, shards, whole.rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(rows: DataFrame, shards: int, count: int) -> DataFrame:
    """Adds slot: gapless within each shard."""
    buckets = max(1, math.ceil(count / (shards * SLOT_ROWS)))
    held = written(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).cast("int")), "placed")
    counts = held.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_hash")) - 1
    return held.withColumn("own", own).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("own"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return partition(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
