"""Weighted draws: which item's interval of the running total a number falls into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.storage import written


def intervals(items: DataFrame, key: str, weight: str) -> DataFrame:
    """Adds low and high, the running total of whole weights before and with an item, in the key's order; items without
    a weight above 0 have none and go. Totals are added up by ranges of the key, so that no task holds all items."""
    kept = items.filter(F.col(weight) > 0)
    dealt = written(kept.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = F.sum(weight).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_own", own).join(starts, "_part")
    high = (F.col("_start") + F.col("_own")).cast("long")
    return placed.withColumn("low", (high - F.col(weight)).cast("long")).withColumn("high", high).drop("_part", "_own", "_start")


def drawn(draws: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
    """The draws (number in [0, total)) with their item: rows of ranges are (low, high, ...).

    The line of totals is cut into as many equal buckets as there are items; an item is sent to the buckets that it
    covers (in all, at most two for each item), a draw to its own, where few intervals are left to look at.
    """
    total, n = ranges.agg(F.max("high"), F.count("*")).first()
    width = max(1, -(-(total or 1) // max(1, n)))
    # an interval of many buckets is a row for each: at most as many rows as buckets and items together
    covered = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    sent = ranges.withColumn("_bucket", F.explode(covered))
    placed = draws.withColumn("_bucket", F.floor(F.col(number) / width))
    met = placed.join(sent, "_bucket").filter((F.col(number) >= F.col("low")) & (F.col(number) < F.col("high")))
    return met.drop("_bucket")
