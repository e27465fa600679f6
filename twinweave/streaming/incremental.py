"""Matching as versions arrive: a stream of objects is coded and kept with its watermark, batch by batch matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinweave.functions import kernels


def coded_stream(stream: DataFrame, text: str) -> DataFrame:
    """Adds code: built from functions alone, so it runs within the stream's own stage."""
    return stream.withColumn("code", kernels.string_code(F.col(text)))


def codes_per_window(stream: DataFrame, time: str, by: str, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """For each window and type the OR of all codes, and how many objects came; late ones beyond the watermark go."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    windowed = timed.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), by)
    return windowed.agg(F.bit_or("code").alias("code"), F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), by, "code", "n"
    )


def match_each_batch(stream: DataFrame, known: DataFrame, keys: list[str], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch's objects joined to the known ones by type and code; write gets the pairs and the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch.join(known, keys), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
