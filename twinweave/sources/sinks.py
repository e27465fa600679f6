"""Sinks of match results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matches(matches: DataFrame, path: str, kind: str = "parquet") -> None:
    matches.write.mode("overwrite").format(kind).save(path)


def write_text(matches: DataFrame, path: str) -> None:
    """One match a line: left, right and origin, a dash where there is none."""
    sides = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("left_id", "right_id", "origin_id") if c in matches.columns]
    matches.select(F.concat_ws(" <-> ", *sides).alias("value")).write.mode("overwrite").text(path)


def with_stable_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds object_id, the same for the same keys in every run."""
    return rows.withColumn("object_id", F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]), 256))
