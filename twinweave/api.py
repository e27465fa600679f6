"""Matching of two or three versions of objects: the calls that a user makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import kernels
from twinweave.operators import estimation, evaluation, joins, matching, walk
from twinweave.sources import models, readers
from twinweave.storage import written


def code_objects(rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds code: the OR of the features' string codes."""
    code = F.lit(0).cast("long")
    for name in features:
        code = code.bitwiseOR(kernels.string_code(F.col(name).cast("string")))
    return rows.withColumn("code", code)


def match(
    left: DataFrame,
    right: DataFrame,
    features: dict[str, float],
    block: list[str] | None = None,
    thresholds: DataFrame | None = None,
    origin: DataFrame | None = None,
    exhaustive: bool = False,
) -> DataFrame:
    """(left_id, right_id[, origin_id]) of objects with id, type, the weighted text features and block columns.

    Candidates share their type (and the block columns, if any are named) and reach their type's code
    similarity. Each object takes the first of its candidates, the nearest by weighted text distance first, whose own
    nearest it is; matched ones leave, and the rest goes on to the end. With an origin, left objects are matched to it
    likewise, then what is left of right and origin to each other. Every object is in one row. A null feature
    is an empty text, a null block value is like another null one. exhaustive: all objects of a type are candidates,
    whatever their codes; for comparisons, as its work grows with the product of both sides.
    """
    names, block = list(features), block or []
    limits = thresholds if thresholds is not None else readers.built_in_thresholds(left.sparkSession)
    limits = written(limits.groupBy("type").agg(F.max("min_sim").alias("min_sim")), "thresholds")
    keys = ["type", *block]

    def side(rows: DataFrame) -> DataFrame:
        texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in names]
        return written(code_objects(rows.select("id", *keys, *texts), names), "side")

    def find(l: DataFrame, r: DataFrame) -> DataFrame:
        """The nearest left class of each right one, by pairs of similar codes."""
        kind = walk.key_of(*keys)
        codes = lambda d: d.select(F.to_json(kind).alias("type"), "code").distinct()
        least = limits.agg(F.min("min_sim")).first()[0]
        least = readers.DEFAULT_THRESHOLD if least is None else min(least, readers.DEFAULT_THRESHOLD)
        if exhaustive:
            a, b = (codes(d).select(F.col("type").alias("_kind"), F.col("code").alias(f"{s}_code")) for d, s in ((l, "left"), (r, "right")))
            near = a.join(b, "_kind").withColumn("sim", F.lit(2.0))
        else:
            near = joins.similar_codes(codes(l), codes(r), least).select(F.col("type").alias("_kind"), "left_code", "right_code", "sim")
        own = lambda d, s: d.select(F.to_json(kind).alias("_kind"), *(["type"] if s == "right" else []),
                                    *[F.col(c).alias(f"{s}_{c}") for c in ("code", "cls", *names)])
        met = near.join(own(l, "left"), ["_kind", "left_code"]).join(own(r, "right"), ["_kind", "right_code"])
        met = readers.with_threshold(met, limits).filter(F.col("sim") >= F.col("min_sim"))
        parts = [(matching.text_distance(F.col(f"left_{f}"), F.col(f"right_{f}")), weight) for f, weight in features.items()]
        dist = F.round(matching.weighted_distance(parts), 9)
        best = met.withColumn("dist", dist).filter(F.col("dist") <= matching.TOO_FAR).groupBy("right_cls").agg(F.min(F.struct("dist", "left_cls")).alias("own"))
        return best.select("own.left_cls", "right_cls", "own.dist")

    def matched(a: DataFrame, b: DataFrame) -> DataFrame:
        return written(walk.walk(a, b, (*keys, *names), find).select("left_id", "right_id"), "matches")

    l, r = side(left), side(right)
    if origin is None:
        return matching.completed(matched(l, r), l, r)
    return matching.three_sides(l, r, side(origin), matched)


def estimate(rows: DataFrame, text: str, count: int = 50) -> DataFrame:
    """(type, method, threshold, tpr, fpr, prec, acc, f2): for objects with type and a text the best threshold of each type
    and similarity, from so many mutants of each object at each rate of change; thresholds in hundredths."""
    return estimation.best_by_type(estimation.counted(estimation.samples(rows.select("type", F.col(text).alias("text")), count)))


def thresholds_of(estimated: DataFrame, method: str = "LSH_Cos") -> DataFrame:
    """(type, min_sim) for match, from what estimate gave."""
    return estimated.filter(F.col("method") == method).select("type", (F.col("threshold") / 100.0).alias("min_sim"))


def compare(left: DataFrame, right: DataFrame, features: dict[str, float], **options) -> DataFrame:
    """(total, diffs, rate): on how many left objects matching by codes and matching with all candidates differ."""
    found = lambda every: match(left, right, features, exhaustive=every, **options)
    own, whole = (found(every).filter("left_id IS NOT NULL").select("left_id", "right_id") for every in (False, True))
    counts = matching.agreement(own, whole).agg(F.count("*").alias("total"), F.count_if("differs").alias("diffs"))
    return counts.withColumn("rate", F.try_divide("diffs", "total"))


def box_plot(logs: DataFrame) -> DataFrame:
    """Box plots of the best F2 by hash and similarity, from the lines of estimation logs (see readers.log_lines)."""
    rows = readers.estimations(logs.filter("in_summary")).withColumn("kind", F.concat_ws("/", "hash", "sim"))
    return evaluation.boxplot(rows, "kind", "f2")


def bar_plot(logs: DataFrame) -> DataFrame:
    """(file, time_saved, diff_rate, critical_rate) in per cent, from the lines of comparison logs with their file."""
    found = readers.summaries(logs, ["file"])
    return found.select("file", ((F.col("own_time") - F.col("base_time")) / F.col("base_time") * 100).alias("time_saved"), "diff_rate", "critical_rate")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects from Parquet, or those of an XML model by its suffix."""
    if path.endswith((".xmi", ".ecore", ".uml")):
        return models.load(spark, path).objects
    return spark.read.parquet(path)
