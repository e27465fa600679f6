"""Quality of thresholds and matches: confusion counts, scores, quantiles, box plots, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 0.10, 0.11, ..., 0.80, in hundredths.
THRESHOLDS = range(10, 81)


def confusion(pairs: DataFrame) -> DataFrame:
    """From (category, sim, belongs, n), n being the pairs that a row stands for: TP, FN, FP, TN at each
    threshold, in hundredths.

    The pairs are first counted by the last threshold they reach, then summed up over the thresholds, so
    that no pair is multiplied by them.
    """
    reached = F.least(F.floor(F.col("sim") * 100 + 1e-9), F.lit(THRESHOLDS[-1])).cast("int")
    counts = pairs.groupBy("category", reached.alias("reached")).agg(
        F.sum(F.when(F.col("belongs"), F.col("n")).otherwise(0)).alias("own"),
        F.sum(F.when(F.col("belongs"), 0).otherwise(F.col("n"))).alias("other"),
    )
    steps = counts.sparkSession.range(THRESHOLDS[0], THRESHOLDS[-1] + 1).select(F.col("id").cast("int").alias("threshold"))
    # the counts have a row for each category and hundredth
    grid = counts.crossJoin(F.broadcast(steps))
    over = F.col("reached") >= F.col("threshold")
    out = grid.groupBy("category", "threshold").agg(
        F.sum(F.when(over, F.col("own")).otherwise(0)).alias("tp"),
        F.sum(F.when(over, 0).otherwise(F.col("own"))).alias("fn"),
        F.sum(F.when(over, F.col("other")).otherwise(0)).alias("fp"),
        F.sum(F.when(over, 0).otherwise(F.col("other"))).alias("tn"),
    )
    return out


def _share(top: Column, below: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), below.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """True and false positive rates, precision and accuracy."""
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return counts.select(
        "category", "threshold", _share(tp, tp + fn).alias("tpr"), _share(fp, fp + tn).alias("fpr"),
        _share(tp, tp + fp).alias("prec"), _share(tp + tn, tp + tn + fp + fn).alias("acc"),
    )


def f_beta(precision: Column, recall: Column, beta: float = 2.0) -> Column:
    b = beta * beta
    return F.try_divide((1 + b) * precision * recall, b * precision + recall)


def best_threshold(scores: DataFrame) -> DataFrame:
    """Of the thresholds' means over categories the one with the best F; of equal ones the lowest."""
    means = scores.groupBy("threshold").agg(F.avg("tpr").alias("recall"), F.avg("prec").alias("prec"))
    scored = means.withColumn("f2", F.round(f_beta(F.col("prec"), F.col("recall")), 9)).filter("f2 IS NOT NULL")
    top = F.max(F.struct("f2", (-F.col("threshold")).alias("low"))).alias("top")
    return scored.agg(top).select((-F.col("top.low")).alias("threshold"), F.col("top.f2").alias("f2"))


def boxplot(rows: DataFrame, by: str, value: str, fence: float = 2.25) -> DataFrame:
    """Quartiles, and the outermost values within the fences (in interquartile ranges).

    A quartile lies at p (n + 1) - 1 from four values on and at (n - 1) p below, between neighbours in
    proportion. Equal values are counted before anything is brought together.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("k"))
    own = Window.partitionBy(by)
    run = counts.withColumn("upto", F.sum("k").over(own.orderBy(value))).withColumn("n", F.sum("k").over(own))
    at: list[Column] = []
    between: list[Column] = []
    for q, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        n = F.col("n")
        place = F.when(n >= 4, F.lit(p) * (n + 1) - 1).otherwise((n - 1) * F.lit(p))
        low = F.floor(place)
        for name, rank in (("a", low), ("b", F.least(low + 1, n - 1))):
            here = (F.col("upto") - F.col("k") <= rank) & (rank < F.col("upto"))
            at.append(F.max(F.when(here, F.col(value))).alias(f"{q}{name}"))
        at.append(F.max(place - low).alias(f"{q}w"))
        between.append((F.col(f"{q}a") + (F.col(f"{q}b") - F.col(f"{q}a")) * F.col(f"{q}w")).alias(q))
    quartiles = run.groupBy(by).agg(*at).select(by, *between)
    reach = (F.col("q3") - F.col("q1")) * fence
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    met = counts.join(quartiles, by).groupBy(by, "q1", "q2", "q3")
    return met.agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
