"""Estimating the thresholds of similarities: mutants of growing change against all objects of their type.

For each rate of change every object has some mutants. A mutant belongs to the objects that are near enough by exact
distance; once over OVER of a type's mutants no longer belong to the object that they come from, larger rates tell nothing
and aren't used. All rates are one grouped plan, the stop is a cut by each type's counts. Each mutant is then held against
all objects of its type by four similarities: of codes by cosine, Jaccard and Sorensen, and of word sets.

Objects with one type and text are one row with their number. Every mutant is compared with every distinct text of its
type, as an estimate of false alarms asks for, so the work grows with the square of a type's distinct texts.

A null text is an empty one; a type's empty texts have no letters to change and belong to themselves at every rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.functions import kernels as K
from twinweave.functions import similarity as S
from twinweave.operators import evaluation, matching
from twinweave.storage import written

#: Rates of change in tenths; the share of mutants without their object at which larger rates are left out.
RATES, OVER = range(1, 11), 0.8
#: A mutant within this distance belongs to an object.
NEAR = 0.25
METHODS = ("LSH_Cos", "LSH_Jac", "LSH_Sor", "OneHot")


def mutant(text: Column, rate: Column, number: Column) -> Column:
    """The text with that many tenths of its letters replaced, which ones and by what follows from their places and the
    mutant's number."""
    letter = lambda p: F.chr(F.lit(97) + F.pmod(p * 5 + number * 3, F.lit(26)))
    changed = lambda c, p: F.when((F.pmod((p + 1) * 7 + number * 13, F.lit(10)) < rate) & (c != ""), letter(p + 1)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), changed), "")


def mutants(objects: DataFrame, count: int) -> DataFrame:
    """(type, text, n, rate, number, mutant) from (type, text): distinct texts with the number of their objects."""
    texts = objects.select("type", F.coalesce("text", F.lit("")).alias("text")).groupBy("type", "text").agg(F.count("*").alias("n"))
    every = texts.withColumn("rate", F.explode(F.array(*map(F.lit, RATES)))).withColumn("number", F.explode(F.array(*map(F.lit, range(count)))))
    return every.withColumn("mutant", mutant(F.col("text"), F.col("rate"), F.col("number")))


def belongs(a: Column, b: Column) -> Column:
    return matching.text_distance(a, b) <= NEAR


def rates_used(made: DataFrame) -> DataFrame:
    """(type, last): the last rate of each type: the first at which over OVER of the mutants lose their object, else all."""
    lost = F.sum(F.when(belongs(F.col("text"), F.col("mutant")), F.lit(0)).otherwise(F.col("n")))
    shares = made.groupBy("type", "rate").agg((lost / F.sum("n")).alias("lost"))
    return shares.groupBy("type").agg(F.coalesce(F.min(F.when(F.col("lost") > OVER, F.col("rate"))), F.lit(RATES[-1])).alias("last"))


def word_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the words; 1 for two texts without any."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    every = F.size(F.array_union(words(a), words(b)))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))).cast("double") / F.greatest(every, F.lit(1)))


def samples(objects: DataFrame, count: int) -> DataFrame:
    """(type, method, sim, belongs, n) of the mutants of the used rates and all objects of their type."""
    made = written(mutants(objects, count), "mutants")
    used = made.join(rates_used(made), "type").filter(F.col("rate") <= F.col("last"))
    kinds = used.groupBy("type", "mutant").agg(F.sum("n").alias("mutant_n"))
    codes = written(kinds.select(F.col("mutant").alias("x")).union(made.select("text")).distinct().withColumn("code", K.string_code(F.col("x"))), "codes")
    own = kinds.join(codes.select(F.col("x").alias("mutant"), F.col("code").alias("a")), "mutant")
    texts = made.select("type", "text", "n").distinct().join(codes.select(F.col("x").alias("text"), F.col("code").alias("b")), "text")
    met = own.join(texts, "type")
    a, b = F.col("a"), F.col("b")
    sims = (S.cosine(a, b), S.jaccard(a, b), S.sorensen(a, b), word_likeness(F.col("mutant"), F.col("text")))
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("sim")) for m, s in zip(METHODS, sims, strict=True)])
    rows = met.select("type", belongs(F.col("text"), F.col("mutant")).alias("belongs"), (F.col("mutant_n") * F.col("n")).alias("n"), F.explode(each).alias("own"))
    return rows.select("type", "own.method", "own.sim", "belongs", "n")


def counted(rows: DataFrame) -> DataFrame:
    """(type, method, threshold, tp, fn, fp, tn)."""
    both = rows.select(F.struct("type", "method").alias("category"), "sim", "belongs", "n")
    return evaluation.confusion(both).select("category.*", "threshold", "tp", "fn", "fp", "tn")


def best_by_type(counts: DataFrame) -> DataFrame:
    """(type, method, threshold, tpr, fpr, prec, acc, f2): each type's threshold with the best F2, of equal ones the lowest."""
    scores = evaluation.metrics(counts.select(F.struct("type", "method").alias("category"), "threshold", "tp", "fn", "fp", "tn"))
    scored = scores.withColumn("f2", F.round(evaluation.f_beta(F.col("prec"), F.col("tpr")), 9)).filter("f2 IS NOT NULL")
    # 71 rows for each type and method
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("f2"), "threshold"))
    best = scored.withColumn("_k", place).filter("_k = 1")
    return best.select("category.*", "threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "prec", "acc")], "f2")


def best_micro(counts: DataFrame) -> DataFrame:
    """(method, threshold, f1): over all types' counts together the threshold with the best F1, of equal ones the highest."""
    sums = counts.groupBy("method", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    f1 = F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)
    top = F.max(F.struct(f1.alias("f1"), "threshold")).alias("top")
    return sums.filter("tp > 0").groupBy("method").agg(top).select("method", "top.threshold", "top.f1")
