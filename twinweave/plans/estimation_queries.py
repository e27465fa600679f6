"""Queries of the estimation of thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.model import table
from twinweave.operators import estimation
from twinweave.plans import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Mutants of an object at each rate.
COUNT = 2


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


_BELONGS = f"(CASE WHEN greatest(length(text), length(mutant)) = 0 THEN 0.0 ELSE levenshtein(text, mutant)::DOUBLE / greatest(length(text), length(mutant), 1) END <= {estimation.NEAR})"
_WORDS = "list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_A, _B = _WORDS.format(x="mutant"), _WORDS.format(x="text")
_MADE = f"""texts AS (SELECT p_type AS type, p_name AS text, count(*) AS n FROM part GROUP BY ALL),
made AS (SELECT type, text, n, rate, number, array_to_string(list_transform(string_split(text, ''),
    lambda c, p: CASE WHEN (p * 7 + number * 13) % 10 < rate THEN chr((97 + (p * 5 + number * 3) % 26)::INT) ELSE c END), '') AS mutant
  FROM texts, range(1, 11) r(rate), range(0, {COUNT}) m(number)),
lost AS (SELECT type, rate, sum(CASE WHEN {_BELONGS} THEN 0 ELSE n END)::DOUBLE / sum(n) AS lost FROM made GROUP BY ALL),
used AS (SELECT type, coalesce(min(rate) FILTER (lost > {estimation.OVER}), 10) AS last FROM lost GROUP BY 1)"""
_COUNTS = f"""{_MADE}, kinds AS (SELECT type, mutant, sum(n) AS mutant_n FROM made JOIN used USING (type) WHERE rate <= last GROUP BY ALL),
coded AS (SELECT type, mutant, mutant_n, {sql.string_code("mutant")} AS a FROM kinds), own AS (SELECT type, text, n, {sql.string_code("text")} AS b FROM texts),
met AS (SELECT type, {_BELONGS} AS belongs, mutant_n * n AS n, {sql.cosine("a", "b")} AS s0, {sql.jaccard("a", "b")} AS s1, {sql.sorensen("a", "b")} AS s2,
  CASE WHEN len(list_distinct(list_concat({_A}, {_B}))) = 0 THEN 1.0 ELSE len(list_intersect({_A}, {_B}))::DOUBLE / len(list_distinct(list_concat({_A}, {_B}))) END AS s3
  FROM coded JOIN own USING (type)),
every AS ({" UNION ALL ".join(f"SELECT type, '{m}' AS method, round(s{k}, 9) AS sim, belongs, n FROM met" for k, m in enumerate(estimation.METHODS))}),
reached AS (SELECT type, method, least(floor(sim * 100 + 1e-9), 80) AS reached, belongs, sum(n) AS n FROM every GROUP BY ALL),
k AS (SELECT type, method, threshold, coalesce(sum(n) FILTER (belongs AND reached >= threshold), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (belongs AND reached < threshold), 0)::BIGINT AS fn,
  coalesce(sum(n) FILTER (NOT belongs AND reached >= threshold), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (NOT belongs AND reached < threshold), 0)::BIGINT AS tn
  FROM reached, range(10, 81) t(threshold) GROUP BY ALL)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("text"))


@query(f"WITH {_MADE} SELECT type, last::INT AS last FROM used")
def estimation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to which rate of change each type's mutants are used."""
    return estimation.rates_used(estimation.mutants(objects(spark, sf_dir), COUNT))


@query(f"""WITH {_COUNTS}, s AS (SELECT type, method, threshold, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS tpr, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0) AS fpr,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS prec, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0.0) AS acc FROM k),
f AS (SELECT *, round(5.0 * prec * tpr / nullif(4.0 * prec + tpr, 0), 9) AS f2 FROM s)
SELECT type, method, threshold::INT AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(prec, 9) AS prec, round(acc, 9) AS acc, f2
FROM f WHERE f2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY type, method ORDER BY f2 DESC, threshold) = 1""")
def estimation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's best threshold for each of the four similarities."""
    return estimation.best_by_type(estimation.counted(estimation.samples(objects(spark, sf_dir), COUNT)))


@query(f"""WITH {_COUNTS}, s AS (SELECT method, threshold, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM k GROUP BY ALL),
f AS (SELECT method, threshold, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM s WHERE tp > 0)
SELECT method, threshold::INT AS threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, threshold DESC) = 1""")
def estimation_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold for all types, for each similarity."""
    return estimation.best_micro(estimation.counted(estimation.samples(objects(spark, sf_dir), COUNT)))
