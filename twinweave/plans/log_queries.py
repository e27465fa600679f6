"""Queries that read text forms: logs and threshold tables, derived from the given tables line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import kernels as K
from twinweave.model import table
from twinweave.operators import evaluation
from twinweave.plans import match_queries, sql
from twinweave.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


@query("SELECT c_mktsegment AS type, round(0.4::DOUBLE + count(*) % 40 / 100.0::DOUBLE, 2) AS min_sim FROM customer GROUP BY 1")
def threshold_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a threshold table, made from the customers' segments and read back."""
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    value = F.format_string("%.2f", F.round(F.lit(0.4) + F.col("n") % 40 / 100.0, 2))
    lines = counts.select(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" = "), value, F.lit(" ")).alias("value"))
    return readers.thresholds_from_text(lines)


@query("""SELECT o_custkey, min(q) AS least_edits, max(q) AS most_edits, round(min(d * 100.0::DOUBLE / t), 6) AS least_rate, round(max(d * 100.0::DOUBLE / t), 6) AS most_rate,
round(avg(d * 100.0::DOUBLE / t), 6) AS mean_rate, arg_max(t, o_orderkey) AS last_total, count(*) AS runs
FROM (SELECT o_custkey, o_orderkey, o_orderkey % 100 AS q, o_orderkey % 7 AS d, 7 + o_orderkey % 50 AS t FROM orders) GROUP BY 1""")
def comparison_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log line for each order, read back and summed up by customer: edits, shares of differences, the last total."""
    key = F.col("o_orderkey")
    line = F.format_string("run_%d [numOfEdits=%d, time=%d, diffs=%d, total=%d, criticalMiss=%d]", key, key % 100, key % 13, key % 7, 7 + key % 50, key % 3)
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("value"))
    runs = readers.comparisons(lines)
    rate = F.col("diffs") * 100.0 / F.col("total")
    return runs.groupBy("o_custkey").agg(
        F.min("edits").alias("least_edits"), F.max("edits").alias("most_edits"), F.round(F.min(rate), 6).alias("least_rate"),
        F.round(F.max(rate), 6).alias("most_rate"), F.round(F.avg(rate), 6).alias("mean_rate"),
        F.max_by("total", "o_orderkey").alias("last_total"), F.count("*").alias("runs"),
    )


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 5)::BIGINT AS d FROM orders GROUP BY 1)
SELECT o_custkey % 10 AS folder, round(avg(((n + 1) - (n + 1 + d)) * 100.0::DOUBLE / (n + 1 + d)), 6) AS time_reduction, round(avg(d + 0.25::DOUBLE), 6) AS disagreement, count(*) AS logs FROM c GROUP BY 1""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole log file for each customer; the summaries are read back and averaged: saved time and differences in percent."""
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(key % 5).alias("d"))
    text = F.concat_ws(
        "\n", F.lit("run_1 [numOfEdits=1, time=1, diffs=1, total=1, criticalMiss=0]"), F.lit("====================[SUMMARY]====================="),
        F.format_string("Time:    Avg(own)=%d.0    Avg(base)=%d.0", F.col("n") + 1, F.col("n") + 1 + F.col("d")),
        F.format_string("Diff Rate:    Total=%d.25%%    Critical=%d.5%%", F.col("d"), F.col("d")),
    )
    logs = readers.summaries(readers.log_lines(c.select("o_custkey", text.alias("value"))), ["o_custkey"])
    saved = (F.col("own_time") - F.col("base_time")) * 100.0 / F.col("base_time")
    return logs.groupBy((F.col("o_custkey") % 10).alias("folder")).agg(
        F.round(F.avg(saved), 6).alias("time_reduction"), F.round(F.avg("diff_rate"), 6).alias("disagreement"), F.count("*").alias("logs")
    )


_PARTS = ", ".join(f"sum(floor({c} * 10000 + 1e-6)::BIGINT)::BIGINT AS {c}" for c in ("tpr", "fpr", "prec", "acc"))


@query(f"""WITH {match_queries._CONFUSION}, {match_queries._METRICS}
SELECT category AS type, count(*) AS n, sum(threshold)::BIGINT AS thresholds, {_PARTS} FROM s GROUP BY 1""")
def estimation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimation log of the thresholds' scores, to four places, read back: each type's sums in ten thousandths."""
    names = ("tpr", "fpr", "prec", "acc")
    scores = evaluation.metrics(evaluation.confusion(match_queries.labelled(spark, sf_dir)))
    shown = [F.format_string("%.4f", F.floor(F.col(c) * 10000 + 1e-6) / 10000.0) for c in names]
    line = F.concat(
        F.lit("["), "category", F.lit("]    [LSH_Cos]    threshold="), F.format_string("%.4f", F.col("threshold") / 100.0), F.lit("    TPR="), shown[0],
        F.lit("    FPR="), shown[1], F.lit("    Prec="), shown[2], F.lit("    Recall="), shown[0], F.lit("    Acc="), shown[3], F.lit("    F2=0.0"),
    )
    # a file for each type, with one line for each threshold
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    head, tail = "=====================[SUMMARY]======================\n", "\n======================[CONFIG]======================\nthresholds"
    files = scores.groupBy("category").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value")).select("value")
    rows = readers.estimations(readers.log_lines(files).filter("in_summary")).filter("hash = 'LSH' AND sim = 'Cos'")
    whole = lambda c, by: F.sum(F.round(F.col(c) * by).cast("long"))
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), whole("threshold", 100).alias("thresholds"), *[whole(c, 10000).alias(c) for c in names]
    )


@query(f"SELECT event_type, bit_or({sql.string_code('event_type')} | {sql.bit(sql.long_position('user_id'))}) AS code, count(*) AS n FROM events GROUP BY 1")
def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code for each kind of event, from its name and its users."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id")
    users = events.groupBy("event_type").agg(F.bit_or(K.onehot(K.long_position(F.col("user_id")))).alias("users"), F.count("*").alias("n"))
    return users.select("event_type", K.string_code(F.col("event_type")).bitwiseOR(F.col("users")).alias("code"), "n")
