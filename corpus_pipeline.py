"""From raw documents to packed training sequences: the stages, each over all that the one before it kept.

Every stage returns the columns of documents (the last one its pieces), whatever further columns the
table has; a null text passes each stage as an empty one. An empty table passes all stages. Rows that
repeat an id and its text are copies of each other, of which one stays; rows that share an id but are no
near copies both stay, as do rows without an id. Ties go to the smallest doc_id. A very long text is worked
on whole in each stage, and packing cuts it into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm import decontaminate, likeness, packing, pii, toxicity
from twinweave.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that go to a Python worker at once, in batches whose buffers the executor and its workers hold and keep
#: (Spark's default is 10,000, which at 2 KB of text is 20 MB in each of several copies).
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS for the session, unless it has a smaller number. (0 and less: Spark doesn't limit the rows.)"""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    small_batches(spark)
    scored = toxicity.scored(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays: SimHash links, checked and
    completed by the likeness of 5-word shingles (0.8 and more)."""
    small_batches(spark)
    return likeness.near_copies_removed(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    small_batches(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms; n_chars follows the text."""
    replaced = pii.pseudonymized(docs.select(*COLUMNS), pii.key_of(spark))
    length = F.when(F.col("n_pseudonyms") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing and training aren't expressible in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None
