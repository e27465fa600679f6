"""Toxicity scores from FTRL-proximal logistic regression (McMahan et al. 2013).

Features are hashed words, pairs of neighbouring words and pairs with one word between them (skip-grams),
each present or not. Every coordinate has its own rate, and the L1 term sets rare or uninformative ones to
zero, so what is left is a small sparse vector that goes to the tasks with their code.

Learning is bounded: of all labelled rows of the learning folds the share, by a hash of id and text, that
holds about TRAINING_ROWS rows and TRAINING_BYTES of text, whichever is less. Many tasks compute their
features; one task, which thus gets about twice TRAINING_BYTES, goes over them in ROUNDS passes, in an
order that the hashes give. Rows with the same text count each.

Defined cases: a null text is empty and gets the score of the bias alone, as has any text without known
words; rows with a null label aren't learned from; without any labelled row all scores are 0.5; a null
doc_id is in fold crc32('') mod 3; repeated rows are scored each, equal texts alike; a very long text is read
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import fold, lots, table

TRAINING_ROWS, TRAINING_BYTES = 12_000, 64_000_000
ROUNDS = 10
#: Coordinates: 2 ** BITS, the last one the bias.
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.7
#: Words whose hash a Python worker remembers.
CACHE = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_SIZE = 1 << BITS


class Features:
    """Coordinates of a text's features."""

    PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        pairs = h[:-1] * self.PAIR + h[1:]
        skips = h[:-2] * self.SKIP + h[2:]
        every = np.concatenate((h, pairs, skips))
        every ^= every >> np.uint64(32)
        every *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(every >> np.uint64(64 - BITS)).astype(np.int64)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's closed form: zero within the L1 bound, else scaled by the coordinate's own rate."""
    w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def learn(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over the rows; z and n change in place. The bias is free of L1."""
    for at, label in rows:
        at = np.append(at, _SIZE)
        w = weights_of(z[at], n[at])
        w[-1] = -z[_SIZE] / ((BETA + np.sqrt(n[_SIZE])) / ALPHA + L2)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def _learn_all(frame: pd.DataFrame) -> pd.DataFrame:
    """All passes: the coordinates that aren't zero, their weights, and the bias."""
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    frame = frame.sort_values(["place", "doc_id", "features"])
    labels = frame.toxic.astype(int).tolist()
    for _ in range(ROUNDS):
        rows = (np.frombuffer(x, dtype="<i4") for x in frame.features)
        learn(zip(rows, labels, strict=True), z, n)
    w = weights_of(z, n)
    at = np.flatnonzero(w[:_SIZE])
    bias = -z[_SIZE] / ((BETA + np.sqrt(n[_SIZE])) / ALPHA + L2)
    return pd.DataFrame({"at": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f4").tobytes()], "bias": [bias]})


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """From (doc_id, text, toxic, n_bytes): the coordinates that aren't zero, their weights, and the bias."""
    whole = labelled.agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes")).first()
    share = min(1.0, TRAINING_ROWS / max(1, whole.rows), TRAINING_BYTES / max(1, whole.bytes or 0))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for frame in lots(frames):
            frame = frame.copy()
            frame["features"] = [features(x).astype("<i4").tobytes() for x in frame.text]
            yield frame[["doc_id", "features", "toxic", "place"]]

    dealt = sample.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        "text",
        F.col("toxic").cast("int").alias("toxic"),
        F.xxhash64("doc_id", "text", F.lit(1)).alias("place"),
    )
    rows = dealt.mapInPandas(featured, "doc_id long, features binary, toxic int, place long")
    got = rows.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(_learn_all, "at binary, w binary, bias double").collect()
    if not got:
        return np.array([], dtype=np.int32), np.array([], dtype=np.float32), 0.0
    return np.frombuffer(got[0].at, dtype="<i4"), np.frombuffer(got[0].w, dtype="<f4"), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The probability of label 1, from column text."""
    at, weights, bias = model

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(_SIZE, dtype=np.float64)
        w[at] = weights
        features = Features()
        for texts in batches:
            yield pd.Series([float(sigmoid(bias + w[features(x)].sum())) for x in texts])

    return probability(F.coalesce("text", F.lit("")))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows to learn from: labelled documents outside the held-out fold.

    n_bytes is taken before the join, so that adding it up moves no text.
    """
    known = labels.filter("toxic IS NOT NULL").select(F.col("doc_id").alias("_id"), "toxic")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("n_bytes")).filter(fold(F.col("doc_id"), 3) != 1)
    return own.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", "n_bytes")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs and toxicity_score, which replaces a column of that name."""
    return docs.withColumn("toxicity_score", score(docs, train(labelled_rows(docs, labels))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        F.when(F.col("toxicity_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
