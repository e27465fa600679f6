"""Document fingerprints as threshold-scaled sketches.

A text's shingles are runs of WIDTH code points (a shorter text is one shingle). Of their 64-bit hashes
the sketch keeps all below a fixed FRACTION of the range, so the sketch of a union is the union of the
sketches, and the share of A's hashes found in B estimates how much of A is contained in B, however
unequal the two are. If none is below, the smallest hash is kept, so that no text has an empty sketch;
in a union it gives way to any hash that is below, or else to a smaller one (merge).

Defined cases: a null text is empty, an empty text's sketch holds the hash of the empty shingle; equal
texts have equal sketches; rows go by descending doc_id, nulls last, equal ids by their text's hash;
an only row is its own next; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import batches_of, lots, table

WIDTH = 16
FRACTION = 16
#: Bytes of text in one range of doc_ids.
RANGE_BYTES = 16_000_000
#: Ranges whose table may be broadcast.
BROADCAST_RANGES = 100_000
#: Hex digits of a kept hash.
DIGITS = 10

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads a polynomial's value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of so many code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    if len(points) <= width:
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in points:
                value = value * _BASE + x
            return _mix(np.array([value + np.uint64(len(points) if len(points) < width else 0) * _BASE]))
    # runs of 2, 4, 8, ... code points, each from two of half the length
    runs, power, length = points, _BASE, 1
    while length < width:
        runs = runs[:-length] * power + runs[length:]
        with np.errstate(over="ignore"):
            power, length = power * power, 2 * length
    return _mix(runs)


def sketch(text: str, width: int = WIDTH, fraction: int = FRACTION) -> np.ndarray:
    """The distinct kept hashes in order, cut to DIGITS hex digits below the threshold's bits."""
    hashes = shingle_hashes(text, width)
    kept = hashes[hashes < np.uint64((1 << 64) // fraction)]
    if not len(kept):
        kept = hashes.min(keepdims=True)
    return np.unique(kept >> np.uint64(64 - 4 * DIGITS))


def to_text(kept: np.ndarray) -> str:
    raw = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :]
    return raw.tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[k : k + DIGITS], 16) for k in range(0, len(fingerprint), DIGITS)], dtype=np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of the union of both texts' shingles."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64((1 << 4 * DIGITS) // fraction)]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a that is in b."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The greater containment: the share of the smaller sketch that the other has too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def sketches(docs: DataFrame, width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in lots(frames):
            prints = [to_text(sketch(x, width, fraction)) for x in frame.text]
            yield pd.DataFrame(
                {"doc_id": frame.doc_id.astype("Int64"), "n_chars": frame.text.str.len(), "fingerprint": prints}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range follow each other, each the next one of the row before; copies are only that."""

    def rows() -> Iterator[tuple]:
        before = None
        for frame in lots(frames):
            for part, copy, doc_id, none, text in zip(
                frame.part, frame.copied, frame.doc_id, frame.no_id, frame.text, strict=True
            ):
                own = sketch(text)
                if before and before[0] == part and not before[1]:
                    _, _, last_id, last, last_sketch = before
                    cut = len(last) // 3
                    edited = last[: len(last) - cut] + text[:cut]
                    changed = sketch(edited)
                    yield (
                        last_id, len(last), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        to_text(last_sketch), to_text(changed), likeness(last_sketch, changed),
                        likeness(last_sketch, own),
                    )
                before = (part, copy, None if none else int(doc_id), text, own)

    for frame in batches_of(rows(), [x.split()[0] for x in COMPARED.split(", ")]):
        yield frame.astype({"doc_id": "Int64"})


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text against its edited form and against the next text in descending doc_id.

    Ranges of doc_ids of about RANGE_BYTES, found from quantiles, are sorted each in a task. The rows
    with a range's greatest id are also sent to the range before it, so that each row meets its next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0) // RANGE_BYTES))
    cuts = np.array([], dtype=np.int64)
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("q")).first().q
        cuts = np.unique(np.array(found or [], dtype=np.int64))[::-1]

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        """Ranges are numbered from the greatest ids down."""
        return pd.Series(np.searchsorted(-cuts, -doc_id.to_numpy(np.int64), side="right"), dtype="int32")

    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(range_of(F.coalesce("doc_id", F.lit(0))))
    placed = rows.withColumn("part", part)
    # one row for each range
    tops = sorted((r.part, r.top) for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], COMPARED)
    before = [(own, top, tops[k - 1][0]) for k, (own, top) in enumerate(tops)]
    targets = spark.createDataFrame(before, "part int, top long, target int")
    # a row of 16 bytes for each range; beyond BROADCAST_RANGES of them the planner chooses
    small = F.broadcast(targets) if len(tops) <= BROADCAST_RANGES else targets
    met = placed.join(small, "part").withColumn(
        "target", F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.col("target"))
    )
    # (range, whether a copy): its own, and for a range's first rows the one before
    places = F.array(
        F.struct(F.col("part"), F.lit(False).alias("copied")),
        F.struct(F.col("target").alias("part"), F.lit(True).alias("copied")),
    )
    sent = met.select("doc_id", "text", F.explode(places).alias("place")).filter("place.part IS NOT NULL")
    dealt = sent.select(
        "place.part",
        "place.copied",
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        "text",
    ).repartition("part")
    ordered = dealt.sortWithinPartitions("part", "copied", "no_id", F.desc("doc_id"), F.xxhash64("text"), "text")
    return ordered.mapInPandas(_compare, COMPARED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
