"""Packing of whole documents into as few sequences as possible: dominance reduction, then best fit.

A document of more than CAPACITY tokens is cut into full pieces behind a shorter first one; every other
document is one piece. So the instance is how many pieces there are of each length: a table of at most
CAPACITY rows, whatever the number of documents, and it alone goes to the driver.

There the reduction of Martello and Toth fixes a set of up to three lengths around the longest free piece
wherever that set dominates all others that hold the piece: any packing can be changed into one that has
the set as a sequence and is no longer. Many pieces of one length are fixed at once, and what is left shrinks until no
set is found. Best fit, the longest pieces first, packs the remainder, again many equal sequences at once.

The result is a list of patterns (which lengths, how many sequences). Pieces of a length are numbered in
the cluster, by their task and their place in it, and a number says which place of which pattern is
its own. No text moves: the shuffles carry some 50 bytes a piece.

Defined cases: a null text is empty and gives just the end id; a null doc_id stays null; repeated rows are
packed each; pieces of equal length are equal for the packing, their numbers decide; a very long text is cut as
said; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinweave.llm.common import batches_of, lots, table, written

CAPACITY = 1024
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ByteTokenizer:
    """The ids that a byte-level BPE of the tokenizers library gives, from the file's own vocabulary in tiktoken, which
    takes a quarter of the time. Texts that hold one of the file's special tokens go through the library itself."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        words = self.library.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in words.items() if w not in self.special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Its ids as little-endian 32-bit numbers."""
        if any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _smallest(free: list[int], above: int, n: int, but: int = 0) -> list[int]:
    """The n smallest free lengths over a bound, with repeats; of one length a piece is set aside."""
    out: list[int] = []
    for x in range(above + 1, len(free)):
        if have := free[x] - (x == but):
            out += [x] * min(have, n - len(out))
            if len(out) == n:
                break
    return out


def _largest(free: list[int], most: int, *but: int) -> int:
    """The largest free length up to a bound, some pieces set aside; 0 if none."""
    return next((x for x in range(min(most, len(free) - 1), 0, -1) if free[x] > but.count(x)), 0)


def dominating(free: list[int], size: int, capacity: int) -> tuple[int, ...] | None:
    """A set of lengths around a free piece of this size that dominates every feasible set with it, if one is found.

    A set dominates another one if the other's pieces, put together in groups, each fit in place of one of its own.
    """
    room = capacity - size
    least = _smallest(free, 0, 3, size)
    if not least or least[0] > room:
        return (size,)
    best = _largest(free, room, size)
    if best == room or len(least) == 1 or least[0] + least[1] > room:
        return (size, best)
    if len(least) == 3 and sum(least) <= room:
        return None
    # two more pieces fit, but no three
    pair = 0
    for a in range(best, 0, -1):
        if 2 * a <= pair:
            break
        if free[a] - (a == size):
            b = _largest(free, min(a, room - a), size, a)
            pair = max(pair, a + b) if b else pair
    if best >= pair:
        return (size, best)
    partner = _largest(free, room - best, size, best)
    if best + partner == pair:
        between = _smallest(free, partner, 2, size)
        if len(between) < 2 or size + sum(between) > capacity:
            return (size, best, partner)
    return None


def reduction(free: list[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets (lengths, how many times) and takes them out of free, until none is found.

    A set that dominates goes on doing so while all its lengths are there: taking pieces away adds no choice.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while free[size] and (own := dominating(free, size, capacity)):
                times = min(free[x] // n for x, n in Counter(own).items())
                for x in own:
                    free[x] -= times
                fixed.append((own, times))
                changed = True
    return fixed


def best_fit(free: list[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packs pieces, the longest first, each into the fullest sequence with room; (lengths, how many times).

    Equal sequences are one row: all pieces of a length go on together, and split at most one row in two.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in range(capacity, 0, -1):
        left = free[size]
        while left:
            room = next((r for r in range(size, capacity) if open_[r]), capacity)
            lengths, rows = open_[room].pop() if room < capacity else ((), left)
            each = room // size
            full = min(rows, left // each)
            if full:
                open_[room - each * size].append((lengths + (size,) * each, full))
                left -= full * each
            if left and full < rows:
                # fewer pieces than one sequence takes
                open_[room - left * size].append((lengths + (size,) * left, 1))
                left, full = 0, full + 1
            if lengths and full < rows:
                open_[room].append((lengths, rows - full))
    return [x for rows in open_.values() for x in rows]


def pattern_list(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that hold so many pieces of each length."""
    free = [0] * (capacity + 1)
    for size, n in counts.items():
        free[size] = n
    fixed = reduction(free, capacity)
    return fixed + best_fit(free, capacity)


def runs_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first number, sequences, first sequence, offset): in turn the numbers from the first one on
    belong to the first copy of the length in each of these sequences, then to the second one, and so on."""
    rows, given, sequence = defaultdict(list), Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for size, copies in Counter(lengths).items():
            rows[size].append((given[size], times, sequence, offset))
            given[size] += times * copies
            offset += size * copies
        sequence += times
    return {size: np.array(own, dtype=np.int64) for size, own in rows.items()}


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece, with its task and its place among the task's pieces of its length."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        end, ids_of = np.array([end_id], dtype="<u4").tobytes(), ByteTokenizer(path)

        def rows() -> Iterator[tuple]:
            for frame in lots(frames):
                for doc_id, none, text in zip(frame.doc_id, frame.no_id, frame.text, strict=True):
                    whole, start = ids_of(text) + end, 0
                    n = len(whole) // 4
                    length = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        crc = zlib.crc32(memoryview(whole)[4 * start : 4 * (start + length)])
                        yield None if none else int(doc_id), piece, start, length, crc, part, seen[length]
                        seen[length] += 1
                        start, length = start + length, capacity

        for frame in batches_of(rows(), [x.split()[0] for x in PIECE.split(", ")], 5000):
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(run, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: which ids of which document lie where in which sequence."""
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a row for each length, so capacity rows at most
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = runs_of(pattern_list(total, capacity))
    # a length's window has a row for each task
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, ["length", "part"]).withColumn("number", F.col("first") + F.col("place"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            numbers, lengths = frame.number.to_numpy(), frame.length.to_numpy()
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                first, times, base, at = runs[size][np.searchsorted(runs[size][:, 0], numbers[own], side="right") - 1].T
                copy, row = np.divmod(numbers[own] - first, times)
                sequence[own], offset[own] = base + row, at + copy * size
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInPandas(run, PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
