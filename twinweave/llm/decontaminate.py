"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Both sides are folded: lower case, letters and digits kept, any run of other characters one space. Each
benchmark item is cut into overlapping segments of SEGMENT characters (a shorter item is one). A segment
that occurs within k edits (a tenth of its length) shares at least m + 1 - q - k * q of its q-grams with
the document, all on diagonals at most k apart. So shared q-grams are counted in bands of 2 (k + 1)
diagonals that overlap by half; bands that reach the bound are kept and verified by an alignment that
stays within the band. Up to SKIPPED of a segment's most frequent q-grams are left out and its bound is
lowered by as many, which loses nothing. A passage of SEGMENT + STRIDE - 1 characters of an item always
holds a whole segment.

Items with fewer than SHORT folded characters are looked for as whole words without any edit: such an
item is one q-gram of its own length.

The index goes to the tasks with their code. It holds at most SLICE_CHARS of the benchmark; a larger one
is searched in slices, one after the other, each over all documents, whose matches so far are written to
the shared folder in between. So the driver and each task hold one slice at a time.

Defined cases: null texts are empty; items without a letter or digit are never found; items with a null id
count as id -1; documents without a match have an empty list; repeated rows are searched each; an empty
benchmark finds nothing; empty documents give no rows; other columns stay, a column named leaks is replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import fresh_names, removed, table, written

Q = 8
SEGMENT, STRIDE = 64, 8
EDITS = 0.1
SHORT = 24
SKIPPED = 4
#: Folded characters of benchmark in one index, which takes some 150 bytes for each.
SLICE_CHARS = 500_000
#: Characters of documents searched at once, which takes some 120 bytes for each in several arrays of numbers.
LOT_CHARS = 125_000

#: Stands between texts that are searched together, as a letter that no text has.
_NONE = chr(0x10FFFF)
_GAP = _NONE * 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPAN = "item_id long, start long, end long, edits int"


@cache
def _folding() -> np.ndarray:
    """For each code point its folded one, a space for what is no letter or digit."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for point in range(len(out)):
        char = chr(point)
        if char.isalnum():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    out[ord(_NONE)] = ord(_NONE)
    return out


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and where in the text each was."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = _folding()[points]
    kept = low != 32
    kept[1:] |= low[:-1] != 32
    at = np.flatnonzero(kept)
    return low[at].astype(np.uint64), at


def trimmed(text: str) -> np.ndarray:
    codes, _ = folded(text)
    return codes[: len(codes) - 1] if len(codes) and codes[-1] == 32 else codes


def runs_of(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n code points."""
    out = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + codes[k : k + len(out)] + np.uint64(1)
    return out


def grams(codes: np.ndarray) -> np.ndarray:
    """A number for each run of Q code points, as runs_of gives it."""
    runs, power, length = codes + np.uint64(1), _BASE, 1
    while length < Q:
        runs = runs[:-length] * power + runs[length:]
        with np.errstate(over="ignore"):
            power, length = power * power, 2 * length
    return runs


class Index:
    """Segments of benchmark items and the q-grams they consist of."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[int] = []
        self.short: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        codes: list[np.ndarray] = []
        for item_id, text in items:
            whole = trimmed(text.replace(_NONE, " "))
            if len(whole) < SHORT:
                if len(whole):
                    self.short.setdefault(len(whole), []).append((int(runs_of(whole, len(whole))[0]), item_id, whole))
                continue
            last = max(0, len(whole) - SEGMENT)
            for start in sorted({*range(0, last, STRIDE), last}):
                self.items.append(item_id)
                codes.append(whole[start : start + SEGMENT])
        self.lengths = np.array([len(x) for x in codes], dtype=np.int64)
        self.edits = np.maximum(0, np.minimum((self.lengths * EDITS).astype(np.int64), (self.lengths - Q) // Q))
        self.codes = np.zeros((len(codes), SEGMENT), dtype=np.uint64)
        for k, x in enumerate(codes):
            self.codes[k, : len(x)] = x
        self.bounds = self.lengths + 1 - Q - self.edits * Q
        own = [grams(x) for x in codes]
        often = Counter(g for x in own for g in x.tolist())
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, x in enumerate(own):
            listed = x.tolist()
            spare = int(min(SKIPPED, self.bounds[k] - 1))
            common = sorted((j for j in range(len(listed)) if often[listed[j]] > 16), key=lambda j: -often[listed[j]])
            skipped = set(common[: max(0, spare)])
            self.bounds[k] -= len(skipped)
            for j, g in enumerate(listed):
                if j not in skipped:
                    where[g].append((k, j))
        keys = sorted(where)
        self.keys = np.array(keys, dtype=np.uint64)
        self.first = np.cumsum([0] + [len(where[g]) for g in keys]).astype(np.int64)
        postings = np.array([p for g in keys for p in where[g]], dtype=np.int64).reshape(-1, 2)
        self.segment, self.place = postings[:, 0].astype(np.int32), postings[:, 1].astype(np.int16)
        self.shift = np.uint64(64 - min(27, max(16, math.ceil(math.log2(32 * len(keys) + 1)))))
        self.seen = np.zeros(1 << int(64 - int(self.shift)), dtype=bool)
        self.seen[self._place(self.keys)] = True

    def _place(self, values: np.ndarray) -> np.ndarray:
        return (values * _BASE) >> self.shift

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, first diagonal of the band) of all bands that reach the bound."""
        none = np.array([], dtype=np.int64)
        if len(codes) < Q or not len(self.keys):
            return none, none
        values = grams(codes)
        at = np.flatnonzero(self.seen[self._place(values)])
        slot = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[slot] == values[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return none, none
        many = self.first[slot + 1] - self.first[slot]
        run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        posting = np.repeat(self.first[slot], many) + run
        segment = self.segment[posting].astype(np.int64)
        width = self.edits[segment] + 1
        # diagonals are counted from SEGMENT on, so that none is negative
        band = (np.repeat(at, many) - self.place[posting] + SEGMENT) // width
        span = len(codes) + 2 * SEGMENT
        # a q-gram that is in band b counts for the two bands that overlap it
        keys, counts = np.unique(np.concatenate((segment * span + band, segment * span + band - 1)), return_counts=True)
        segment = keys // span
        enough = counts >= self.bounds[segment]
        segment, band = segment[enough], (keys % span)[enough]
        return segment, band * (self.edits[segment] + 1) - SEGMENT

    def aligned(self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of the best occurrence of each segment within its band."""
        most = int(self.edits.max(initial=0))
        # the band's 2 (k + 1) diagonals, and k more on either side
        width = 4 * most + 3
        start = diagonal - self.edits[segment]
        padded = np.concatenate((np.zeros(2 * SEGMENT + most, np.uint64), codes, np.zeros(2 * SEGMENT + width, np.uint64)))
        shift = 2 * SEGMENT + most
        lanes = np.arange(width)
        steps = lanes.astype(np.int64)
        score = np.zeros((len(segment), width), dtype=np.int64)  # row 0: free start
        lengths = self.lengths[segment]
        best, end = np.full(len(segment), 10**6), np.zeros(len(segment), dtype=np.int64)
        for row in range(SEGMENT):
            # lane l of row r stands for the text at start + l + r
            text = padded[(start + shift + row)[:, None] + lanes]
            other = (text != self.codes[segment, row][:, None]).astype(np.int64)
            now = score + other
            now[:, :-1] = np.minimum(now[:, :-1], score[:, 1:] + 1)
            now = np.minimum.accumulate(now - steps, axis=1) + steps
            score = now
            ending = lengths == row + 1
            if ending.any():
                found = score[ending]
                lane = found.argmin(axis=1)
                best[ending] = found[np.arange(len(lane)), lane]
                end[ending] = start[ending] + row + lane + 1
        return best, end

    def _words(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first, end, 0) of the short items that stand in the codes as whole words."""
        out = []
        edge = np.r_[True, (codes == 32) | (codes == ord(_NONE)), True]
        for n, items in self.short.items():
            values = runs_of(codes, n)
            wanted = np.array([x[0] for x in items], dtype=np.uint64)
            at = np.flatnonzero(np.isin(values, wanted))
            for k in at.tolist():
                if edge[k] and edge[k + n + 1]:
                    out += [(item, k, k + n, 0) for _, item, whole in items if np.array_equal(codes[k : k + n], whole)]
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Of each text (item, start, end, edits): where in the text segments of the item occur, joined if they touch."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        lot: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            lot.append(k)
            size += len(text)
            if size >= LOT_CHARS or k == len(texts) - 1:
                self._search(texts, lot, out)
                lot, size = [], 0
        return out

    def _search(self, texts: list[str], lot: list[int], out: list[list[tuple[int, int, int, int]]]) -> None:
        joined = _GAP.join(texts[k].replace(_NONE, " ") for k in lot)
        codes, origin = folded(joined)
        found = self._words(codes)
        segment, diagonal = self.regions(codes)
        for k in range(0, len(segment), 2000):
            own = segment[k : k + 2000]
            edits, end = self.aligned(codes, own, diagonal[k : k + 2000])
            good = edits <= self.edits[own]
            for s, stop, wrong in zip(own[good].tolist(), end[good].tolist(), edits[good].tolist(), strict=True):
                found.append((self.items[s], max(0, stop - int(self.lengths[s])), stop, wrong))
        begins = np.cumsum([0] + [len(texts[k]) + len(_GAP) for k in lot])
        spans: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for item, first, stop, wrong in found:
            last = min(max(stop, 1), len(origin)) - 1
            a, b = int(origin[first]), int(origin[last]) + 1
            doc = int(np.searchsorted(begins, b - 1, side="right")) - 1
            base, size = int(begins[doc]), len(texts[lot[doc]])
            spans[doc, item].append((max(0, a - base), min(size, b - base), wrong))
        for (doc, item), found in sorted(spans.items()):
            merged: list[tuple[int, int, int]] = []
            for a, b, wrong in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(wrong, merged[-1][2]))
                else:
                    merged.append((a, b, wrong))
            out[lot[doc]] += [(item, *x) for x in merged]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each slice of the benchmark; one slice at a time is on the driver."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    slices = max(1, -(-chars // SLICE_CHARS))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    for k in range(slices):
        yield Index([(r.item_id, r.text) for r in items.filter(place == k).distinct().sort("item_id", "text").collect()])


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs and leaks, a list of (item_id, start, end, edits) in code points of the text."""
    found, before = docs.withColumn("leaks", F.array().cast(f"array<struct<{_LEAK}>>")), None
    for k, index in enumerate(indexes(benchmark)):
        if k:  # a further slice: what the ones before found is written
            now = written(found, "leaks")
            if before is not None:
                removed(before)
            found = before = now
        found = found.withColumn("leaks", F.concat("leaks", _leaks(index)(F.coalesce("text", F.lit("")))))
    return found


_LEAK = SPAN.replace(" ", ":").replace(",:", ",")


def _leaks(index: Index) -> Callable[[Column], Column]:
    @F.pandas_udf(f"array<struct<{_LEAK}>>")
    def leaks(texts: pd.Series) -> pd.Series:
        names = [x.split()[0] for x in SPAN.split(", ")]
        found = index.search(texts.tolist())
        return pd.Series([[dict(zip(names, x, strict=True)) for x in own] for own in found])

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their own columns."""
    own = fresh_names(docs, "own")["own"]
    found = searched(docs.select(F.struct(*docs.columns).alias(own), "text"), benchmark)
    return found.filter(F.size("leaks") == 0).select(f"{own}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = searched(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("leaks.item_id"))).alias("item_ids"),
        F.col("leaks").alias("spans"),
    )
