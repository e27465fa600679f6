"""Ranked lexical search: exact inner products by ball trees over sparse documents.

A document is a vector over terms, its value weight times saturated term count in whole numbers; an item is
its terms' counts; the score is their inner product. Documents are read once into (length, counts of
the items' terms), which the corpus counts are taken from, and no text is moved.

Then each task builds ball trees over blocks of what it reads: a node has the centroid of its documents and the
greatest distance from it, its radius. By Cauchy and Schwarz no document of a node scores more than
<item, centroid> + |item| radius. Sums of doubles are off by less than the SLACK that bounds get on top, so a node
whose bound is below the item's k-th best score holds no result. Nodes are opened best first; at leaves
scores are computed in 64-bit integers. The k best so far go on from block to block, and each task
returns at most k rows an item; the k best of those are taken in two steps.

Items are taken in slices of at most SLICE_TERMS distinct terms, each a job of its own, and within a block in
lots of at most LOT_TERMS, so that neither a worker's table nor a tree's centroids grow with the number of items.

Defined cases: a null text has no terms; an item without terms, or whose terms are in no document, has no rows; rows
that repeat an item's id and text are one item, different texts under one id are items of their own; repeated
documents are ranked each; equal scores go by doc_id, null last; an empty table gives no rows; a very long text is one
document, an item longer than a slice is a slice of its own; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinweave.llm.common import lots, table, written

BEST = 10
#: Distinct terms of items that a worker looks for in one pass, and those of one tree: the fewer, the smaller its radii.
SLICE_TERMS, LOT_TERMS = 200_000, 128
#: Documents and values of one tree; documents of a leaf; numbers that a tree's centroids may have.
BLOCK_ROWS, BLOCK_VALUES, LEAF, CENTROIDS = 8192, 2_000_000, 96, 4_000_000
#: Share of a sum of squares that rounding may lose: sums of a million doubles are off by 2e-10 of it at most.
SLACK = 1e-9
#: Groups into which an item's rows of all tasks are dealt before the last step.
SPREAD = 64

#: Letters and digits stay, capitals are lowered, other ASCII separates; bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def weight(n_docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having + 1)))


def lengths_measure(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L of each document."""
    if 75 * n_docs * int(n.max(initial=0)) >= 1 << 63:
        return np.array([25 + 75 * x * n_docs // all_terms for x in n.tolist()], dtype=np.int64)
    return 25 + 75 * n_docs * n // all_terms


def _entries(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these rows where their entries are, one row after the other, and where each row's begin there."""
    sizes = starts[rows + 1] - starts[rows]
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts[rows] - first, sizes) + np.arange(sizes.sum()), first


class Tree:
    """A ball tree over sparse rows, none of them empty, in numbers that doubles hold exactly."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        self.starts, self.columns, self.values = starts, columns, values
        rows = len(starts) - 1
        leaf = max(leaf, -(-2 * rows * width // CENTROIDS))
        real = values.astype(np.float64)
        squares = np.add.reduceat(real * real, starts[:-1]) if rows else np.zeros(0)
        by_row = np.lexsort((-real, np.repeat(np.arange(rows), np.diff(starts))))
        heaviest = columns[by_row[starts[:-1]]]
        self.leaves: dict[int, np.ndarray] = {}
        self.children: dict[int, tuple[int, int]] = {}
        centroids, radii = [], []
        todo = [(np.arange(rows), -1)] if rows else []
        while todo:
            own, parent = todo.pop()
            at, first = _entries(starts, own)
            cols, vals = columns[at], real[at]
            centroid = np.bincount(cols, vals, width) / len(own)
            own_squares, middle = squares[own], centroid @ centroid
            apart = own_squares - 2 * np.add.reduceat(vals * centroid[cols], first) + middle
            node = len(radii)
            centroids.append(centroid)
            radii.append(math.sqrt(max(0.0, apart.max()) + SLACK * (own_squares.max() + middle)))
            if parent >= 0:
                self.children[parent] += (node,)
            if len(own) <= leaf:
                self.leaves[node] = own
                continue
            # towards the row farthest from the centroid, away from the one farthest from that
            pole = self._dense(own[apart.argmax()], width)
            to_pole = np.add.reduceat(vals * pole[cols], first)
            other = self._dense(own[(own_squares - 2 * to_pole).argmax()], width)
            side = 2 * np.add.reduceat(vals * (pole - other)[cols], first) - (pole @ pole - other @ other)
            near, few = side > 0, max(1, len(own) // 16)
            if not few <= near.sum() <= len(own) - few:
                # most rows are as far from both: rows with one heaviest column stay together
                near = np.zeros(len(own), dtype=bool)
                near[np.argsort(heaviest[own], kind="stable")[len(own) // 2 :]] = True
            self.children[node] = ()
            todo += [(own[near], node), (own[~near], node)]
        self.centroids = np.array(centroids).reshape(-1, width)
        self.radii = np.array(radii)

    def _dense(self, row: int, width: int) -> np.ndarray:
        part = slice(self.starts[row], self.starts[row + 1])
        out = np.zeros(width)
        out[self.columns[part]] = self.values[part]
        return out

    def bounds(self, columns: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What no row of each node exceeds."""
        length = math.sqrt(float(times @ times))
        return (self.centroids[:, columns] @ times.astype(np.float64) + length * self.radii) * (1 + SLACK) + 1

    def scores(self, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact inner products with a dense vector of integers."""
        at, first = _entries(self.starts, rows)
        return np.add.reduceat(self.values[at] * item[self.columns[at]], first)


class Best:
    """The k best (score, smaller doc_id first) seen so far; looked counts the rows that were scored."""

    def __init__(self, k: int):
        self.k, self.heap, self.looked = k, [], 0

    def least(self) -> int:
        """What a score must reach to be of use."""
        return max(1, self.heap[0][0]) if len(self.heap) == self.k else 1

    def add(self, score: int, none: bool, doc_id: int) -> None:
        row = (score, not none, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)

    def search(self, tree: Tree, columns: np.ndarray, times: np.ndarray, item: np.ndarray, none: np.ndarray, doc_ids: np.ndarray) -> None:
        """item: the same as columns and times, dense."""
        if not len(tree.radii):
            return
        bound = tree.bounds(columns, times)
        open_ = [(-bound[0], 0)]
        while open_:
            most, node = heapq.heappop(open_)
            if -most < self.least():
                break
            if node in tree.children:
                for child in tree.children[node]:
                    heapq.heappush(open_, (-bound[child], child))
                continue
            rows = tree.leaves[node]
            self.looked += len(rows)
            scores = tree.scores(rows, item)
            for k in np.flatnonzero(scores >= self.least()).tolist():
                self.add(int(scores[k]), bool(none[rows[k]]), int(doc_ids[rows[k]]))


def counted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, no_id, n, terms, times) of each document with terms: its length, which known terms it has, how often."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in lots(frames):
            n, terms, times = [], [], []
            for text in frame.text:
                words = terms_of(text)
                own = Counter([known[w] for w in words if w in known])
                n.append(len(words))
                terms.append(np.fromiter(own, np.int32, len(own)))
                times.append(np.fromiter(own.values(), np.int64, len(own)))
            yield pd.DataFrame({"doc_id": frame.doc_id, "no_id": frame.no_id, "n": n, "terms": terms, "times": times})

    rows = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text"
    )
    found = rows.mapInPandas(run, "doc_id long, no_id boolean, n long, terms array<int>, times array<long>")
    return found.filter("n > 0")


def _lots_of(items: list[dict[int, int]]) -> list[tuple[list[int], np.ndarray]]:
    """(items, their distinct terms in order), of at most LOT_TERMS terms unless a single item has more."""
    out, own, terms = [], [], set()
    for k, item in enumerate(items):
        if own and len(terms.union(item)) > LOT_TERMS:
            out.append((own, np.array(sorted(terms))))
            own, terms = [], set()
        own.append(k)
        terms |= item.keys()
    return [*out, (own, np.array(sorted(terms)))] if own else out


def searched(found: DataFrame, items: list[dict[int, int]], weights: np.ndarray, n_docs: int, all_terms: int, best: int = BEST) -> DataFrame:
    """(item, part, doc_id, score): each task's best documents for each item."""
    grouped = [
        (own, terms, [(np.searchsorted(terms, list(items[k])), np.array(list(items[k].values()))) for k in own])
        for own, terms in _lots_of(items)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(best) for _ in items]

        def search(block: pa.Table) -> None:
            column = {name: block.column(name).combine_chunks() for name in block.column_names}
            doc_ids, none, n = (column[x].to_numpy(zero_copy_only=False) for x in ("doc_id", "no_id", "n"))
            sizes = np.diff(column["terms"].offsets.to_numpy())
            terms, times = (column[x].flatten().to_numpy().astype(np.int64) for x in ("terms", "times"))
            row = np.repeat(np.arange(len(n)), sizes)
            measure = lengths_measure(n, n_docs, all_terms)[row]
            values = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * measure))
            for own, lot, parts in grouped:
                place = np.searchsorted(lot, terms)
                held = (lot[np.minimum(place, len(lot) - 1)] == terms) & (values > 0)
                rows, first = np.unique(row[held], return_index=True)
                tree = Tree(np.r_[first, held.sum()], place[held], values[held], len(lot), LEAF)
                dense = np.zeros(len(lot), dtype=np.int64)
                for k, (columns, counts) in zip(own, parts, strict=True):
                    dense[columns] = counts
                    bests[k].search(tree, columns, counts, dense, none[rows], doc_ids[rows])
                    dense[columns] = 0

        held, rows, values = [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                held.append(part)
                rows, values = rows + part.num_rows, values + len(part.column("terms").flatten())
                if rows >= BLOCK_ROWS or values >= BLOCK_VALUES:
                    search(pa.Table.from_batches(held))
                    held, rows, values = [], 0, 0
        if held:
            search(pa.Table.from_batches(held))
        part = TaskContext.get().partitionId()
        out = [(k, part, -doc_id if has else None, score) for k, own in enumerate(bests) for score, has, doc_id in own.heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "part", "doc_id", "score"])

    return found.filter(F.size("terms") > 0).mapInArrow(run, "item int, part int, doc_id long, score long")


def _slices(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items (id, terms) in slices; the driver holds one at a time."""
    own, terms = [], set()
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        counts = Counter(terms_of(row.text or ""))
        if own and len(terms.union(counts)) > SLICE_TERMS:
            yield own
            own, terms = [], set()
        if counts:
            own.append((row.item_id, counts))
            terms |= counts.keys()
    if own:
        yield own


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for own in _slices(items):
        known = {term: k for k, term in enumerate(sorted(set().union(*(counts for _, counts in own))))}
        found = written(counted(docs, known), "term_counts")
        n_docs, all_terms = found.agg(F.count("*"), F.sum("n")).first()
        # a row for each of the slice's terms at most
        having = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
        weights = np.zeros(len(known), dtype=np.int64)
        for r in having:
            weights[r.term] = weight(n_docs, r.n)
        sparse = [{known[t]: n for t, n in counts.items()} for _, counts in own]
        rows = searched(found, sparse, weights, n_docs, all_terms or 1, best)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        dealt = rows.withColumn("part", F.pmod("part", F.lit(SPREAD)))
        few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= best)
        last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
        # a row for each item of the slice
        names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(own)], f"item int, item_id {id_type}")
        out = out.unionByName(last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SPLIT} AS terms FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d WHERE len(terms) > 0),
item AS (SELECT row_number() OVER () AS item, item_id, {_SPLIT} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
has AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) SEMI JOIN wanted USING (term) GROUP BY ALL),
weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM has, total GROUP BY term),
scored AS (
  SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms)))) AS BIGINT) AS score
  FROM wanted JOIN has USING (term) JOIN weighted USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {BEST}
"""
