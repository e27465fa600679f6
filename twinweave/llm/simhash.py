"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint's bit is 1 if more than half of the text's shingle hashes have it. Fingerprints that differ
in at most BUDGET bits are linked; the components of the links are the classes.

The join: 64 bits are cut into BLOCKS blocks. Two fingerprints within a budget of 3 differ in at most 3
blocks, so they agree in at least two of five; each pair of blocks is a key, and all that can be linked
meets under some key. Under a key the fingerprints form a binary trie (their sorted order); pairs of
nodes are traversed together from the root, differing bits add up, and a pair is dropped once they exceed
the budget. A task traverses the tries of many keys at once. Only a spanning forest of the links found
under a key leaves it, never all pairs.

Exact copies are one node from the start. Keys with more than CHUNK fingerprints are dealt as pairs of
chunks to several tasks, so that no task holds a large group. Components are found by rounds of joins,
each written to the shared folder.

Defined cases: a null text is like an empty one (fingerprint zero, linked like any other); rows whose
doc_id is null get no component id of their own (the smallest id of their class, null if it has none);
repeated rows stay (deduplicate keeps one of rows that repeat an id and its text, and rows that share an
id but no class are documents of their own); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import fresh_names, lots, removed, table, written

BUDGET = 3
WIDTH = 3
SEED = 42
#: Widths of the blocks from the lowest bit on.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints under one key that one task joins.
CHUNK = 20_000
#: Rows of one task of the join, and those whose tries are traversed at once.
TASK_ROWS, LOT_ROWS = 150_000, 50_000


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of so many words; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def hashes_of(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in parts], dtype="<u8")


def node_of(hashes: np.ndarray) -> int:
    """A signed number for a sorted set of hashes."""
    digest = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, repeats included."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = WIDTH) -> int:
    return fingerprint_of(hashes_of(shingles(text, width)))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in lots(frames):
            bits = np.array([fingerprint(x, width) for x in frame.text], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "fp": bits.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Tries:
    """Sorted fingerprints, a trie for each group of them: a node is a run of a group that shares its upper bits."""

    def __init__(self, values: np.ndarray, groups: np.ndarray | None = None):
        groups = np.zeros(len(values), dtype=np.int64) if groups is None else groups
        order = np.lexsort((values, groups))
        values, groups = values[order], groups[order]
        first = np.r_[True, (values[1:] != values[:-1]) | (groups[1:] != groups[:-1])] if len(values) else np.array([], bool)
        self.values, self.groups = values[first], groups[first]
        self.parent = list(range(len(self.values)))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def join(self, budget: int, size: int = 1 << 16) -> None:
        """Links all values of a group within the budget; keeps no more node pairs at once than a depth-first stack of blocks."""
        if not len(self.values):
            return
        begin = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]])
        end = np.r_[begin[1:], len(self.values)]
        several = end - begin > 1
        stack = [(0, np.column_stack((begin, end, begin, end))[several])]
        while stack:
            depth, pairs = stack.pop()
            if len(pairs) > size:
                stack += [(depth, pairs[k : k + size]) for k in range(0, len(pairs), size)]
                continue
            alone = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
            if alone.any():  # what is left of both is compared at once
                a, b = pairs[alone, 0], pairs[alone, 2]
                near = (a != b) & (_popcount(self.values[a] ^ self.values[b]) <= budget)
                self.link(a[near], b[near])
                pairs = pairs[~alone]
            if not len(pairs) or depth == 64:
                continue
            split_a, split_b = (self._split(pairs[:, k], pairs[:, k + 1], depth) for k in (0, 2))
            same = pairs[:, 0] == pairs[:, 2]
            lower = np.column_stack((pairs[:, 0], split_a, pairs[:, 2], split_b))
            upper = np.column_stack((split_a, pairs[:, 1], split_b, pairs[:, 3]))
            cross = np.column_stack((pairs[:, 0], split_a, split_b, pairs[:, 3]))
            other = np.column_stack((split_a, pairs[:, 1], pairs[:, 2], split_b))[~same]
            children = np.concatenate((lower, upper, cross, other))
            full = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
            children = children[full]
            top = ~np.uint64(0) << np.uint64(63 - depth)
            apart = _popcount((self.values[children[:, 0]] ^ self.values[children[:, 2]]) & top)
            stack.append((depth + 1, children[apart <= budget]))

    def _split(self, first: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Where in each node the values with the next bit set begin."""
        bit = np.uint64(1) << np.uint64(63 - depth)
        low, high = first.copy(), end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            is_set = (self.values[np.minimum(middle, len(self.values) - 1)] & bit) != 0
            high = np.where(open_ & is_set, middle, high)
            low = np.where(open_ & ~is_set, middle + 1, low)
        return low

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(value, the smallest one of its tree) of all that have links, but for the smallest ones."""
        roots = np.array([self.root(k) for k in range(len(self.values))], dtype=np.int64)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return self.values[moved], self.values[roots[moved]]


def _join_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the fingerprints under each key; the rows of a key follow each other."""

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        begins = (frame[["key", "c1", "c2"]] != frame[["key", "c1", "c2"]].shift()).any(axis=1)
        tries = Tries(frame.fp.to_numpy(np.int64).view(np.uint64), begins.cumsum().to_numpy())
        tries.join(BUDGET)
        a, b = tries.forest()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < LOT_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        # the last key may go on
        last = rows[["key", "c1", "c2"]].iloc[-1]
        own = (rows[["key", "c1", "c2"]] == last).all(axis=1)
        yield joined(rows[~own])
        held = [rows[own]]
    if held:
        yield joined(pd.concat(held, ignore_index=True))


def _keyed(nodes: DataFrame) -> DataFrame:
    """A row for each fingerprint and pair of blocks."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [
        F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        for start, width in zip(starts, BLOCKS, strict=True)
    ]
    keys = [
        F.lit(n << 26).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(nodes: DataFrame) -> DataFrame:
    """Of distinct fingerprints: links (a, b) whose components are those of all links within the budget."""
    keyed = _keyed(nodes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    shared = sizes.filter(F.col("n") > 1).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    placed = keyed.join(shared, "key").withColumn("chunk", chunk)
    # a chunk meets each chunk of its key once: pair (smaller, larger)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = placed.select("fp", "key", "chunk", other.alias("other")).select(
        "fp", "key", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2")
    )
    keys = ["key", "c1", "c2"]
    tasks = max(1, -(-nodes.count() * len(list(combinations(BLOCKS, 2))) // TASK_ROWS))
    return paired.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(_join_keys, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes that have an edge.

    Rounds of two joins (Kiveris et al. 2014): each node links its larger neighbours to the smallest one
    it knows, then its smaller ones; both keep the number of edges, and end as stars.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        removed(last)
        # a digest of the edges that no order changes
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id) of each document."""
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = components(links(nodes.select("fp")))
    member = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = member.join(least, "component").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 bins a word whether it holds an odd number of the hashes: two sets differ in at least as many."""
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, odd_0, odd_1): node stands for the set of a text's shingles, n is the set's
    size, odd its parities."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in lots(frames):
            found = [hashes_of(shingles(x, width)) for x in frame.text]
            sets, bits = [np.unique(x) for x in found], np.array([fingerprint_of(x) for x in found], dtype=np.uint64)
            odd = np.array([parities(x, 2) for x in sets], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({
                "doc_id": frame.doc_id, "text_hash": frame.text_hash, "node": [node_of(x) for x in sets],
                "n": [len(x) for x in sets], "fp": bits.view(np.int64), "odd_0": odd[:, 0], "odd_1": odd[:, 1],
            })

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, node long, n int, fp long, odd_0 long, odd_1 long")


def deduplicate(docs: DataFrame, width: int = WIDTH, refine: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Of each class only the document with the smallest doc_id (of its repeated rows one); all columns stay.

    refine(docs, nodes, links) may check the links (pairs of nodes) and add further ones. Documents without a
    doc_id can't be named as anyone's copy; all of them stay.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    own = [F.first(c).alias(c) for c in ("n", "fp", "odd_0", "odd_1")]
    nodes = written(described(named, width).groupBy("node").agg(first, *own), "nodes")
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    found = links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}")) for x in "ab")
    near = found.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    equal = nodes.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges = near.unionByName(equal)
    label = components(refine(named, nodes, edges) if refine else edges).withColumnRenamed("component", "class")
    joined = nodes.join(label, "node", "left").groupBy(F.coalesce("class", "node")).agg(F.min("first").alias("kept"))
    names = fresh_names(docs, "id", "text_hash")
    kept = joined.select(F.col("kept.doc_id").alias(names["id"]), F.col("kept.text_hash").alias(names["text_hash"]))
    rows = named.withColumn(f"{names['text_hash']}_", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("doc_id") == F.col(names["id"])) & (F.col(f"{names['text_hash']}_") == F.col(names["text_hash"]))
    only = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", f"{names['text_hash']}_"]).select(*docs.columns)
    return only.unionByName(docs.filter(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
