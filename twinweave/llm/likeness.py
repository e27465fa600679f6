"""Exact check and completion of SimHash links, by the Jaccard likeness of word shingles.

A fingerprint of 64 bits tells copies with few edits from other texts, but texts that share 4/5 of their
shingles may differ in more bits than any budget that prunes. So for near copies the links that the tries
found are checked by the whole sets, and what isn't linked yet is completed here.

Texts are linked if their sets of WIDTH-word shingles have a Jaccard likeness of at least 4/5; the
components of the links are the classes. No pair is missed: sets of sizes m and n that are so alike share at
least 4 (m + n) / 9 shingles, so under any fixed order of all shingles both have their first common one among
the first n - ceil(4 n / 5) + 1 of their own. Those are the keys of an equality join; sizes and places bound
what a pair can still share, parities bound in how many shingles it differs, and what is left is counted.

Any order finds the same links; frequent shingles come last so that few sets meet under them. What is frequent
is told from a share of the texts, and at most HOT shingles are sent to the workers.

Texts with equal sets are one node from the start. A text shorter than WIDTH words is one shingle. Texts
without words (and null ones) have the empty set and are copies of each other.

Defined cases: a very long text is one set, held whole by the task that compares it; ties need no rule, since
links depend on the sets alone (which document of a class stays is deduplicate's rule); repeated rows are one
node; an empty table has no links; columns besides doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import lots, removed, shuffles_released, written
from twinweave.llm.simhash import components, deduplicate, hashes_of, node_of, parities, shingles

WIDTH = 5
#: The share of texts whose shingles are counted, one in so many.
SAMPLE = 8
#: Shingles that come last in the order: the most frequent ones, 1 MB for each worker.
HOT = 1 << 17
#: Pairs for each row of a key up to which all pairs are listed at once. A round costs a pass over the texts, a
#: pair under a key about a microsecond.
MANY = 50
#: The share of the pairs that a round must settle for another one to follow.
WORTH = 0.25
#: Hashes of the sets that are compared in one place (16 MB), and what a set counts beside its own.
LOT, NODE = 1 << 21, 1000
#: Words of 64 parities for each set.
PARITIES = 8
#: Bits that tell which texts are wanted (4 MB for each executor, whatever the input).
BITMAP = 1 << 25


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(hashes_of(shingles(text, WIDTH)))


def _read(docs: DataFrame, make: Callable[[list[int], list[np.ndarray], list[str]], pd.DataFrame], schema: str) -> DataFrame:
    """make(nodes, sets, texts): texts with equal sets have the same node, and a task makes each node once.

    Sets are larger than their texts, so they are made anew where they are needed instead of being stored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in lots(frames):
            nodes, sets, texts = [], [], []
            for text in frame.text:
                found = shingle_set(text)
                node = node_of(found)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found)
                    texts.append(text)
            if nodes:
                yield make(nodes, sets, texts)

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


def _hot(docs: DataFrame) -> np.ndarray:
    """Of the shingles that a sample of the texts shares the most frequent ones, at most HOT."""
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    found = _read(sample, lambda _, sets, texts: pd.DataFrame({"h": np.concatenate(sets).view(np.int64)}), "h long")
    shared = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    top = shared.orderBy(F.desc("n"), "h").limit(HOT).select("h").toPandas()
    return np.sort(top.h.to_numpy(np.int64).view(np.uint64))


def _among(x: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of x are in hot, which is sorted and much the larger one."""
    return hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x if len(hot) else np.zeros(len(x), dtype=bool)


def _keys(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, node, n, place): the first shingles of each set in the common order; a node may come from several tasks."""

    def make(nodes: list[int], sets: list[np.ndarray], texts: list[str]) -> pd.DataFrame:
        keys, taken = [], []
        for x in sets:
            late = _among(x, hot)
            taken.append(len(x) - -(-4 * len(x) // 5) + 1 if len(x) else 0)
            keys.append(np.concatenate((x[~late], x[late]))[: taken[-1]].view(np.int64))
        return pd.DataFrame({
            "key": np.concatenate(keys), "node": np.repeat(np.array(nodes, dtype=np.int64), taken),
            "n": np.repeat([len(x) for x in sets], taken), "place": np.concatenate([np.arange(k) for k in taken]),
        })

    return _read(docs, make, "key long, node long, n int, place int")


def _alike(common: Column, m: Column, n: Column) -> Column:
    """common / (m + n - common) >= 4/5, in whole numbers."""
    return 9 * common >= 4 * (m + n)


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keys])


def _possible(met: DataFrame) -> DataFrame:
    """Of pairs under a key those that can be alike, each once: (a, b, m, n) with a < b."""
    m, n = F.col("a_n"), F.col("b_n")
    near = met.filter(_alike(F.least(m - F.col("a_place"), n - F.col("b_place")), m, n))
    turned = F.col("a_node") > F.col("b_node")
    a, b = F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")
    return near.select(a, b, F.when(turned, n).otherwise(m).alias("m"), F.when(turned, m).otherwise(n).alias("n")).distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """The pairs (a, b, m, n) of different components under a key that can be alike by sizes, places and parities.

    placed: (key, comp, node, n, place, odd_0, odd_1). Components meet before their members do, if any two of
    them can be alike: low is their smallest n, reach the largest 5 n - 9 place, which 4 times the other's size
    must not pass. One of a single member has that member's parities.
    """
    alone = lambda c: F.when(F.count("*") == 1, F.min(c)).alias(c)
    reach = 5 * F.col("n") - 9 * F.col("place")
    rows = placed.withColumn("reach", reach)
    comps = rows.groupBy("key", "comp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"), alone("odd_0"), alone("odd_1")
    )

    def near(a: str, b: str, high_a: str, high_b: str) -> Column:
        """Parities of a and b, where both are known, differ in as many bins at most as sets of these sizes may."""
        bits = sum((F.bit_count(F.col(f"{a}_odd_{k}").bitwiseXOR(F.col(f"{b}_odd_{k}"))) for k in (0, 1)), F.lit(0))
        return F.coalesce(9 * bits <= F.col(high_a) + F.col(high_b), F.lit(True))

    def meet(low_a: str, reach_a: str, low_b: str, reach_b: str) -> Column:
        return (F.col(reach_a) >= 4 * F.col(low_b)) & (F.col(reach_b) >= 4 * F.col(low_a))

    of_c, of_d = _side(comps, "c", "key"), _side(comps, "d", "key")
    twos = of_c.join(of_d, "key").filter(F.col("c_comp") < F.col("d_comp"))
    twos = twos.filter(meet("c_low", "c_reach", "d_low", "d_reach") & near("c", "d", "c_high", "d_high")).drop("c_odd_0", "c_odd_1", "c_low", "c_reach", "c_high")
    one = _side(rows, "a", "key").withColumnRenamed("a_comp", "c_comp")
    half = twos.join(one, ["key", "c_comp"]).filter(meet("a_n", "a_reach", "d_low", "d_reach") & near("a", "d", "a_n", "d_high"))
    half = half.select("key", "d_comp", "a_node", "a_n", "a_place", "a_odd_0", "a_odd_1")
    other = _side(rows, "b", "key").withColumnRenamed("b_comp", "d_comp")
    return _possible(half.join(other, ["key", "d_comp"]).filter(near("a", "b", "a_n", "b_n")))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A forest of those pairs (a, b) that are alike, for each task's pairs. sets: (node, n, text).

    Pairs that hang together are compared in one place, so that a set is sent once and not with each of its
    pairs; what is heavier than LOT is cut into chunks that meet in twos, and a set goes where it has a pair.
    What is sent is the text, about half its set's size; the set is made where it is compared.
    """
    label = written(components(pairs), "labels")
    weights = sets.select("node", (F.col("n") + NODE).cast("long").alias("w")).join(label, "node")
    heavy = weights.groupBy("component").agg(F.ceil(F.sum("w") / LOT).cast("int").alias("chunks")).filter("chunks > 1")
    places = max(1, -(-(weights.agg(F.sum("w")).first()[0] or 0) // LOT))
    own = pairs.join(label, pairs.a == label.node).join(heavy, "component", "left")
    chunk_a, chunk_b = (F.coalesce(F.pmod(F.xxhash64(c), F.col("chunks")).cast("int"), F.lit(0)) for c in "ab")
    home = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("component"), F.lit(places))).otherwise(F.col("component"))
    keys = ["home", "c1", "c2"]
    dealt = written(own.select("a", "b", home.alias("home"), F.least(chunk_a, chunk_b).alias("c1"), F.greatest(chunk_a, chunk_b).alias("c2")), "dealt")
    places_of = [F.col(c).alias(f"to_{c}") for c in keys]
    sent = dealt.select(*places_of, F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "text"), "node")

    def compare(found: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hashes, parent, out = {k: shingle_set(x) for k, x in zip(held.node, held.text, strict=True)}, {}, []

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for a, b in zip(found.a.tolist(), found.b.tolist(), strict=True):
            if (x := root(a)) == (y := root(b)):
                continue
            m, n = hashes[a], hashes[b]
            if 9 * len(np.intersect1d(m, n, assume_unique=True)) >= 4 * (len(m) + len(n)):
                parent[x] = y
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    found = written(dealt.groupBy(*keys).cogroup(sent.groupBy(*[f"to_{c}" for c in keys])).applyInPandas(compare, "a long, b long"), "alike")
    removed(label, dealt)
    return found


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of the texts whose hash has its bit set by ids: all that ids names and few others.

    Nothing is moved but the bits. Their number is fixed: the more ids there are, the more other texts pass.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    place = F.pmod("text_hash", F.lit(BITMAP)) + 1  # the functions for bitmaps count from 1
    at = F.bitmap_bit_position(place)
    bits = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = own.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("bucket"))
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select("doc_id", "text_hash", "text")


def _counted(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) a forest of those that are alike by their whole sets, written."""

    def make(found: list[int], sets: list[np.ndarray], texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"node": found, "odd": [parities(x, PARITIES) for x in sets], "n": [len(x) for x in sets], "text": texts})

    pairs = written(pairs, "pairs")
    shuffles_released(docs.sparkSession)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = written(nodes.join(ends, "node", "left_semi").select("first.*"), "ids")
    # repeated rows go before their sets are made: the join has brought them together. It is an inner one (ids are
    # distinct), since Spark does a left semi join first, which would move all texts
    texts = _likely(docs, ids).join(ids, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    few = written(_read(texts, make, "node long, odd array<long>, n int, text string"), "ends")
    shuffles_released(docs.sparkSession)
    of = lambda side, c: few.select(F.col("node").alias(side), F.col(c).alias(f"{side}_{c}"))
    apart = F.lit(0)
    for k in range(PARITIES):
        apart = apart + F.bit_count(F.col("a_odd")[k].bitwiseXOR(F.col("b_odd")[k]))
    near = pairs.join(of("a", "odd"), "a").join(of("b", "odd"), "b").filter(9 * apart <= F.col("m") + F.col("n"))
    near = written(near.select("a", "b"), "near")
    found = _compared(near, few.select("node", "n", "text"))
    removed(near)
    removed(pairs, few, ids)
    shuffles_released(docs.sparkSession)
    return found


def links(docs: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes that are alike.

    nodes: (node, n, first), first being one of its documents (doc_id, text_hash). found: pairs that may be alike.
    Pairs of nodes already in one component needn't be looked at. While many pairs are left, one node of each
    key is compared with the key's others, which joins large classes by as many pairs as they have members; what such
    rounds can't settle are pairs that aren't alike.
    """
    sizes = nodes.select("node", "n")
    a, b = (sizes.select(F.col("node").alias(x), F.col("n").alias(y)) for x, y in (("a", "m"), ("b", "n")))
    edges = _counted(docs, nodes, found.join(a, "a").join(b, "b").select("a", "b", "m", "n"))
    own = Window.partitionBy("key")
    keys = _keys(docs, _hot(docs)).withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own))
    met = written(keys.filter("low < high").drop("low", "high").dropDuplicates(["key", "node"]), "met")
    shuffles_released(docs.sparkSession)

    def labelled() -> DataFrame:
        """The rows of the keys whose nodes aren't all in one component, with their component."""
        label = components(edges).withColumnRenamed("component", "comp")
        rows = met.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = rows.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("key")
        return written(rows.join(several, "key", "left_semi"), "placed")

    placed, rounds, before = labelled(), 0, None
    while True:
        parts = placed.groupBy("key", "comp").agg(F.count("*").cast("double").alias("k"))
        sizes = parts.groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        state = sizes.agg(F.sum("s").alias("rows"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("rest")).first()
        rest = state.rest or 0
        if rest <= MANY * (state.rows or 0) or (before is not None and rest > (1 - WORTH) * before):
            break
        before = rest
        hub = F.min_by(F.struct("node", "n", "place", "comp"), F.xxhash64("node", F.lit(rounds))).alias("hub")
        hubs = placed.groupBy("key").agg(hub).select("key", "hub.*")
        one = _side(hubs, "a", "key").join(_side(placed, "b", "key"), "key").filter("a_comp <> b_comp")
        more = _counted(docs, nodes, _possible(one))
        rounds, edges, last = rounds + 1, edges.unionByName(more), placed
        placed = labelled()
        removed(last)
        shuffles_released(docs.sparkSession)
    removed(met)
    rest = _counted(docs, nodes, _apart(placed.join(nodes.select("node", "odd_0", "odd_1"), "node")))
    removed(placed)
    return edges.unionByName(rest)


def near_copies_removed(docs: DataFrame) -> DataFrame:
    """SimHash near-dedup with exact links: one document of each class of near copies, as simhash.deduplicate says."""
    return deduplicate(docs, WIDTH, links)
