import numpy as np

import corpus_pipeline as P
from pyspark.sql import functions as F

from twinweave.llm import likeness, simhash


def brute_kept(rows):
    """The smallest doc_id of each class, by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            whole = len(sets[a] | sets[b])
            if label[a] != label[b] and (not whole or 5 * len(sets[a] & sets[b]) >= 4 * whole):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return sorted({min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in label})


def edited(rng, words, changes):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def family(rng, copies, most):
    words = [f"w{k}" for k in rng.integers(0, 1 << 30, 200)]
    return [edited(rng, words, int(rng.integers(0, most + 1))) for _ in range(copies)]


def test_all_near_copies_go(spark, docs):
    rng = np.random.default_rng(5)
    texts = [x for _ in range(12) for x in family(rng, 5, 9)] + ["", None, "a b", "A  b", "one two three four five", "c"]
    rows = list(enumerate(texts))
    kept = P.drop_near_copies(spark, docs(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)


def test_large_classes_by_hubs(docs, monkeypatch):
    rng = np.random.default_rng(6)
    line = " ".join(f"common{k}" for k in range(60))
    texts = [f"{line} {x}" for _ in range(3) for x in family(rng, 40, 8)]
    rows = list(enumerate(texts))
    seen = []
    monkeypatch.setattr(likeness, "_counted", lambda *a, f=likeness._counted: seen.append(1) or f(*a))
    monkeypatch.setattr(likeness, "MANY", 0)
    kept = likeness.near_copies_removed(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows) and len(seen) > 1


def test_links_beyond_the_fingerprint_s_budget_and_unchecked_ones(docs, monkeypatch):
    rng = np.random.default_rng(7)
    rows = list(enumerate(x for _ in range(10) for x in family(rng, 4, 8)))
    monkeypatch.setattr(simhash, "links", lambda nodes: nodes.alias("x").join(nodes.alias("y"), F.col("x.fp") < F.col("y.fp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    assert sorted(r.doc_id for r in likeness.near_copies_removed(docs(rows)).collect()) == brute_kept(rows)
    monkeypatch.setattr(simhash, "links", lambda nodes: nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    assert sorted(r.doc_id for r in likeness.near_copies_removed(docs(rows)).collect()) == brute_kept(rows)


def test_odd_rows(odd, docs):
    assert likeness.near_copies_removed(docs([])).count() == 0
    assert likeness.near_copies_removed(docs([(5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "x")])).count() == 2
    assert likeness.near_copies_removed(docs([(1, "a b c d e f"), (1, "x y z w v u"), (2, "x y z w v u")])).count() == 2
    assert likeness.near_copies_removed(odd).count() == 4 and likeness.near_copies_removed(odd).columns == odd.columns


def test_only_wanted_texts_are_moved(docs, monkeypatch):
    rows = [(k, None if k == 7 else f"text {k}") for k in range(3000)] + [(7, None), (9, "text 9")]
    own = docs(rows).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    wanted = own.filter("doc_id % 100 IN (7, 9)").distinct()
    ids = {r.doc_id for r in wanted.collect()}
    found = [r.doc_id for r in likeness._likely(docs(rows), wanted).collect()]
    assert ids <= set(found) and found.count(9) == 2 and len(found) < len(ids) + 10
    monkeypatch.setattr(likeness, "BITMAP", 8)  # so few bits let all pass
    assert len(likeness._likely(docs(rows), wanted).collect()) == len(rows)
    assert likeness._likely(docs(rows), wanted.limit(0)).count() == 0


def test_frequent_shingles_are_found():
    rng = np.random.default_rng(8)
    hot = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    for part in (hot, hot[:1], hot[:0]):
        x = np.unique(np.concatenate((hot[::7], rng.integers(0, 1 << 63, 50).astype(np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64))))
        assert (likeness._among(x, part) == np.isin(x, part)).all()
    assert not len(likeness._among(hot[:0], hot))


def test_pairs_that_cannot_be_alike_are_not_listed(spark):
    """All alike pairs of different components under a key are listed, and few of the others."""
    rng = np.random.default_rng(9)
    texts = [x for _ in range(8) for x in family(rng, 12, 60)] + [" ".join(f"w{k}" for k in rng.integers(0, 1 << 30, size)) for size in rng.integers(20, 300, 100)]
    sets = [likeness.shingle_set(x) for x in texts]
    odd = [simhash.parities(x, 2).tolist() for x in sets]
    comp = [k - k % 3 if k < 48 else k for k in range(len(sets))]
    rows = [(7, comp[k], k, len(x), k % 2, *odd[k]) for k, x in enumerate(sets)]
    placed = spark.createDataFrame(rows, "key long, comp long, node long, n int, place int, odd_0 long, odd_1 long")
    found = {(r.a, r.b) for r in likeness._apart(placed).select("a", "b").collect()}
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if comp[a] != comp[b]]
    alike = {(a, b) for a, b in pairs if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert alike and alike <= found and len(found) < len(pairs) / 4


def test_texts_that_are_not_wanted_are_not_moved_before_they_are_left_out(spark, docs, monkeypatch):
    """No text is shuffled below the bitmaps' join, whatever the size of the other side."""
    rng = np.random.default_rng(10)
    before, plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    monkeypatch.setattr(likeness, "_read", lambda frame, *a, f=likeness._read: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or f(frame, *a))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert likeness.near_copies_removed(docs(list(enumerate(family(rng, 4, 2))))).count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own = [x for x in plans if "bitmap" in x.lower()]
    assert own and not any("LeftSemi" in x.split("strategy=broadcast")[-1] for x in own)
