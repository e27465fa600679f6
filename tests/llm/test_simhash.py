import re

import numpy as np
import xxhash

from twinweave.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: a list of (doc_id, fingerprint)."""
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for k, (doc_id, _) in zip(label, prints, strict=True):
        if doc_id is not None:
            least[k] = min(least.get(k, doc_id), doc_id)
    return [least.get(k) for k in label]


def test_query(spark, sf):
    rows = simhash.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = [(r.doc_id, brute_fingerprint(texts[r.doc_id])) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for _, p in prints]
    assert [r.component_id for r in rows] == brute_components(prints)


def test_odd_rows(spark, odd, docs):
    rows = simhash.classes(odd).collect()
    assert len(rows) == 6
    by = {(r.doc_id, r.fp) for r in rows}
    assert (1, 0) in by and (2, 0) in by
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.classes(docs([])).count() == 0
    assert simhash.deduplicate(docs([(5, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "x")])).count() == 2
    assert simhash.deduplicate(docs([(1, "a b c d e f"), (1, "x y z w v u")])).count() == 2
    assert simhash.deduplicate(odd).count() == 4 and simhash.deduplicate(odd).columns == odd.columns


def test_tries_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for v in base for _ in range(5)]
    tries = simhash.Tries(np.array(near, dtype=np.uint64))
    tries.join(3, size=64)
    roots = [tries.root(k) for k in range(len(tries.values))]
    want = brute_components(list(enumerate(map(int, tries.values))))
    assert roots == want


def test_tries_of_many_groups():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 64, 300, dtype=np.uint64)
    groups = rng.integers(0, 9, 300)
    tries = simhash.Tries(values, groups)
    tries.join(1)
    for g in range(9):
        own = np.flatnonzero(tries.groups == g)
        label = {k: tries.root(k) for k in own.tolist()}
        near = lambda a, b: int(tries.values[a] ^ tries.values[b]).bit_count() <= 1
        assert all(label[a] == label[b] for a in label for b in label if near(a, b))
        assert all(tries.groups[r] == g for r in label.values())


def test_lots_end_between_keys(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40).tolist()
    values = {v ^ (1 << int(b)) for v in base for b in rng.choice(62, 4)} | set(base)
    want = brute_components(sorted((v, v) for v in values))
    monkeypatch.setattr(simhash, "LOT_ROWS", 7)
    found = {r.node: r.component for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert [found.get(v, v) for v in sorted(values)] == want


def test_chunks_of_large_keys(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 1 << 62))
    values = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(simhash, "CHUNK", 40)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = simhash.components(edges).collect()
    assert len({r.component for r in found}) == 1 and len(found) == len(values)
