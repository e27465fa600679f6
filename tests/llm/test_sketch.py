import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from twinweave.llm import sketch


def brute_hashes(text):
    mask = (1 << 64) - 1
    base = int(sketch._BASE)
    runs = [text[k : k + 16] for k in range(len(text) - 15)] if len(text) > 16 else [text]
    out = set()
    for run in runs:
        v = 0
        for c in run:
            v = (v * base + ord(c) + 1) & mask
        if len(text) < 16:
            v = (v + len(text) * base) & mask
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & mask
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & mask
        out.add(v ^ v >> 31)
    return out


def brute_sketch(text):
    hashes = brute_hashes(text)
    kept = {h for h in hashes if h < (1 << 64) // 16} or {min(hashes)}
    return sorted(h >> 24 for h in kept)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_sketch(text):
    found = sketch.sketch(text)
    assert found.tolist() == brute_sketch(text)
    assert sketch.from_text(sketch.to_text(found)).tolist() == found.tolist()


def test_containment_of_unequal_texts():
    rng = np.random.default_rng(0)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 40_000))
    a, b = sketch.sketch(text[:4000]), sketch.sketch(text)
    assert sketch.containment(a, b) > 0.99 and abs(sketch.containment(b, a) - 0.1) < 0.03
    assert set(sketch.merge(a, b).tolist()) >= set(b.tolist())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcd", max_size=60), st.text(alphabet="abcd", max_size=60))
def test_sketch_of_a_union_is_the_merged_sketch(a, b):
    hashes = brute_hashes(a) | brute_hashes(b)
    want = sorted(h >> 24 for h in {h for h in hashes if h < (1 << 64) // 16} or {min(hashes)})
    assert sketch.merge(sketch.sketch(a), sketch.sketch(b)).tolist() == want


def brute(rows):
    """rows: (doc_id, text) with distinct ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out[doc_id] = hashlib.sha256(edited.encode()).hexdigest(), edited, after
    return out


def test_query(spark, sf, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_BYTES", 40_000)
    rows = sketch.query(spark, sf).collect()
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, own = brute(texts), dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        sha, edited, after = want[r.doc_id]
        assert r.edited_sha256 == sha and r.n_chars == len(own[r.doc_id])
        assert r.fingerprint == sketch.to_text(np.array(brute_sketch(own[r.doc_id]), np.uint64))
        assert r.edited_fingerprint == sketch.to_text(np.array(brute_sketch(edited), np.uint64))
        a, b = set(brute_sketch(own[r.doc_id])), set(brute_sketch(after))
        assert abs(r.near_next - len(a & b) / min(len(a), len(b))) < 1e-12


def test_odd_rows(spark, odd, docs):
    assert sketch.compare_with_next(odd).count() == 6
    assert sketch.compare_with_next(docs([])).count() == 0
    (only,) = sketch.compare_with_next(docs([(1, "abc")])).collect()
    assert only.near_next == 1.0
