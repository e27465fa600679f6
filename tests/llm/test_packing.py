import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_library_s():
    whole = Tokenizer.from_file(PATH)
    texts = ["Hello, World!! don't DON'T", "Straße İstanbul ŉ ½ x²y ΑΣ ſ ﬁ 日本 😀 a\x1cb \x0bq\x85r\xa0s", "", " \n", "<|endoftext|> a<|endoftext|>b", "e\u0301 ÀÁ µ ª"]
    texts += [a + chr(p) + b for p in range(1, 0x250) for a, b in (("", ""), ("a", "b"), ("1", " '"))]
    for text, ids in zip(texts, packing.WordTokenizer(PATH).batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts):
    """Each id in one piece, offsets gapless, sequences within the capacity."""
    whole = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID])
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= packing.CAPACITY
        assert at == packing.CAPACITY or at & (at - 1) == 0
    for doc_id, own in docs.items():
        if len(want[doc_id]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                ids = want[doc_id][0][r.start : r.start + r.length]
                assert r.start == at and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
                at += r.length
            assert at == own[0].doc_tokens == len(want[doc_id][0])
    assert sum(r.length for r in rows) == sum(len(x) for own in want.values() for x in own)


def test_pack(spark, odd, docs):
    check(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    many = [(k, "lorem ipsum dolor " * (k % 97)) for k in range(500)]
    check(packing.pack(docs(many)).collect(), many)
    assert packing.pack(docs([])).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 3000, 400).tolist()
    full, rest = divmod(sum(lengths), packing.CAPACITY)
    costs, used = [0.0] * (full + 1), [0] * (full + 1)
    for _, _, n, seq in packing.assign(lengths, [packing.CAPACITY] * full + [rest]):
        costs[seq] += packing.cost(n)
        used[seq] += n
    assert used == [packing.CAPACITY] * full + [rest]
    assert np.std(costs[:-1]) < 0.35 * np.mean(costs[:-1])


def test_query(spark, sf):
    rows = packing.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(rows, [(r.doc_id, r.text) for r in docs])
