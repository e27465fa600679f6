import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinweave.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, capacity):
    """The fewest sequences, by trying all ways to fill the one with the largest piece."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        best = len(left)
        first, rest = left[0], left[1:]
        fills = {()}
        for k, x in enumerate(rest):
            fills |= {f + (k,) for f in fills if first + sum(rest[i] for i in f) + x <= capacity}
        for f in fills:
            best = min(best, 1 + need(tuple(x for k, x in enumerate(rest) if k not in f)))
        return best

    return need(tuple(sorted(sizes, reverse=True)))


def sequences(patterns):
    return sum(times for _, times in patterns)


@pytest.mark.parametrize("seed", range(150))
def test_fixed_sets_lose_no_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 12, 20, 30])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    free = [0] * (capacity + 1)
    for x in sizes:
        free[x] += 1
    fixed = best_fit.reduction(free, capacity)
    rest = [x for x in range(capacity + 1) for _ in range(free[x])]
    assert sequences(fixed) + fewest(rest, capacity) == fewest(sizes, capacity)
    patterns = fixed + best_fit.best_fit(free, capacity)
    assert Counter(x for own, times in patterns for x in own for _ in range(times)) == Counter(sizes)
    assert all(sum(own) <= capacity for own, _ in patterns)


def plain_best_fit(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_in_rows_is_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([3, 5, 7, 11, 12, 31, 33, 40, 64]) for _ in range(rng.randint(0, 300))]
    patterns = best_fit.best_fit([sizes.count(x) for x in range(65)], 64)
    assert Counter({64 - sum(own): 0 for own, _ in patterns}) | Counter(64 - sum(own) for own, times in patterns for _ in range(times)) == Counter(plain_best_fit(sizes, 64))


def test_many_pieces_are_packed_near_the_bound():
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(6, 1, 200_000).astype(int), 1, 1024)
    counts = dict(Counter(sizes.tolist()))
    patterns = best_fit.pattern_list(counts)
    assert len(patterns) < 5000
    bound = max(-(-int(sizes.sum()) // 1024), int((sizes > 512).sum()))
    assert sequences(patterns) <= 1.002 * bound + 1


def test_ids_are_the_library_s():
    whole = Tokenizer.from_file(PATH)
    texts = ["Hello, World! don't 'll\nTwo", "a\nb c\n", " a", "a  b", "a\tb", "x y\x85z \x1c w", "", "\n", "a <|endoftext|> b  <|endoftext|>", "日本 語 😀\nة", "one\ntwo three\nfour"]
    texts += [f"a{chr(p)}b {chr(p)} 1{chr(p)}\n{chr(p)}x" for p in [*range(1, 0x300), *range(0x1FF0, 0x2070), 0x3000, 0x1680, 0xFEFF]]
    tokenizer = best_fit.ByteTokenizer(PATH)
    for text in texts:
        assert np.frombuffer(tokenizer(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts, capacity=best_fit.CAPACITY):
    whole, docs, want = Tokenizer.from_file(PATH), defaultdict(list), []
    for doc_id, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [best_fit.END_ID]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert Counter(want) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    for r in rows:
        docs[r.sequence_id].append((r.offset, r.length))
    for own in docs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(docs)


def test_pack(spark, odd, docs):
    check(best_fit.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    many = [(k, "lorem ipsum dolor " * (k % 97) * (1 + k % 7)) for k in range(400)] + [(7, "same text")] * 900
    check(best_fit.pack(docs(many)).collect(), many)
    assert best_fit.pack(docs([])).count() == 0


def test_query(spark, sf):
    rows = best_fit.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs])
    bound = max(-(-sum(r.length for r in rows) // best_fit.CAPACITY), sum(r.length > best_fit.CAPACITY // 2 for r in rows))
    assert used <= 1.02 * bound + 1


def test_other_tasks_same_count(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (best_fit.pack(docs.repartition(n)).agg(F.countDistinct("sequence_id")).first()[0] for n in (1, 7))
    assert one == many
