"""Hash kernels and similarities against plain Python on edge values."""

import math

import pytest
from pyspark.sql import functions as F

from twinweave.functions import kernels as K
from twinweave.functions import similarity as S

TEXTS = ["", "a", "Ab", "größe", "\U0001f600x", "Hello, World", "zz" * 40]
CODES = [0, -1, 1, -(1 << 63), 5, 0x0F0F, 1 << 40 | 3]
MASK = (1 << 64) - 1


def signed(x):
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def string_code(text, n=2):
    raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    if len(raw) < 2:
        return signed(1 << raw[0] % 64) if raw else 0
    out = 0
    for i in range(len(raw) - 1):
        h = 0
        for b in raw[i : i + n]:
            h = h * 23 + b
        out |= 1 << h % 64
    return signed(out)


def string_position(text):
    raw = text.encode("utf-16-be")
    h = 0
    for k in range(0, len(raw), 2):
        h = (h * 31 + raw[k] * 256 + raw[k + 1]) % (1 << 32)
    return h % 64


def test_strings(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for n in (2, 3):
        assert [r[0] for r in frame.select(K.string_code(F.col("t"), n)).collect()] == [string_code(t, n) for t in TEXTS]
    assert [r[0] for r in frame.select(K.string_position(F.col("t"))).collect()] == list(map(string_position, TEXTS))
    assert spark.createDataFrame([(None,)], "t string").select(K.string_code(F.col("t"))).first()[0] == 0
    assert [K.name_position(t) for t in TEXTS] == list(map(string_position, TEXTS))
    grams = [r[0] for r in frame.select(K.ngrams(F.col("t"))).collect()]
    assert grams == [[] if not t else [t] if len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)] for t in TEXTS]


def test_numbers(spark):
    values = [0, 1, -1, 2**40, -(2**63), 123456789]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    fold = lambda v: ((v & MASK) ^ ((v & MASK) >> 32)) % 64
    assert [r[0] for r in frame.select(K.long_position(F.col("v"))).collect()] == list(map(fold, values))


def test_votes(spark):
    lists = [[], [3], [3, 6], [3, 6, 2], CODES, [-(1 << 63)] * 3]
    frame = spark.createDataFrame([(x,) for x in lists], "x array<long>")

    def majority(x, small):
        if small and len(x) <= 2:
            return signed(sum({1 << b for c in x for b in range(64) if c >> b & 1}))
        return signed(sum(1 << b for b in range(64) if sum(c >> b & 1 for c in x) > len(x) // 2))

    for small in (True, False):
        got = [r[0] for r in frame.select(K.majority(F.col("x"), small)).collect()]
        assert got == [majority(x, small) for x in lists]
    features = [(7, 50, 10), (-8, 10, 2), (0, 10, 2), (1 << 63 - 1, 5, 1)]
    rows = spark.createDataFrame([(features,)], "f array<struct<code:long,pos:int,neg:int>>")
    voting = [x for x in features if x[0]]
    want = sum(1 << b for b in range(64) if sum(p if c >> b & 1 else -n for c, p, n in voting) > 0)
    assert rows.select(K.weighted_vote(F.col("f"))).first()[0] == signed(want)


def test_bits(spark):
    frame = spark.createDataFrame([(c,) for c in CODES], "c long")
    rotate = lambda c, p, k: signed((c & MASK) >> p | (c & ((1 << k) - 1)) << (64 - p))
    for form, p, k in ((K.rotated3, 3, 2), (K.rotated5, 5, 5), (K.rotated7, 7, 7)):
        assert [r[0] for r in frame.select(form(F.col("c"))).collect()] == [rotate(c, p, k) for c in CODES]
    for depth in range(5):
        width = 64 >> depth
        want = [[((c & MASK) >> k * width & ((1 << width) - 1)).bit_count() for k in range(1 << depth)] for c in CODES]
        assert [r[0] for r in frame.select(K.pattern(F.col("c"), depth)).collect()] == want
    assert [r[0] for r in frame.select(K.binary(F.col("c"))).collect()] == [f"{c & MASK:064b}" for c in CODES]


@pytest.mark.parametrize("name", ["cosine", "jaccard", "sorensen", "simple"])
def test_similarities(spark, name):
    pairs = [(a, b) for a in CODES for b in CODES]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(getattr(S, name)(F.col("a"), F.col("b"))).collect()]
    for (a, b), value in zip(pairs, got, strict=True):
        x, y = a & MASK, b & MASK
        i, u, p, q = (x & y).bit_count(), (x | y).bit_count(), x.bit_count(), y.bit_count()
        top, below = {"cosine": (i, math.sqrt(p * q)), "jaccard": (i, u)}.get(name, (2 * i, p + q))
        want = 1.0 if a == b and name != "simple" else top / below if below else 0.0
        assert value == pytest.approx(want)


def test_sets_and_vectors(spark):
    row = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    assert row.select(S.set_jaccard(a, b), S.set_hamming(a, b)).first()[:] == (0.4, 3)
    empty = spark.createDataFrame([([], [])], "a array<int>, b array<int>")
    assert empty.select(S.set_jaccard(a, b)).first()[0] == 0.0
    vectors = spark.createDataFrame([([1, 2, 3], [3, 2, 0])], "a array<long>, b array<long>")
    assert vectors.select(S.l1(a, b)).first()[0] == 5
