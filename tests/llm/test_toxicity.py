import math
import random
import zlib

import numpy as np

from twinweave.llm import toxicity as T


def table(n, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "tree", "house", "river", "stone", "cloud", "wind"]
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["Vile!!", "NASTY,", "rotten"])
        yield k, " ".join(own), int(bad)


def test_held_out_accuracy(spark, docs):
    rows = list(table(1500))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    scored = {r.doc_id: r.toxicity_score for r in T.scored(docs([(k, t) for k, t, _ in rows]), labels).collect()}
    held = [(scored[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    wrong = sum((s >= T.THRESHOLD) != bool(y) for s, y in held)
    assert all(0 <= s <= 1 for s, _ in held) and wrong <= 0.05 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    rows = list(table(300))
    flip = lambda k, y: 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y
    a, b = (spark.createDataFrame([(k, f(k, y)) for k, _, y in rows], "doc_id long, toxic int") for f in (lambda k, y: y, flip))
    frame = docs([(k, t) for k, t, _ in rows])
    one, two = ({r.doc_id: r.toxicity_score for r in T.scored(frame, x).collect()} for x in (a, b))
    assert one == two


def test_learning_equals_the_plain_recurrence():
    """FTRL-proximal coordinate by coordinate, in plain Python."""
    rng = random.Random(1)
    rows = [(np.array(sorted(rng.sample(range(12), 4))), int(rng.random() < 0.4)) for _ in range(200)]
    z, n = np.zeros(T._SIZE + 1), np.zeros(T._SIZE + 1)
    T.learn(iter(rows), z, n)
    pz, pn = {}, {}

    def weight(k):
        own = pz.get(k, 0.0)
        bound = 0.0 if k == T._SIZE else T.L1
        if abs(own) <= bound:
            return 0.0
        return (math.copysign(bound, own) - own) / ((T.BETA + math.sqrt(pn.get(k, 0.0))) / T.ALPHA + T.L2)

    for at, label in rows:
        keys = [*at.tolist(), T._SIZE]
        w = {k: weight(k) for k in keys}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for k in keys:
            before = pn.get(k, 0.0)
            pz[k] = pz.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / T.ALPHA * w[k]
            pn[k] = before + g * g
    assert all(math.isclose(z[k], pz.get(k, 0.0), abs_tol=1e-9) and math.isclose(n[k], pn.get(k, 0.0), abs_tol=1e-9) for k in [*range(12), T._SIZE])


def test_features_are_words_pairs_and_skips():
    one, two = T.Features()("a b c"), T.Features()("A, b - c!")
    assert one.tolist() == two.tolist() and len(one) == 3 + 2 + 1 and len(T.Features()("")) == 0


def test_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(3, None), (4, 1), (None, 1)], "doc_id long, toxic int")
    rows = T.scored(odd, labels).collect()
    assert len(rows) == 6 and all(0 <= r.toxicity_score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity_score for r in T.scored(odd, none).collect()} == {0.5}
    assert T.scored(docs([]), labels).count() == 0
