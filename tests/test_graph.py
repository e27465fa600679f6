"""Closures, draws, votes of neighbours and differences against plain Python."""

import random

from pyspark.sql import functions as F

from twinweave.operators import closure, convolution, draws, matchloop


def steps_above(edges):
    found = {}
    for start in {a for a, _ in edges}:
        now, n = {start}, 0
        while now:
            n += 1
            now = {b for a, b in edges if a in now} - {b for a, b in found if a == start}
            found |= {(start, b): n for b in now}
    return found


def test_closure(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)]
    edges += [(f"c{k}", f"c{k + 1}") for k in range(70)] + [("c70", "c60"), ("c5", "c6"), ("x", None), (None, "y")]
    frame = spark.createDataFrame(edges, "node string, above string")
    real = [e for e in edges if None not in e]
    assert {(r.node, r.above): r.steps for r in closure.above(frame).collect()} == steps_above(real)
    assert closure.above(frame.limit(0)).count() == 0
    nodes = spark.createDataFrame([("c0",), ("c69",), ("lone",), ("c3",)], "node string")
    marks = spark.createDataFrame([("c2",), ("lone",)], "node string")
    assert {tuple(r) for r in closure.marked_from_above(nodes, frame, marks).collect()} == {("c0", True), ("c69", False), ("lone", True), ("c3", False)}


def test_marks_go_down_without_paths(spark, monkeypatch):
    """Trees as deep as the models' are marked without the pairs of their closure; chains and cycles to their end."""
    tree = [(f"n{k}", f"n{(k - 1) // 2}") for k in range(1, 300)]
    frame = spark.createDataFrame(tree, "node string, above string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(300)], "node string")
    marks = spark.createDataFrame([("n2",), ("n2",), ("n9",), (None,)], "node string")
    up, want = dict(tree), {}
    for k in range(300):
        n, way = f"n{k}", []
        while n:
            way, n = [*way, n], up.get(n)
        want[f"n{k}"] = bool({"n2", "n9"} & set(way))
    with monkeypatch.context() as m:
        m.setattr(closure, "above", None)
        assert {r.node: r.marked for r in closure.marked_from_above(nodes, frame, marks).collect()} == want
    monkeypatch.setattr(closure, "STEPS", 2)
    chain = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n12", "n5"), ("n20", "n21")]
    frame = spark.createDataFrame(chain, "node string, above string")
    marks = spark.createDataFrame([("n9",)], "node string")
    got = {r.node for r in closure.marked_from_above(nodes, frame, marks).filter("marked").collect()}
    assert got == {f"n{k}" for k in range(13)}


def test_draws(spark):
    weights = {"a": 5, "b": 0, "c": 1, "d": 1000, "e": 3, "f": -2}
    items = spark.createDataFrame(list(weights.items()), "item string, w long")
    ranges = draws.intervals(items, "item", "w")
    line = [k for k in sorted(weights) for _ in range(max(0, weights[k]))]
    asked = spark.createDataFrame([(k,) for k in range(-2, len(line) + 3)], "u long")
    got = {r.u: r.item for r in draws.drawn(asked, "u", ranges).collect()}
    assert got == dict(enumerate(line))
    sent = draws.intervals(items.limit(0), "item", "w")
    assert sent.count() == 0 and draws.drawn(asked, "u", sent).count() == 0


def test_votes_of_neighbours(spark):
    rng = random.Random(2)
    codes = {k: rng.choice([0, 0, rng.getrandbits(64) & rng.getrandbits(64)]) for k in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    inside = [(rng.randrange(6), rng.randrange(45)) for _ in range(150)]
    across = [(rng.randrange(8), rng.randrange(45)) for _ in range(60)]
    objects = spark.createDataFrame([("t", k, signed(c)) for k, c in codes.items()] + [("t", 99, None)], "type string, key long, code long")
    edges = lambda rows: spark.createDataFrame([("t", a, "t", b) for a, b in rows], "type string, key long, to_type string, to_key long")

    def vote(rows, key, weight, against):
        own = [codes[b] for a, b in rows if a == key and codes.get(b)]
        return sum(1 << k for k in range(64) if sum(weight if c >> k & 1 else -against for c in own) > 0)

    got = {r.key: r.final_code & (1 << 64) - 1 for r in convolution.final_codes(objects, edges(inside), edges(across)).collect()}
    assert got == {k: c | vote(inside, k, 10, 5) | vote(across, k, 5, 2) for k, c in codes.items()} | {99: 0}
    both = convolution.same_final_code(*[spark.createDataFrame(rows, "type string, final_code long, key long") for rows in ([("t", 1, 5), ("t", 1, 3), ("t", 2, 1)], [("t", 1, 9), ("u", 2, 1)])])
    assert [tuple(r) for r in both.select("type", "final_code", "left_n", "left_key", "right_n", "right_key").collect()] == [("t", 1, 2, 3, 1, 9)]


def test_differences(spark):
    rows = [
        ("a", 1, 1, None), ("a", 2, None, None), ("a", None, 3, None),
        ("b", 10, 10, 1), ("b", 11, None, 1), ("b", 12, None, 2), ("b", None, 13, None), ("b", None, 14, 1),
        ("c", 20, None, 11), ("c", 21, None, 10), ("c", 22, 22, 12),
    ]
    found = spark.createDataFrame(rows, "type string, left_id long, right_id long, parent_match long")
    got = {(r.type, r.left_id, r.right_id): (r.differs, r.below) for r in matchloop.differences(found, ["a", "b", "c"]).collect()}
    assert {k for k, (differs, below) in got.items() if differs and not below} == {("a", 2, None), ("a", None, 3), ("b", 11, None), ("b", None, 14), ("c", 21, None)}
    assert got["c", 22, 22] == (False, True) and got["b", 10, 10] == (False, False) and got["b", None, 13] == (True, True)
    assert matchloop.differences(found.filter(F.lit(False)), ["a"]).count() == 0
