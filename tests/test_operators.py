"""Joins against brute force, matching laws, thresholds, logs, XML, sinks, a stream."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from twinweave import api, features, model
from twinweave.functions import kernels
from twinweave.operators import evaluation, joins, matchloop, nearest, votes
from twinweave.plans import match_queries
from twinweave.sources import readers, sinks
from twinweave.streaming import incremental


def codes(spark, seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) & rng.getrandbits(64) for _ in range(20)]
    rows = []
    for k in range(n):
        c = rng.choice(base)
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        rows.append((k, rng.choice("xy"), c - (1 << 64) if c >> 63 else c))
    rows.append((n, "x", 0))
    return spark.createDataFrame(rows, "id long, type string, code long"), rows


def cosine(a, b):
    a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
    p = (a.bit_count() * b.bit_count()) ** 0.5
    return 1.0 if a == b else (a & b).bit_count() / p if p else 0.0


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_band_join_finds_all(spark, least):
    (left, l), (right, r) = codes(spark, 1, 120), codes(spark, 2, 120)
    got = {(x.type, x.left_code, x.right_code) for x in joins.similar_codes(left, right, least).collect()}
    assert got == {(t, a, b) for _, t, a in l for _, u, b in r if t == u and cosine(a, b) >= least}


@pytest.mark.parametrize("most", [0, 3, 7, 9, 15])
def test_byte_join_finds_all(spark, most):
    (left, l), (right, r) = codes(spark, 3, 120), codes(spark, 4, 120)
    got = {(x.type, x.left_code, x.right_code) for x in joins.near_codes(left, right, most).collect()}
    assert got == {(t, a, b) for _, t, a in l for _, u, b in r if t == u and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}


def test_pairs_of_codes_expand_to_pairs_of_objects(spark):
    (left, l), (right, r) = codes(spark, 5, 60), codes(spark, 6, 60)
    pairs = joins.similar_codes(left, right, 0.8).select("type", "left_code", "right_code")
    got = {(x.left_id, x.right_id) for x in joins.expanded(pairs, left, right).collect()}
    assert got == {(i, j) for i, t, a in l for j, u, b in r if t == u and cosine(a, b) >= 0.8}


def test_unchanged_objects_match_themselves_and_sides_swap(spark, sf):
    parts = match_queries.coded(model.table(spark, sf, "part").limit(200))
    same = nearest.walked(parts, parts, nearest.name_pairs(parts, parts)).collect()
    assert len(same) == 200 and all(x.left_id == x.right_id and x.dist == 0 for x in same)
    l, r = match_queries.sides(spark, sf)
    one = {(x.left_id, x.right_id) for x in nearest.mutual(l, r, nearest.name_pairs(l, r)).collect()}
    two = {(x.right_id, x.left_id) for x in nearest.mutual(r, l, nearest.name_pairs(r, l)).collect()}
    assert one == two


def test_nearest_and_walk_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["red box", "red bax", "green box", "blue tin", "blue tim", "box", ""]
    make = lambda: [(k, rng.choice("xy"), rng.choice(names), float(rng.randrange(3))) for k in range(60)]
    l, r = make(), make()
    frame = lambda rows: match_queries.with_code(spark.createDataFrame(rows, "id long, type string, name string, price double"), "name")
    left, right = frame(l), frame(r)
    code = {x.name: x.code for x in left.unionByName(right).select("name", "code").distinct().collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
        return row[-1]

    dist = {}
    for i, t, n, p in l:
        for j, u, m, q in r:
            if t == u and cosine(code[n], code[m]) >= 0.5:
                apart = edits(n, m) / max(len(n), len(m)) if n or m else 0.0
                dist[i, j] = round((50 * apart + 10 * (p != q)) / 60, 9)
    pairs = nearest.name_pairs(left, right)
    got = {x.left_id: (x.dist, x.right_id) for x in nearest.best_matches(left, right, pairs).collect()}
    assert got == {i: min((d, j) for (k, j), d in dist.items() if k == i) for i, _ in dist}


def test_code_joins_prune(spark):
    """Of all pairs of codes few meet under a block."""
    rng = random.Random(8)
    rows = [(k, "x", rng.getrandbits(63)) for k in range(4000)]
    frame = spark.createDataFrame(rows, "id long, type string, code long")
    l, r = joins.distinct_codes(frame, "left").withColumn("reach", F.lit(6)), joins.distinct_codes(frame, "right")
    assert joins._met(l, r, [6]).count() < 4000 * 4000 * 0.002
    assert all(sum(x + 1 for x in joins.radii(most)) == most + 1 for most in range(20))


def test_double_bits(spark):
    values = [0.0, 1.0, -1.0, 0.1, 1e308, 5e-324, 2.2e-308, -12345.678, 0.5, 2.0**60, 1 / 3, float("inf"), float("-inf")]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    want = [struct.unpack("<q", struct.pack("<d", v))[0] for v in values]
    assert [r[0] for r in frame.select(kernels.double_bits(F.col("v"))).collect()] == want
    assert [r._bits_v for r in kernels.with_double_bits(frame, ["v"]).collect()] == want


def test_votes(spark):
    rng = random.Random(9)
    rows = [tuple(rng.choice([None, 0, -1, rng.getrandbits(64) - (1 << 63)]) for _ in range(3)) for _ in range(40)]
    weights = [(50, 10), (10, 2), (5, 1)]
    got = votes.voted(spark.createDataFrame(rows, "a long, b long, c long"), [(c, *w) for c, w in zip("abc", weights, strict=True)], "code").collect()
    for row, r in zip(rows, got, strict=True):
        own = [(c & (1 << 64) - 1, p, q) for c, (p, q) in zip(row, weights, strict=True) if c]
        want = sum(1 << b for b in range(64) if sum(p if c >> b & 1 else -q for c, p, q in own) > 0)
        assert r.code & (1 << 64) - 1 == want


def test_features():
    by = {(f.type, f.name): f for f in features.FEATURES}
    assert not features.hashable(by["orders", "customer"]) and features.hasher(by["orders", "o_orderdate"]) is None
    assert features.hasher(by["customer", "orders"]) == "locations" and not features.one_hot(by["customer", "orders"])
    assert features.weights(by["part", "p_name"], "default") == (50, 10) and features.weights(by["part", "p_name"], "structural") == (0, 0)
    assert features.weights(by["customer", "nation"], "structural") == (5, 1) and features.container_ratio("part") == 0.1


def test_ordinals(spark, monkeypatch):
    monkeypatch.setattr(model, "BUCKET", 3)
    rows = spark.createDataFrame([(k % 2, k) for k in range(20)], "up long, key long")
    got = {(r.up, r.key): r.ord for r in model.ordinals(rows, "up", "key").collect()}
    assert got == {(k % 2, k): k // 2 for k in range(20)}


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, v double")
    a, b = evaluation.boxplot(rows, "g", "v").orderBy("g").collect()
    assert (a.q1, a.q2, a.q3, a.low, a.high) == (1.75, 3.5, 28.75, 1.0, 5.0)
    assert (b.q1, b.q2, b.q3, b.low, b.high) == (7.0,) * 5


def test_threshold_lines(spark):
    lines = spark.createDataFrame([(" EClass = 0.53 ",), ("EClass = 0.9",), ("\tdefault = 0.3\t",), ("x",)], "value string")
    limits = readers.thresholds_from_text(lines)
    rows = spark.createDataFrame([("EClass",), ("Other",)], "type string")
    assert {r.type: r.min_sim for r in readers.with_threshold(rows, limits).collect()} == {"EClass": 0.53, "Other": 0.3}
    plain = readers.with_threshold(rows, readers.built_in_thresholds(spark))
    assert {r.type: r.min_sim for r in plain.collect()} == {"EClass": 0.59, "Other": 0.5}
    assert readers.built_in_thresholds(spark, uml=True).count() == 49


def test_logs(spark):
    scores = "threshold=0.6500    TPR=0.9400    FPR=0.1200    Prec=0.9100    Recall=0.9400    Acc=0.9300    F2=0.9400"
    estimation = f"[EClass]    [LSH_Jac]    {scores}\n====[SUMMARY]====\n[EClass]    [LSH_Cos]    {scores}\n[EEnum]    [OneHot]    {scores}\nnoise\n====[CONFIG]====\n[EClass]    [LSH_Sor]    {scores}"
    lines = readers.log_lines(spark.createDataFrame([("a", estimation)], "file string, value string"))
    found = {(r.type, r.hash, r.sim): r for r in readers.estimations(lines.filter("in_summary")).collect()}
    assert set(found) == {("EClass", "LSH", "Cos"), ("EEnum", "OHR", "Jac")} and found["EClass", "LSH", "Cos"].recall == 0.94
    run = "r_1 [numOfEdits=12, t=3, m=4, diffs=3, total=240, criticalMiss=2]"
    compared = f"{run}\nx\n====[SUMMARY]====\nTime:    Avg(A)=1.5    Avg(B)=3.0\nDiff Rate:    Total=0.2500%    Critical=0.1000%"
    lines = readers.log_lines(spark.createDataFrame([("m.log", compared), ("n.log", "no summary")], "file string, value string"))
    (r,) = readers.comparisons(lines).collect()
    assert (r.file, r.edits, r.diffs, r.total, r.critical) == ("m.log", 12, 3, 240, 2)
    (r,) = readers.summaries(lines, ["file"]).collect()
    assert tuple(r) == ("m.log", 1.5, 3.0, 0.25, 0.1)


def test_xml_and_sinks(spark, tmp_path):
    xml = (
        '<?xml version="1.0"?><EPackage name="p"><eClassifiers xsi:type="EClass" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" name="A" eSuperTypes="#//B //Gone"/>'
        '<eClassifiers xsi:type="EDataType" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" name="T"/></EPackage>'
    )
    (tmp_path / "m.ecore").write_text(xml)
    rows = {r.name: r.type for r in api.read_objects(spark, str(tmp_path / "m.ecore")).collect()}
    assert rows == {"p": "EPackage", "A": "EClass", "T": "EDataType"}
    (text,) = readers.models_in(spark, str(tmp_path), "*.ecore").collect()
    assert text.value == xml
    matches = spark.createDataFrame([(1, 2), (3, None)], "left_id long, right_id long")
    sinks.write_text(matches, str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"1 <-> 2", "3 <-> -"}
    sinks.write_matches(matches, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    ids = sinks.with_stable_ids(matches, "left_id", "right_id")
    assert ids.select("object_id").distinct().count() == 2


def test_api(spark):
    schema = "id long, type string, name string, box string"
    left = spark.createDataFrame([(1, "EClass", "Customer", "b"), (2, "EClass", "Invoice", "b"), (3, "EEnum", "Color", "b")], schema)
    right = spark.createDataFrame([(11, "EClass", "Customers", "b"), (12, "EClass", "Zebra", "b"), (13, "EEnum", "Color", "b")], schema)
    got = {(r.left_id, r.right_id) for r in api.match(left, right, {"name": 50.0}, ["box"]).collect()}
    assert got == {(1, 11), (2, None), (3, 13), (None, 12)}
    assert {(r.left_id, r.right_id) for r in api.match(left, right, {"name": 50.0}).collect()} == got
    three = api.match(left, right, {"name": 50.0}, ["box"], origin=left.withColumn("id", F.col("id") + 100)).collect()
    assert {(r.left_id, r.right_id, r.origin_id) for r in three} == {(1, 11, 101), (2, None, 102), (3, 13, 103), (None, 12, None)}


def test_stream(spark, sf, tmp_path):
    schema = model.table(spark, sf, "events").schema
    (tmp_path / "in").mkdir()
    model.table(spark, sf, "events").coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = incremental.coded_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "event_type")
    query = incremental.codes_per_window(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("codes")
    running = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert spark.table("codes").agg(F.sum("n")).first()[0] == model.table(spark, sf, "events").count()
    seen = []
    known = model.table(spark, sf, "events").select("event_type").distinct()
    incremental.match_each_batch(stream, known, ["event_type"], lambda d, k: seen.append(d.count()), str(tmp_path / "d")).awaitTermination(120)
    assert sum(seen) == model.table(spark, sf, "events").count()
