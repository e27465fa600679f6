"""The candidate walk and the match loop against plain Python, and the SQL rounds against the end."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from twinweave import api
from twinweave.operators import matchloop, nearest, walk
from twinweave.plans import match_queries
from twinweave.plans.kernel_queries import with_code


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
    return row[-1]


def cosine(a, b):
    mask = (1 << 64) - 1
    i, x, y = ((a & b) & mask).bit_count(), (a & mask).bit_count(), (b & mask).bit_count()
    return 1.0 if a == b else i / (x * y) ** 0.5 if x and y else 0.0


def plain_walk(left, right, dist):
    """left, right: {class: ids in order}; dist(a, b): their distance or None. The rounds as they are said."""
    left, right = {k: list(v) for k, v in left.items()}, {k: list(v) for k, v in right.items()}
    lowest_l, lowest_r, out = {k: v[0] for k, v in left.items()}, {k: v[0] for k, v in right.items()}, set()
    while True:
        chosen = {}
        for b in right:
            near = [(d, lowest_l[a], a) for a in left if (d := dist(a, b)) is not None]
            if near:
                d, _, a = min(near, key=lambda x: x[:2])
                chosen.setdefault(a, []).append((d, lowest_r[b], b))
        if not chosen:
            return out
        for a, own in chosen.items():
            b = min(own, key=lambda x: x[:2])[2]
            m = min(len(left[a]), len(right[b]))
            out |= set(zip(left[a][:m], right[b][:m], strict=True))
            left[a], right[b] = left[a][m:], right[b][m:]
        left, right = {k: v for k, v in left.items() if v}, {k: v for k, v in right.items() if v}


def grouped(rows):
    out = {}
    for row in sorted(rows):
        out.setdefault(row[1:], []).append(row[0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_walk(spark, seed):
    rng = random.Random(seed)
    names = ["red box", "red bax", "green box", "blue tin", "blue tim", "box", "", None]
    make = lambda base: [(base + k, rng.choice("xy"), rng.choice(names), rng.choice([None, 0.0, 1.0, 2.0])) for k in range(70)]
    l, r = make(0), make(500)
    frame = lambda rows: with_code(spark.createDataFrame(rows, "id long, type string, name string, price double"), "name")
    left, right = frame(l), frame(r)
    code = {x.name or "": x.code for x in left.unionByName(right).select("name", "code").distinct().collect()}

    def dist(a, b):
        (t, n, p), (u, m, q) = a, b
        if t != u or cosine(code[n], code[m]) < 0.5:
            return None
        d = round((50 * (edits(n, m) / max(len(n), len(m)) if n or m else 0.0) + 10 * (p != q)) / 60, 9)
        return d if d <= 0.5 else None

    own = lambda rows: grouped([(i, t, n or "", p) for i, t, n, p in rows])
    got = {(x.left_id, x.right_id) for x in nearest.walked(left, right, nearest.name_pairs(left, right)).collect()}
    assert got == plain_walk(own(l), own(r), dist)


@pytest.mark.parametrize("chunk", [2, 256])
def test_match_level(spark, monkeypatch, chunk):
    """Nulls in every column, repeated values, a hot container dealt in lists."""
    monkeypatch.setattr(matchloop, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["alpha one", "alpha two", "alpha on", "beta", None, ""]
    make = lambda base: [(base + k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(texts), rng.choice([None, 1.0, 2.0])) for k in range(60)]
    l, r = make(0), make(100)
    frame = lambda rows: with_code(spark.createDataFrame(rows, "id long, parent long, text string, number double"), "text").withColumn("box_", F.lit("clash"))
    left, right = frame(l), frame(r)
    code = {x.text or "": x.code for x in left.unionByName(right).select("text", "code").distinct().collect()}
    above = spark.createDataFrame([(1, 2), (2, 1)], "left_id long, right_id long")
    got = {(x.left_id, x.right_id) for x in matchloop.match_level(left, right, above).collect()}

    def same(a, b):
        return {p for k in a.keys() & b.keys() for p in zip(a[k], b[k], strict=False)}

    box = {1: 2, 2: 1}
    own_l = [(i, box[p], t or "", n) for i, p, t, n in l if p in box]
    own_r = [(i, p, t or "", n) for i, p, t, n in r if p is not None]
    want = same(grouped(own_l), grouped(own_r))

    def dist(a, b):
        (p, t, n), (q, u, m) = a, b
        if p != q or cosine(code[t], code[u]) < 0.5:
            return None
        d = round((50 * (edits(t, u) / max(len(t), len(u)) if t or u else 0.0) + 10 * (n != m)) / 60, 9)
        return d if d <= 0.5 else None

    done_l, done_r = {i for i, _ in want}, {j for _, j in want}
    want |= plain_walk(grouped([x for x in own_l if x[0] not in done_l]), grouped([x for x in own_r if x[0] not in done_r]), dist)
    done_l, done_r = {i for i, _ in want}, {j for _, j in want}
    want |= same(grouped([(i, t or "", n) for i, _, t, n in l if i not in done_l]), grouped([(i, t or "", n) for i, _, t, n in r if i not in done_r]))
    assert got == want
    assert matchloop.match_level(left.limit(0), right, above).count() == 0


@pytest.mark.parametrize("chunk", [16, 256])
def test_closest_first_finds_the_nearest(spark, monkeypatch, chunk):
    """Texts that settle it by their number, by few edits or not at all, ties, wide characters and nulls: as by comparing all."""
    monkeypatch.setattr(matchloop, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda: rng.choice(["", "a", "é", "名前", "name#0", "name#00"]) + "".join(rng.choice("0123é") for _ in range(rng.choice([0, 1, 3, 9])))
    make = lambda base: [(base + k, rng.choice([1, 1, 1, 2, None]), word(), rng.choice([None, 0.0, 1.0, 2.0, 3.0])) for k in range(300)]
    frame = lambda base: walk.classes(with_code(spark.createDataFrame(make(base), "id long, box long, text string, number double"), "text"), "box", "text", "number")
    l, r = frame(0).filter("box IS NOT NULL").cache(), frame(1000).filter("box IS NOT NULL").cache()
    every = {(x.right_cls, x.left_cls, x.dist) for x in matchloop.nearest_in_box(l, r).collect()}
    asked = []
    in_lists = matchloop._in_lists
    monkeypatch.setattr(matchloop, "FEW", 1000)
    monkeypatch.setattr(matchloop, "_in_lists", lambda left, right, tasks: asked.append(right.count()) or in_lists(left, right, tasks))
    assert {(x.right_cls, x.left_cls, x.dist) for x in matchloop.nearest_in_box(l, r).collect()} == every
    assert len(every) > 100 and 0 < asked[0] < r.count() / 2


def test_a_large_container_compares_few(spark, monkeypatch):
    """Of 1,500 and 1,500 objects of one container all are settled before the lists: no one is compared with all."""
    make = lambda base, end: with_code(spark.createDataFrame([(base + k, 1, f"object {k:06d}{end}", float(k)) for k in range(1500)], "id long, box long, text string, number double"), "text")
    l, r = (walk.classes(make(b, end), "box", "text", "number") for b, end in ((0, ""), (5000, " v2")))
    monkeypatch.setattr(matchloop, "_in_lists", None)
    assert {(x.left_cls, x.right_cls) for x in matchloop.nearest_in_box(l, r).collect()} == {(k, 5000 + k) for k in range(1500)}


def test_codes_only_of_what_is_left(spark):
    """Codes are made of the texts that reach the walk: a level whose objects have none gives the same matches."""
    rows = [(k, k % 2, f"text {k}", float(k)) for k in range(40)]
    left = spark.createDataFrame(rows, "id long, parent long, text string, number double")
    right = left.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))).withColumn("id", F.col("id") + 100)
    above = spark.createDataFrame([(0, 0), (1, 1)], "left_id long, right_id long")
    want = {tuple(x) for x in matchloop.match_level(with_code(left, "text"), with_code(right, "text"), above).collect()}
    assert {tuple(x) for x in matchloop.match_level(left, right, above).collect()} == want == {(k, k + 100) for k in range(40)}


@pytest.mark.parametrize("large", [2, 200_000])
def test_identical_several(spark, monkeypatch, large):
    """Classes of unlike sizes, one with an object on one side, and ids far apart."""
    monkeypatch.setattr(walk, "LARGE", large)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    left = frame([(k * 70_000, "a") for k in range(5)] + [(1, "b"), (2, "c"), (3, None), (4, None)])
    right = frame([(k * 90_000 + 7, "a") for k in range(3)] + [(8, "b"), (9, "b"), (10, "d"), (11, None), (12, None), (13, None)])
    want = {(k * 70_000, k * 90_000 + 7) for k in range(3)} | {(1, 8), (3, 11), (4, 12)}
    assert {tuple(x) for x in walk.identical(left, right, "text").collect()} == want


def test_the_last_level_of_differences_is_not_written(spark, monkeypatch):
    """Only levels that the next one asks for become tables."""
    names, written = [], matchloop.written
    monkeypatch.setattr(matchloop, "written", lambda d, name: names.append(name) or written(d, name))
    rows = [("a", 1, 1, None), ("a", 2, None, None), ("b", 5, None, 1), ("b", None, 6, 2)]
    found = spark.createDataFrame(rows, "type string, left_id long, right_id long, parent_match long")
    got = {(r.left_id, r.right_id, r.differs, r.below) for r in matchloop.differences(found, ["a", "b"]).collect()}
    assert got == {(1, 1, False, False), (2, None, True, False), (5, None, True, False), (None, 6, True, True)}
    assert names == ["differences"]


def test_identical_nulls(spark):
    rows = [(1, None, 2.0), (2, "a", None), (3, "a", None), (4, "a", float("nan"))]
    frame = spark.createDataFrame(rows, "id long, text string, number double")
    other = frame.withColumn("id", F.col("id") + 10)
    assert {tuple(x) for x in walk.identical(frame, other, "text", "number").collect()} == {(k, k + 10) for k in (1, 2, 3, 4)}


def test_a_large_container_lists_no_pairs(spark):
    """Of 300 and 300 different objects of one container each right one is a row for each list of left ones."""
    make = lambda base: with_code(spark.createDataFrame([(base + k, 1, f"object {base + k:06d}", float(k)) for k in range(300)], "id long, box long, text string, number double"), "text")
    l, r = (walk.classes(make(b), "box", "text", "number") for b in (0, 1000))
    found = matchloop.nearest_in_box(l, r)
    assert found.count() == 300
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_last_sql_round_is_empty(sf_dir):
    con = duckdb.connect()
    for name in ("part", "nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    last = match_queries.ROUNDS - 1
    walks = f"WITH {match_queries._CANDIDATES}, near AS (SELECT * FROM c WHERE dist <= 0.5), {match_queries._sql_walk('near', 'w', last + 1)} SELECT count(*) FROM w_n{last}"
    assert con.execute(walks).fetchone() == (0,)
    for name in ("w1", "w2", "w3"):
        assert con.execute(f"WITH {match_queries._THREE} SELECT count(*) FROM {name}_n{last}").fetchone() == (0,)
    for name in ("customer", "orders"):
        assert con.execute(f"WITH {match_queries._NESTED} SELECT count(*) FROM w_{name}_n{last}").fetchone() == (0,)


def test_api_walks_to_the_end(spark):
    schema = "id long, type string, name string"
    left = spark.createDataFrame([(1, "EClass", "abcdefgh"), (2, "EClass", "abcdefgx"), (3, "EClass", None), (4, "Other", "q")], schema)
    right = spark.createDataFrame([(11, "EClass", "abcdefgh"), (12, "EClass", "abcdefgy"), (13, "EClass", ""), (14, "EClass", "zzz")], schema)
    got = {(r.left_id, r.right_id) for r in api.match(left, right, {"name": 50.0}).collect()}
    assert got == {(1, 11), (2, 12), (3, 13), (4, None), (None, 14)}


def test_estimate_and_compare(spark):
    rows = spark.createDataFrame([("EClass", n) for n in ("customer order", "order line", "address book", "invoice", None)] + [("EEnum", "color")], "type string, name string")
    found = api.estimate(rows, "name", 3).collect()
    assert {(r.type, r.method) for r in found} == {(t, m) for t in ("EClass", "EEnum") for m in ("LSH_Cos", "LSH_Jac", "LSH_Sor", "OneHot")}
    assert all(10 <= r.threshold <= 80 and 0 < r.f2 <= 1 for r in found)
    limits = api.thresholds_of(api.estimate(rows, "name", 3))
    left = rows.withColumn("id", F.monotonically_increasing_id())
    right = left.withColumn("id", F.col("id") + 1000).withColumn("name", F.concat("name", F.lit("s")))
    (r,) = api.compare(left, right, {"name": 50.0}, thresholds=limits).collect()
    assert r.total == 6 and 0 <= r.diffs <= 2
    assert api.estimate(rows.limit(0), "name").count() == 0
