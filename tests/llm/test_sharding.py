import random
import zlib

from twinweave.llm import sharding


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r.size for r in own) for k, own in by.items()}


def test_query(spark, sf):
    rows = sharding.query(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = check(rows, texts, 16)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    mean = sum(sizes.values()) / 16
    longest = max(r.size for r in rows)
    assert all(abs(x - mean) <= 2 * longest for x in sizes.values())


def test_hot_group_is_cut_and_others_stay_together(spark, docs):
    texts = [(k, "same text " * 20) for k in range(900)] + [(k, f"text {k // 2} " * 20) for k in range(900, 2700)]
    rows = sharding.partition(docs(texts), 8).collect()
    sizes = check(rows, texts, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    shard = {r.doc_id: r.shard for r in rows}
    assert sum(shard[k] != shard[k + 1] for k in range(900, 2700, 2)) == 0


def test_groups_that_fit_stay_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.partition(docs, 16).collect()
    sizes, groups = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        groups.setdefault((r.text_crc32, r.size), []).append(r.shard)
    mean = sum(sizes.values()) / 16
    several = [g for g in groups.values() if len(g) > 1]
    assert len(several) > 50 and all(len(set(g)) == 1 for g in several)
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean


def test_heaviest_first():
    got, loads = sharding.lightest_first([(5, ("a",)), (9, ("b",)), (4, ("c",)), (4, ("d",))], 3)
    assert got == {("b",): 0, ("a",): 1, ("c",): 2, ("d",): 2} and loads == [9, 5, 8]


def brute_tree(points, shards, room=None):
    """The k-d tree in plain Python: points are (bytes, tie, values); the leaf's first shard for each."""
    room = room or [1] * shards
    whole = [max(p[2][d] for p in points) - min(p[2][d] for p in points) or 1.0 for d in range(3)]

    def split(own, n, first):
        if n == 1 or not own:
            return dict.fromkeys((p[1] for p in own), first)
        low, high = ([f(p[2][d] for p in own) for d in range(3)] for f in (min, max))
        d = max(range(3), key=lambda k: (high[k] - low[k]) / whole[k])
        scale = (1 << sharding.VALUE_BITS) - 1

        def key(p):
            place = int((p[2][d] - low[d]) / (high[d] - low[d]) * scale) if high[d] > low[d] else 0
            return place << sharding.TIE_BITS | (p[1] % (1 << 64)) >> (64 - sharding.TIE_BITS)

        if not sum(room[first : first + n // 2]):
            return split(own, n - n // 2, first + n // 2)
        order, asked, upto, cut = sorted(own, key=key), max(1, sum(p[0] for p in own) * sum(room[first : first + n // 2]) // sum(room[first : first + n])), 0, None
        for k, p in enumerate(order):
            before, upto = upto, upto + p[0]
            if upto >= asked:
                cut = k if asked - before < upto - asked else k + 1
                break
        return split(order[:cut], n // 2, first) | split(order[cut:], n - n // 2, first + n // 2)

    return split(points, shards, 0)


def test_tree_equals_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    rng = random.Random(2)
    points = [(rng.randrange(1, 900), rng.getrandbits(64) - (1 << 63), [rng.random() * 9, float(rng.randrange(5)), float(rng.randrange(3))]) for _ in range(400)]
    frame = spark.createDataFrame(points, "bytes long, tie long, values array<double>")
    got = {r.tie: r.node for r in sharding.tree_shards(frame, 7).collect()}
    assert got == brute_tree(points, 7)
    room = [0, 1, 9, 4, 4, 0, 2]
    got = {r.tie: r.node for r in sharding.tree_shards(frame, 7, room).collect()}
    assert got == brute_tree(points, 7, room)


def test_odd_rows(spark, odd, docs):
    rows = sharding.partition(odd, 3).collect()
    check(rows, odd.collect(), 3)
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.partition(docs([]), 4).count() == 0
    assert sharding.partition(docs([(1, "a"), (2, "b")]), target_bytes=2).select("shard").distinct().count() == 2


def test_nodes_lighter_than_their_shards(docs):
    for texts in ([(1, None)], [(1, "long " * 2000), (2, "")]):
        rows = sharding.partition(docs(texts), 16).collect()
        assert sorted(r.doc_id for r in rows) == [k for k, _ in texts]
        assert all(0 <= r.shard < 16 and r.slot == 0 for r in rows)
