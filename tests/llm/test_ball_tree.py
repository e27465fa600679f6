import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from twinweave.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=10):
    """docs and items: (id, text) pairs."""
    split = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(n > 0 for *_, n in split), sum(n for *_, n in split)
    having, out = Counter(t for _, own, _ in split for t in own), []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, own, n in split:
            score = 0
            for t in terms(text):
                if tf := own[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // all_terms)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scores)[:best], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark, odd, docs):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "One WORD, x_y"), (2, None), (3, ""), (3, "five six word"), (3, "five six word"), (None, "y x"), (4, "nowhere")]
    table = spark.createDataFrame(items, ITEMS)
    assert rows_of(ball_tree.search(odd, table)) == brute(texts, items)
    assert ball_tree.search(docs([]), table).count() == 0
    assert ball_tree.search(odd, spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("leaf, block, lot, cut", [(1, 64, 4096, 200_000), (3, 17, 6, 15), (96, 8192, 128, 200_000)])
def test_against_brute_force(spark, docs, monkeypatch, leaf, block, lot, cut):
    rng = random.Random(leaf)
    words = [f"w{k}" for k in range(40)] + ["É", "日本", "ß"]
    some = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 42)] for _ in range(n))
    texts = [(k % 200, some(rng.randint(0, 60))) for k in range(300)] + [(900 + k, "w1 w2 w30") for k in range(40)]
    items = [(k, some(rng.randint(1, 9))) for k in range(25)]
    for name, value in (("LEAF", leaf), ("BLOCK_ROWS", block), ("LOT_TERMS", lot), ("SLICE_TERMS", cut)):
        monkeypatch.setattr(ball_tree, name, value)
    assert rows_of(ball_tree.search(docs(texts), spark.createDataFrame(items, ITEMS))) == brute(texts, items)


def test_no_row_exceeds_its_nodes_bound():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 500)
    starts = np.r_[0, np.cumsum(sizes)]
    columns = np.concatenate([rng.choice(50, n, replace=False) for n in sizes])
    tree = ball_tree.Tree(starts, columns, rng.integers(1, 10**10, len(columns)), 50)
    below = lambda node: [node] if node in tree.leaves else sum(map(below, tree.children[node]), [])
    assert sorted(np.concatenate(list(tree.leaves.values())).tolist()) == list(range(500))
    for _ in range(20):
        item = rng.integers(0, 3, 50)
        own = np.flatnonzero(item)
        bound = tree.bounds(own, item[own])
        for node in range(len(bound)):
            for leaf in below(node):
                assert tree.scores(tree.leaves[leaf], item).max() <= bound[node]


def test_subtrees_are_pruned():
    """Groups of like documents that are far from an item are never scored."""
    rng = np.random.default_rng(6)
    rows = [np.array([0, 3, 5, 8, 13, 19]) + 20 * (k % 40) for k in range(4000)]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    tree = ball_tree.Tree(starts, np.concatenate(rows), rng.integers(900, 1000, starts[-1]), 800)
    item = np.zeros(800, dtype=np.int64)
    item[rows[7]] = 1
    own = np.flatnonzero(item)
    best = ball_tree.Best(10)
    best.search(tree, own, item[own], item, np.zeros(4000, bool), np.arange(4000))
    want = sorted(tree.scores(np.arange(4000), item).tolist())[-10:]
    assert sorted(x[0] for x in best.heap) == want and best.looked < 1000


def test_query(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ball_tree.ORACLE_SQL})").fetchall(), key=str)
    got = rows_of(ball_tree.query(spark, sf))
    docs, items = (list(map(tuple, spark.read.parquet(f"{sf}/{n}.parquet").select(i, "text").collect())) for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == want == brute(docs, items)
