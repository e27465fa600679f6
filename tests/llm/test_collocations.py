import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from twinweave.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, threshold, listed=2000):
    """docs: (lang, text) pairs."""
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for k in range(len(words) - n + 1):
                    counts[lang, tuple(words[k : k + n])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= threshold}
    rows = {}
    for (lang, words), a in found.items():
        longer = [b for (other, whole), b in found.items() if other == lang and len(whole) > len(words) and any(whole[k : k + len(words)] == words for k in range(len(whole)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * total[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, own in rows.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:listed], 1)
    )


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def random_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "Éa", "x\x85y", "日本", "w\x1cz", *[f"w{k}" for k in range(20)]]
    gaps = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "! ", "\r\n"]
    text = lambda: "".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]
    return docs + [("en", "Same old story, told again and again")] * 30 + [("fr", None), ("fr", "")]


def made(spark, docs):
    return spark.createDataFrame([(k, text, lang, "s", 0) for k, (lang, text) in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize("seed, threshold, listed", [(1, 5, 2000), (2, 12, 2000), (3, 2, 9)])
def test_against_brute_force(spark, monkeypatch, seed, threshold, listed):
    for name, value in (("CHUNK_BYTES", 700), ("PART_MASS", 900), ("MERGED", 50), ("ROW_KEYS", 7), ("HELD", 30)):
        monkeypatch.setattr(collocations, name, value)
    docs = random_docs(seed)
    assert rows_of(collocations.ranked(made(spark, docs), threshold, listed)) == brute(docs, threshold, listed)


def test_one_chunk(spark):
    docs = random_docs(4)
    assert rows_of(collocations.ranked(made(spark, docs), 4)) == brute(docs, 4)


def test_odd_rows(spark, odd, docs):
    rows = odd.collect()
    assert rows_of(collocations.ranked(odd, 2)) == brute([(r.lang, r.text) for r in rows], 2)
    assert collocations.ranked(docs([])).count() == 0
    assert collocations.ranked(docs([(1, None), (2, "... !")])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_frequent_keys_survive_any_merging(seed):
    rng = np.random.default_rng(seed)
    keys = np.minimum(rng.zipf(1.3, 5000), 3000).astype(np.uint64)
    true, threshold = Counter(keys.tolist()), 40
    parts = [collocations.Summary(len(keys) // threshold + 1) for _ in range(4)]
    for own, some in zip(parts, np.array_split(keys, 4), strict=True):
        for few in np.array_split(some, 9):
            own.merge(*np.unique(few, return_counts=True))
    whole = parts[0]
    for x in parts[1:]:
        whole.merge(x.keys, x.counts, x.lost)
    assert len(whole.keys) <= whole.capacity and whole.lost < threshold
    assert {k for k, n in true.items() if n >= threshold} <= set(whole.reaching(threshold).tolist())
    for k, n in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True):
        assert n <= true[k] <= n + whole.lost


def test_counts_of_any_size_are_summed():
    for large in (5, 1 << 30):
        keys, counts = collocations.summed(np.array([7, 3, 7, 3, (1 << 40) - 1], np.uint64), np.array([1, large, 2, 4, 1]))
        assert keys.tolist() == [3, 7, (1 << 40) - 1] and counts.tolist() == [large + 4, 3, 1]


def test_packed_numbers():
    for values in ([], [0], [5, 0, 1 << 63, (1 << 64) - 1], list(range(300))):
        assert collocations.unpacked(collocations.packed(np.array(values, np.uint64))).tolist() == values


def test_packed_text():
    for lines in ([""], ["a b", "é 日本"], ["x"] * 1000):
        assert collocations.unpacked_text(collocations.packed_text(lines)) == lines


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.ORACLE_SQL})").fetchall()
    got = rows_of(collocations.query(spark, sf))
    assert len(got) > 20 and got == sorted(want)
