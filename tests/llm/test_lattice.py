import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from twinweave.llm import lattice_lm as M

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["hello", "things", "\U00013000x", "日x", "the", "a", "zzzz", "größe"]


@pytest.fixture(scope="module")
def vocabulary():
    return M.vocabulary_at(PATH)


@pytest.fixture(scope="module")
def lattice(vocabulary):
    learned = [["hello", "other", "thing", "Straße", "ing", "the"], ["haus", "maus", "the"]]
    return vocabulary.lattice(M.shared(np.stack([vocabulary.segmented(x) for x in learned])))


def brute_paths(lattice, word, k):
    """(probability, pieces) of each segmentation under class k, by recursion."""
    known = dict(zip(lattice.pieces.names, lattice.logs[:, k].tolist(), strict=True))

    def paths(text):
        if not text:
            yield 1.0, ()
            return
        for n in range(1, len(text) + 1):
            p, name = known.get(text[:n]), text[:n]
            if p is None and n == 1:
                p, name = sum(lattice.byte[b, k] for b in text[0].encode()), None
            if p is not None:
                for q, rest in paths(text[n:]):
                    yield math.exp(p) * q, (name, *rest)

    return list(paths(lattice.mark + word))


def test_probability_is_the_sum_over_all_segmentations(lattice):
    found = lattice.log_probabilities(WORDS)
    for word, own in zip(WORDS, found, strict=True):
        for k in (0, 1):
            assert own[k] == pytest.approx(math.log(sum(q for q, _ in brute_paths(lattice, word, k))), abs=1e-9)


def test_probabilities_of_pieces_and_bytes_sum_to_one(lattice):
    assert np.exp(lattice.logs).sum(axis=0) + np.exp(lattice.byte).sum(axis=0) == pytest.approx([1.0, 1.0])


def test_expected_uses(lattice, vocabulary):
    words, want = ["hello", "thing", "\U00013000x"], Counter()
    for word in words:
        paths = brute_paths(lattice, word, 1)
        whole = sum(p for p, _ in paths)
        for p, pieces in paths:
            for piece in pieces:
                if piece is not None:
                    want[piece] += p / whole
    got = lattice.expected(words, 1)
    assert got[len(vocabulary.names) :].sum() == pytest.approx(4)
    for piece, uses in want.items():
        assert got[vocabulary.place[piece]] == pytest.approx(uses, abs=1e-9)


def test_very_long_and_many_words(lattice):
    words = ["ab" * 3000, *WORDS * 40]
    found = lattice.log_probabilities(words)
    assert np.isfinite(found).all() and np.allclose(found[1:9], found[-8:])


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", text.encode("utf-8").lower()), b"\n"]


def test_base_of_the_query(spark, sf):
    rows = {r.doc_id: r for r in M.query(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for d, t in texts.items():
        own, r = tokens(t), rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)


def brute_scores(texts, langs):
    """The whole model in plain Python, with all segmentations of each word listed."""
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    common = Counter(langs[d] for d in texts if not held[d])
    names = sorted(common, key=lambda x: (-common[x], x))[: M.CLASSES - 1]
    of = lambda d: names.index(langs[d]) if langs[d] in names else len(names)
    n_classes = len(names)
    counts = [Counter(w for d in texts if not held[d] and of(d) == k for w in tokens(texts[d])[:-1]) for k in range(n_classes)]
    ends = [sum(not held[d] and of(d) == k for d in texts) for k in range(n_classes)]
    vocabulary = M.vocabulary_at(PATH)
    uses = np.zeros((n_classes, vocabulary.size))
    for k in range(n_classes):
        for w in counts[k]:
            for p in vocabulary.model.encode(w.decode(), out_type=str):
                uses[k, vocabulary.place[p]] += 1
    for _ in range(M.ROUNDS):
        model, uses = vocabulary.lattice(M.shared(uses)), np.zeros_like(uses)
        for k in range(n_classes):
            for w in counts[k]:
                paths = brute_paths(model, w.decode(), k)
                for p, pieces in paths:
                    for piece in pieces:
                        uses[k, vocabulary.place[piece]] += p / sum(q for q, _ in paths)
    model, out = vocabulary.lattice(M.shared(uses)), {}
    for d, text in texts.items():
        each = []
        for k in range(n_classes):
            n, kinds = sum(counts[k].values()), Counter(counts[k].values())
            discount = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.5
            stop = (ends[k] + 1) / (n + ends[k] + 2)
            p = math.log((ends[k] + 0.1) / (sum(ends) + 0.1 * n_classes)) + math.log(stop)
            for w in tokens(text)[:-1]:
                pieces = sum(q for q, _ in brute_paths(model, w.decode(), k))
                pieces *= discount * len(counts[k]) / n if n else 1.0
                p += math.log((max(counts[k][w] - discount, 0.0) / n if n else 0.0) + pieces) + math.log(1 - stop)
            each.append(p)
        out[d] = float(np.logaddexp.reduce(each)) / math.log(10)
    return out


def test_scores_of_small_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_BYTES", 40)
    texts = {k: t for k, t in enumerate(["the cat sat", "the dog, the cat", "ein hund", "der hund und", "le chat", "", "the The cats", "hunde und cat"] * 2, 1)}
    langs = {k: "de" if "und" in t else "en" for k, t in texts.items()}
    rows = spark.createDataFrame([(k, t, langs[k]) for k, t in texts.items()], "doc_id long, text string, lang string")
    want = brute_scores(texts, langs)
    got = {r.doc_id: r.score for r in M.score(rows.repartition(3)).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_better_than_the_base_on_texts_not_learned(spark):
    rows = M.query(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum() and (rows.score > rows.base_score).mean() > 0.5


def test_odd_rows(spark, odd, docs):
    rows = M.score(odd).collect()
    assert len(rows) == 6 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    clash = odd.select("*", *[odd.text.alias(c) for c in ("chunk", "word", "docs", "times", "c0", "first", "place")])
    scores = lambda found: sorted(r.score for r in found)
    assert scores(M.score(clash).collect()) == pytest.approx(scores(rows))
    assert M.score(docs([])).count() == 0
