import random
import tracemalloc

import numpy as np

from twinweave.llm import decontaminate as D

LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def prose(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice(LETTERS)
        elif kind < 0.7:
            out.insert(at, rng.choice(LETTERS))
        else:
            del out[at]
    return "".join(out)


def brute_edits(segment, text):
    """Least edits between the segment and any part of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    for k, c in enumerate(segment):
        new = np.empty_like(row)
        new[0] = k + 1
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([x != c for x in text], dtype=int))
        for j, b in enumerate(best):
            new[j + 1] = min(b, new[j] + 1)
        row = new
    return int(row.min())


def test_every_segment_within_its_budget_is_found():
    rng = random.Random(0)
    items = [(k, prose(rng, rng.choice([30, 64, 100, 180]))) for k in range(12)]
    index = D.Index(items)
    texts = []
    for k in range(24):
        parts = [prose(rng, rng.randrange(0, 200))]
        if k % 3:
            parts += [edited(rng, items[k % 12][1], k % 7), prose(rng, 90)]
        texts.append("".join(parts))
    found = index.search(texts)
    for text, own in zip(texts, found, strict=True):
        codes = D.folded(text)[0].tolist()
        want = {
            index.items[s]
            for s in range(len(index.items))
            if brute_edits(index.codes[s, : index.lengths[s]].tolist(), codes) <= index.edits[s]
        }
        assert {x[0] for x in own} == want


def test_spans_case_and_marks():
    item = "The quick brown fox jumps over the lazy dog and runs far away from here, said the old man quietly."
    text = "Before. " + item.upper().replace(" ", "!! ") + " After it all."
    ((span,),) = D.Index([(7, item)]).search([text])
    assert span[0] == 7 and span[3] == 0 and "QUICK" in text[span[1] : span[2]] and "After" not in text[span[1] : span[2]]
    assert text[span[1] : span[2]].startswith("THE") and text[span[1] : span[2]].endswith("QUIETLY")


def test_neighbouring_texts_do_not_mix():
    item = "one passage that is cut in two by the end of a document and must not be found there at all"
    index = D.Index([(1, item)])
    assert index.search([item[:45], item[45:]]) == [[], []]


def test_short_items_are_found_as_whole_words():
    index = D.Index([(1, "Paris"), (2, "forty-two"), (3, "What is the time?"), (4, "?!"), (5, "a")])
    texts = ["It was in PARIS.", "comparison", "Forty two of them", "what is the time", "paris", "x" + "a" * 30, "b a b", "Paris" + D._NONE + "a"]
    found = [{x[0] for x in own} for own in index.search(texts)]
    assert found == [{1}, set(), {2}, {3}, {1}, set(), {5}, {1, 5}]
    (span,) = index.search(["It was in PARIS."])[0]
    assert span == (1, 10, 15, 0)


def test_excerpts_are_found_wherever_they_begin():
    rng = random.Random(3)
    item = prose(rng, 400)
    index = D.Index([(1, item)])
    assert all(index.search([f"zzz {item[k : k + 75]} zzz"])[0] for k in range(300))


def test_marks_beyond_the_basic_plane_do_not_hide_a_passage():
    item = "The quick brown fox jumps over the lazy dog and runs far away from here, said the old man quietly."
    assert D.Index([(1, item)]).search([item.replace(" ", " \U0001f600 ")])[0]


def test_odd_rows(spark, odd, docs):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "word " * 30)], "item_id long, text string")
    rows = {(r.doc_id, r.text is None): r for r in D.searched(odd, bench).drop("leaks_").collect()}
    assert [x.item_id for x in rows[3, False].leaks] == [1] and rows[1, True].leaks == [] and [x.item_id for x in rows[4, False].leaks] == [-1]
    assert D.clean(odd, bench).count() == 3 and D.clean(odd, bench).columns == odd.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.clean(odd, none).count() == 6 and D.searched(docs([]), bench).count() == 0


def test_slices_find_the_same(spark, sf, monkeypatch):
    whole = {r.doc_id: r.item_ids for r in D.query(spark, sf).collect()}
    assert any(whole.values())
    monkeypatch.setattr(D, "SLICE_CHARS", 2000)
    assert {r.doc_id: r.item_ids for r in D.query(spark, sf).collect()} == whole


def test_many_texts_are_searched_within_little_memory():
    rng = random.Random(5)
    index = D.Index([(k, prose(rng, 200)) for k in range(5)])
    texts = [prose(rng, 2000) for _ in range(600)]
    index.search(texts[:1])
    tracemalloc.start()
    index.search(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000
