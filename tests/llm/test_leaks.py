"""Benchmark decontamination."""

import random

import numpy as np

from folioforge.llm import decontamination as dc
from tests.llm.support import EDGE_TEXTS, edge_docs, no_docs


def brute_alignment(item, words):
    best = 0
    above = [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words, 1):
            row.append(max(0, above[j - 1] + (dc.MATCH if a == b else dc.MISMATCH), above[j] + dc.GAP, row[-1] + dc.GAP))
        best = max(best, *row)
        above = row
    return best


def test_alignment_matches_the_definition():
    rng = np.random.default_rng(1)
    item = rng.integers(1, 6, 20).astype(np.uint64)
    found = rng.integers(1, 6, (30, 40)).astype(np.uint64)
    scores, ends = dc.align(item, found)
    for window, score, end in zip(found, scores, ends, strict=True):
        assert score == brute_alignment(item.tolist(), window.tolist())
        assert brute_alignment(item.tolist(), window[:end].tolist()) == score


def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = {i: [rng.choice(words) for _ in range(rng.randrange(16, 60))] for i in range(12)}

    def filler(n):
        return [rng.choice(words) for _ in range(n)]

    def edited(item):
        out = []
        for word in item:
            kind = rng.random()
            out += [] if kind < 0.04 else [word, "added"] if kind < 0.08 else ["changed"] if kind < 0.14 else [word]
        return out

    docs, expected = {}, set()
    for n in range(120):
        text = filler(rng.randrange(5, 80))
        if n % 3 == 0:
            # One item stands in a large part of all texts.
            item = 0 if n % 2 == 0 else rng.randrange(12)
            copy = items[item] if n % 4 else edited(items[item])
            text += copy + filler(rng.randrange(0, 40))
        docs[n] = " ".join(text)
        for i, item in items.items():
            if brute_alignment(item, text) / dc.MATCH >= max(dc.LEAST_WORDS, dc.LEAST_SIMILARITY * len(item)):
                expected.add((n, i))
    return docs, {i: " ".join(w).capitalize() + "." for i, w in items.items()}, expected


def test_leaks_match_aligning_everything(spark):
    docs, items, expected = planted()
    table = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = dc.find_leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    assert len(rows) == len(expected) and len(expected) > 35
    kept = {r.doc_id for r in dc.keep_clean(table, bench).collect()}
    assert kept == set(docs) - {d for d, _ in expected}


def test_copies_found_by_whichever_run_is_whole(spark):
    """Of one copy every fourth word is replaced, and no other text has its words; of the other only runs that are
    frequent in the corpus are whole."""
    lost = [f"q{i}" for i in range(16)]
    common = [f"c{i}" for i in range(16)]
    # In both halves the runs at 0, 1 and 2 are frequent, the others rare.
    texts = {i: " ".join(common[:5] + ["x"] + common[8:13]) for i in range(30)}
    texts |= {100: " ".join(common), 101: " ".join(common), 102: " ".join(common)}
    copies = {200: [f"r{i}" if i % 4 == 3 else w for i, w in enumerate(lost)], 201: [*common[:5], "y", "y", "y", *common[8:13]]}
    texts |= {i: " ".join(w) for i, w in copies.items()}
    items = {1: lost, 2: common}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    expected = {(d, i) for d, t in texts.items() for i, w in items.items() if brute_alignment(w, t.split()) / dc.MATCH >= max(dc.LEAST_WORDS, dc.LEAST_SIMILARITY * len(w))}
    assert {(200, 1), (201, 2)} <= expected
    found = {(r.doc_id, r.item_id): r.similarity for r in dc.find_leaks(docs, bench).collect()}
    assert set(found) == expected
    assert found[200, 1] == 21 / 32
    assert {r.doc_id for r in dc.keep_clean(docs, bench).collect()} == set(texts) - {d for d, _ in expected}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, expected = planted()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 500)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(table, bench).collect()} == expected


def test_edges(spark):
    bench = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "one two", 1), (None, "the same words stand here twice and are repeated on purpose", 1), (5, "a text without an id, in plain words", 1)],
        "item_id long, text string, doc_id int",
    )
    rows = dc.find_leaks(edge_docs(spark), bench).collect()
    assert sorted(((r.doc_id or 0), r.item_id or 0) for r in rows) == [(0, 5), (6, 0), (6, 0), (7, 0)]
    assert dc.find_leaks(no_docs(spark), bench).collect() == []
    assert dc.find_leaks(edge_docs(spark), bench.limit(0)).collect() == []
    assert dc.keep_clean(edge_docs(spark), bench).count() == len(EDGE_TEXTS) - 4
    assert dc.keep_clean(edge_docs(spark), bench).columns == edge_docs(spark).columns
