"""Removal of repeated bytes and of repeated word runs, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from folioforge.llm import debruijn, suffixes
from folioforge.llm.common import minimizers, slices, window_starts
from tests.llm.support import EDGE_TEXTS, edge_docs, no_docs


def brute(tokens_of, texts, width):
    """Marks of the tokens covered by a repeated window."""
    seen = {}
    for text in texts:
        tokens = tokens_of(text)
        for i in range(len(tokens) - width + 1):
            window = tuple(tokens[i : i + width])
            seen[window] = seen.get(window, 0) + 1
    out = []
    for text in texts:
        tokens = tokens_of(text)
        marked = [False] * len(tokens)
        for i in range(len(tokens) - width + 1):
            if seen[tuple(tokens[i : i + width])] > 1:
                marked[i : i + width] = [True] * width
        out.append((tokens, marked))
    return out


def as_bytes(text):
    return (text or "").encode()


def as_words(text):
    return (text or "").encode().split()


def mutated(rng, passage):
    position = rng.randrange(len(passage))
    return passage[:position] + rng.choice("xyzé") + passage[position + 1 :]


def corpus(seed, unit):
    """Texts of own and shared passages, at all offsets, some shared ones altered in one place."""
    rng = random.Random(seed)
    words = ["of", "the", "réel", "a", "stone", "it", "ß", "hollow"]

    def passage(size):
        return " ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(50))]) for _ in range(size))

    shared = [passage(rng.randrange(unit // 2, 3 * unit)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice([passage(rng.randrange(1, unit)), rng.choice(shared), mutated(rng, rng.choice(shared))])
            parts.append(own)
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[0], texts[0], "ab" * 600, None, ""]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes_match_brute_force(spark, seed):
    texts = corpus(seed, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in suffixes.repeated_bytes(docs, 300).collect()}
    for i, (tokens, marked) in enumerate(brute(as_bytes, texts, 300)):
        kept = bytes(t for t, m in zip(tokens, marked, strict=True) if not m)
        runs = sum(m and not (j and marked[j - 1]) for j, m in enumerate(marked))
        row = found[i]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(tokens), sum(marked), runs), i
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_words_match_brute_force(spark, seed):
    texts = corpus(seed, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in debruijn.repeated_words(docs, k=8, anchor=3).collect()}
    for i, (tokens, marked) in enumerate(brute(as_words, texts, 8)):
        kept = b" ".join(t for t, m in zip(tokens, marked, strict=True) if not m)
        row = found[i]
        assert (row.n_words, row.n_removed) == (len(tokens), sum(marked)), i
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert sum(e - b for b, e in zip(row.starts, row.ends, strict=True)) == row.n_removed


def test_a_hot_passage_and_small_tasks(spark, monkeypatch):
    """A passage in a third of all texts, with buckets and tasks that hold a few keys only."""
    from folioforge.llm import repeats

    monkeypatch.setattr(repeats, "TASK_KEYS", 50)
    monkeypatch.setattr(debruijn, "BUCKET_KEYS", 100)
    monkeypatch.setattr(suffixes, "BUCKET_KEYS", 100)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    rng = random.Random(5)
    hot = " ".join(f"h{rng.randrange(10**6)}" for _ in range(80))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + " " + (hot if i % 3 == 0 else "") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    words = {r.doc_id: r.n_removed for r in debruijn.repeated_words(docs).collect()}
    spans = {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(docs).collect()}
    for i, (_, marked) in enumerate(brute(as_words, texts, 35)):
        assert words[i] == sum(marked)
    for i, (_, marked) in enumerate(brute(as_bytes, texts, 400)):
        assert spans[i] == sum(marked)


@pytest.mark.parametrize("find", [suffixes.repeated_bytes, debruijn.repeated_words])
def test_edges(spark, find):
    rows = find(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in EDGE_TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_removed == by_id[2].n_removed == by_id[4].n_removed == 0
    assert by_id[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert find(no_docs(spark)).collect() == []


def test_equal_texts_are_removed_whole(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text)], "doc_id long, text string")
    assert {r.n_removed for r in debruijn.repeated_words(docs).collect()} == {120}
    assert [r.n_removed for r in suffixes.repeated_bytes(docs).collect()] == [len(text)] * 3


def test_every_difference_is_covered_once():
    for period, cover in suffixes.COVERS.items():
        found = sorted((a - b) % period for a in cover for b in cover if a != b)
        assert found == list(range(1, period))
    assert [suffixes.period_of(n) for n in (400, 368, 367, 230, 228, 227, 152)] == [273, 273, 133, 133, 133, 57, 57]
    with pytest.raises(ValueError, match="too short"):
        suffixes.period_of(151)


def test_smallest_of_each_window():
    values = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64) << np.uint64(40)
    assert minimizers(values, 9).tolist() == [i + int(np.argmin(values[i : i + 9])) for i in range(492)]
    assert minimizers(values[:3], 9).tolist() == []


def test_windows_stay_within_rows():
    first = np.array([0, 0, 3, 10, 10, 15])
    assert window_starts(first, 4).tolist() == [3, 4, 5, 6, 10, 11]
    assert list(slices(np.array([0, 5, 9, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
