"""Periodic runs against the definition, tried at every start and period."""

import hashlib
import random
from math import floor
from zlib import crc32

import numpy as np

from folioforge.llm import runs
from folioforge.llm.common import Words
from folioforge.llm.queries import op11_periodic_runs
from tests.llm.support import EDGE_TEXTS, edge_docs, no_docs


def brute_runs(words, least=6, exponent=4):
    """(start, length, period) of the longest stretches of each period, the smallest period of each only."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        for i in range(q, len(words) + 1):
            if i == len(words) or words[i] != words[i - q]:
                if i - start >= max(least, exponent * q):
                    found.setdefault((start, i - start), q)
                start = i - q + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def array_runs(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return [[tuple(r) for r in own.tolist()] for own in runs.runs_of_slice(Words(np.frombuffer(data, np.uint8), offsets), 6, 4)]


def random_words(rng):
    """Few letters, and pieces repeated several times over, nested in one another."""
    words = []
    for _ in range(rng.randrange(1, 6)):
        piece = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            piece = piece * rng.randrange(2, 6) + [rng.choice("abc")]
        words += piece * rng.randrange(1, 9) + [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
    return words


def test_runs_match_the_definition():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(600)]
    for first in range(0, len(texts), 50):
        part = texts[first : first + 50]
        # Further texts in the same slice share words with them and change nothing.
        for words, found in zip(part, array_runs([" ".join(w) + " " for w in part]), strict=True):
            assert found == brute_runs(words), words
    assert sum(bool(brute_runs(w)) for w in texts) > 300


def test_runs_of_one_word_and_of_long_periods():
    rng = random.Random(6)
    cases = [["a"] * n for n in (5, 6, 7, 500)]
    cases += [["b", *["a"] * 300, "b"] * 5, [f"w{i % 97}" for i in range(97 * 4 - 1)], [f"w{i % 97}" for i in range(97 * 4)], ["x", "y"] * 200 + ["x", "x"]]
    cases += [[rng.choice("ab") for _ in range(400)], [w for i in range(40) for w in ("line", "of", "words", "again", str(i))]]
    assert array_runs([" ".join(c) + "\n" for c in cases]) == [brute_runs(c) for c in cases]


def test_a_very_long_text_of_one_word():
    n = 200_000
    assert array_runs(["a " * n]) == [[(0, n, 1)]]


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + floor((n - a) / (3 + g % 8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    kept = b" ".join(brute_collapse(words, found))
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *strongest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_matches_brute_force_on_every_document(spark):
    folder = "/root/testdata/sf0.001"
    found = op11_periodic_runs(spark, folder).select(COLUMNS).collect()
    # Long periods cost the plain version time in proportion to their number, so long texts are tried on fewer of them.
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in docs if len((t or "").split()) <= 3000}
    assert len(found) == len(docs)
    assert ordered(r for r in found if r.doc_id in short) == ordered(expected_row(i, t) for i, t in docs if i in short)
    assert sum(r.n_runs > 0 for r in found) > 5


def test_edge_rows(spark):
    texts = [*EDGE_TEXTS, (11, "a a a a a a"), (12, "A a a a a a"), (11, "a a a a a a"), (13, "x y " * 9)]
    texts = [t for t in texts if t[0] != 5]
    found = runs.run_digest(runs.find_runs(runs.with_planted_runs(edge_docs(spark, texts))))
    assert ordered(found.select(COLUMNS).collect()) == ordered(expected_row(i, t) for i, t in texts)
    assert dict(found.dtypes) == {c: "string" if c.endswith("256") else "bigint" for c in COLUMNS}


def test_collapsed_text_and_spans(spark):
    docs = edge_docs(spark, [(1, "so  ha ha ha ha ha ha ha then"), (2, None)])
    rows = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    assert (rows[1].starts, rows[1].lengths, rows[1].periods, rows[1].collapsed) == ([1], [7], [1], "so ha then")
    assert (rows[2].starts, rows[2].collapsed) == ([], "")


def test_no_rows(spark):
    assert runs.run_digest(runs.find_runs(runs.with_planted_runs(no_docs(spark)))).collect() == []
