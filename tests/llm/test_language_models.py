"""Language ID, importance resampling, pieces."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import importance, langid, pieces
from folioforge.llm.queries import QUERIES, piece_model
from tests.llm.support import EDGE_TEXTS, edge_docs, no_docs

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(truth)
    judged = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert len(judged) > 200 and sum(judged) / len(judged) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_language_edges(spark):
    model = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", None), (None, "de")], "text string, lang string"))
    assert model.languages == ("en", "fr")
    rows = langid.identify(edge_docs(spark, [*EDGE_TEXTS, (50, "the dog"), (51, "le chien")]), model).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGE_TEXTS) + 2
    assert {found[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and found[1].score == 0
    assert (found[50].lang_pred, found[51].lang_pred) == ("en", "fr")
    assert langid.identify(no_docs(spark), model).collect() == []
    empty = langid.train(no_docs(spark))
    assert {r.lang_pred for r in langid.identify(edge_docs(spark), empty).collect()} == {"und"}


def test_more_than_eight_languages(spark):
    rows = [(f"q{chr(97 + i)}w{chr(97 + i)} z{chr(97 + i)}k{chr(97 + i)}", f"l{i:02d}") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.planes.shape[0] == 3
    number, _ = langid.score_texts([t for t, _ in rows], model)
    assert [model.languages[n] for n in number] == [lang for _, lang in rows]


def test_chance_hits_are_taken_off(spark):
    rng = np.random.default_rng(1)
    full = langid.LanguageFilter(("aa", "bb"), rng.integers(0, 2, (1, 1024)).astype(np.uint8) * 2)
    number, score = langid.score_texts(["some words of no language at all"], full)
    assert score[0] < 0.5
    assert full.false_hits()[0] == 0


def test_importance_against_direct_counts(spark):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(f"W{x}" for x in rng.integers(0, 40 if i % 2 else 400, rng.integers(1, 60))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 40)] + [(None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in importance.resample(docs, labels, 0.5).collect()}
    every, good = Counter(), Counter()

    def bucket(*words):
        own = np.frombuffer(" ".join(words).encode(), np.uint8)
        return importance.text_grams(own, np.array([0, len(own)]))[0].tolist()[-1]

    known = {}

    def grams(text):
        words = text.lower().split()
        found = [(w,) for w in words] + list(zip(words, words[1:], strict=False))
        return [known[g] if g in known else known.setdefault(g, bucket(*g)) for g in found]

    for i, text in texts.items():
        every.update(grams(text))
        if i < 40 and i % 2:
            good.update(grams(text))
    b = importance.BUCKETS

    def ratio(g):
        return math.log((good[g] + 1) / (sum(good.values()) + b)) - math.log((every[g] + 1) / (sum(every.values()) + b))

    off = [i for i, t in texts.items() if abs(rows[i].log_weight - 100 * np.mean([ratio(g) for g in grams(t)])) > 1e-6]
    assert off == []
    keys = sorted((r.key for r in rows.values()), reverse=True)
    assert {i for i, r in rows.items() if r.selected} == {i for i, r in rows.items() if r.key >= keys[39]}


def test_importance_prefers_good_texts(spark):
    rows = {r.doc_id: r.selected for r in QUERIES["op1_importance_resampling"](spark, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1 and not r.toxic]
    bad = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.9 > 0.2 > sum(bad) / len(bad)


def test_importance_edges(spark):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (None, 1, None, "x"), (4, None, None, None)], "doc_id long, quality int, toxic int, text string")
    rows = importance.resample(edge_docs(spark), labels).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert len({(r.key, r.selected) for r in rows if r.doc_id == 6}) == 1
    assert all(r.log_weight == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert importance.resample(no_docs(spark), labels).collect() == []
    assert len(importance.resample(edge_docs(spark), labels.limit(0)).collect()) == len(EDGE_TEXTS)


def test_threshold_is_exact(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.concatenate([rng.normal(size=500), rng.normal(size=5) * 1e6, [1.25] * 40])]
    keyed = spark.createDataFrame([(v,) for v in values], "key double")
    for share in (0.01, 0.5, 0.9, 1.0):
        limit = importance.threshold(keyed, share)
        wanted = sorted(values, reverse=True)[max(1, round(share * len(values))) - 1]
        assert [v for v in values if v >= limit] == [v for v in values if v >= wanted]


def check_pieces(texts, rows):
    own = pieces.processor(piece_model())
    for text, row in zip(texts, rows, strict=True):
        ids = own.encode(text or "")
        assert row.ids == ids, text
        assert row.text == own.decode(ids)


def test_pieces_of_edge_texts(spark):
    docs = edge_docs(spark)
    model = piece_model()
    rows = pieces.decode(pieces.encode(docs.coalesce(1), model), model).collect()
    check_pieces([t for _, t in EDGE_TEXTS], rows)
    digest = pieces.piece_digest(pieces.decode(pieces.encode(docs.coalesce(1), model), model)).collect()
    assert digest[1].n_tokens == 0 and digest[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encode(no_docs(spark), model).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, model).first().text == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ▁.\n\té日🙂\u3000\x00<s>/1")), max_size=30), max_size=5))
def test_chunks_join_to_what_the_library_gives(texts):
    model = piece_model()
    ids, bounds = pieces.ChunkTable(model).encode(texts)
    own = pieces.processor(model)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [own.encode(t) for t in texts]


def test_a_small_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 3)
    table = pieces.ChunkTable(piece_model())
    for text in ("one two three four five", "six seven one", "one"):
        ids, _ = table.encode([text])
        assert ids.tolist() == pieces.processor(piece_model()).encode(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "▁", "▁▁a ▁"])
def test_lone_markers(text):
    ids, _ = pieces.ChunkTable(piece_model()).encode([text])
    assert ids.tolist() == pieces.processor(piece_model()).encode(text)
