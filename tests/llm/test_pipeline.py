"""The pipeline's stages against brute force, and on rows of every kind."""

import re
from collections import Counter

import corpus_pipeline
from folioforge.llm import pieces, simhash
from folioforge.llm.queries import piece_model
from tests.llm.support import EDGE_TEXTS, components, edge_docs, no_docs
from tests.llm.test_simhash import brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def docs_of(spark):
    return edge_docs(spark, EDGE_TEXTS)


def words(text):
    return re.findall(r"\w+", text.lower())


def brute_cut(texts, width=corpus_pipeline.REPEATED_BYTES):
    seen = Counter()
    encoded = {i: t.encode() for i, t in texts.items()}
    for own in encoded.values():
        seen.update(own[i : i + width] for i in range(len(own) - width + 1))
    out = {}
    for i, own in encoded.items():
        marked = bytearray(len(own))
        for at in range(len(own) - width + 1):
            if seen[own[at : at + width]] > 1:
                marked[at : at + width] = b"\x01" * width
        kept = bytes(b for b, m in zip(own, marked, strict=True) if not m).decode(errors="ignore")
        if kept.split() or not any(marked):
            out[i] = kept
    return out


def shingles(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def links(narrow, wide, least):
    return [
        (a, b)
        for a in narrow
        for b in narrow
        if a < b and ((narrow[a] ^ narrow[b]).bit_count() <= 2 or len(wide[a] & wide[b]) >= least * len(wide[a] | wide[b]))
    ]


def test_run_matches_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in rows if any(c.isalpha() for c in r.text or "")}
    docs = spark.createDataFrame([r for r in rows if r.doc_id in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()}
    narrow = {i: brute_fingerprint(t) for i, t in texts.items()}
    wide = {i: shingles(t) for i, t in texts.items()}
    # Nothing below the share is grouped; of the pairs above it the bands may miss one in some thousand, and do not here.
    expected = components(list(texts), links(narrow, wide, simhash.LEAST_SHARE))
    assert kept == {i for i in texts if expected[i] == i}
    assert len(kept) < len(set(narrow.values()))
    texts = brute_cut({i: t for i, t in texts.items() if i in kept})
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(item in " ".join(words(t)) for item in items)}
    own = pieces.processor(piece_model())
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == set(texts)
    assert len(found) < len(rows)
    for i, text in texts.items():
        assert found[i].ids == own.encode(text)
        assert found[i].text == own.decode(own.encode(text))


def test_stages_on_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = docs.collect()
    # Null, blank and letterless texts went; of the three equal texts one stayed, with the smallest id.
    assert {r.doc_id for r in kept} == {None, 4, 5, 6, 9, 10}
    assert sum(r.doc_id == 6 for r in kept) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == len(kept)


def test_stages_without_rows(spark):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, no_docs(spark), FOLDER).collect() == []


def test_null_and_repeated_ids_stay_rows_of_their_own(spark):
    texts = [(None, "first text of its own kind"), (None, "second text, quite another"), (3, "third one here"), (3, "fourth one there, longer"), (None, "first text of its own kind")]
    docs = edge_docs(spark, texts)
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()) == sorted({t for _, t in texts})
    assert corpus_pipeline.repeated_text(spark, docs, FOLDER).count() == len(texts)
    # Null, blank, without letters, or of letters that no labelled row holds in a row.
    gone = {i for i, _ in EDGE_TEXTS} - {r.doc_id for r in corpus_pipeline.language_id(spark, docs_of(spark), FOLDER).collect()}
    assert gone == {1, 2, 3, 8, -3}
