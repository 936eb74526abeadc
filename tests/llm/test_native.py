"""Fingerprints from syncmers, licences and url filters: DataFrame operations only."""

import hashlib
import struct

import duckdb
import pytest
import xxhash

from folioforge.llm import fingerprints, licenses, url_filters
from folioforge.llm.oracles import ORACLES
from folioforge.llm.queries import QUERIES, URL_RULES
from tests.llm.support import EDGE_TEXTS, edge_docs, no_docs


def compare_with_sql(spark, name, table, rows, kinds):
    """Run a query and its SQL on a table of a few rows."""
    frame = rows.toPandas()
    connection = duckdb.connect()
    connection.register(table, frame)
    connection.execute(f"create view v as select {kinds} from {table}")
    sql = connection.sql(ORACLES[name].replace(f"from {table}", "from v"))
    return sorted((tuple(r) for r in sql.fetchall()), key=repr), list(sql.columns)


@pytest.mark.parametrize("name", ["op6_license_scan", "op8_url_filters"])
def test_given_tables_agree_with_sql(spark, name):
    import check

    folder = "/root/testdata/sf0.001"
    assert check.differences(spark, check.connect(folder), folder, name) == []


LICENCE_TEXTS = [
    (1, "Released under the MIT License. Under the mit-license! UNDER, THE; MIT: LICENSE"),
    (2, "under the mit licenses; cc by-nc, CC-BY-NC 4.0 and cc by, nc"),
    (3, "Apache License, Version 2.0 / apache license version 20 / apache license version 2"),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "work licensed under GNU General Public License, version 3"),
    (6, "mit license mit license under the mit license"),
    (7, "épapache license version 2 nc cc by"),
    (8, None),
    (9, ""),
    (10, "---"),
    (None, "cc by nc cc by nc"),
    (1, "Released under the MIT License. Under the mit-license! UNDER, THE; MIT: LICENSE"),
]


def test_licences_of_small_texts(spark):
    docs = edge_docs(spark, LICENCE_TEXTS + EDGE_TEXTS)
    found = licenses.license_digest(licenses.scan_licenses(docs))
    expected, columns = compare_with_sql(spark, "op6_license_scan", "documents", docs.select("doc_id", "text"), "cast(doc_id as bigint) as doc_id, text")
    assert sorted((tuple(None if v != v else v for v in r) for r in found.select(*columns).collect()), key=repr) == expected
    by_id = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(edge_docs(spark, LICENCE_TEXTS))).collect()}
    assert (by_id[1].n_base, by_id[1].first_word, by_id[1].base_labels) == (3, 1, "mit")
    assert by_id[4].base_labels == "" and by_id[4].labels == "gpl-3" and by_id[4].score == 1.0
    assert (by_id[8].n_words, by_id[8].n_base, by_id[8].first_word, by_id[8].labels) == (0, 0, None, "")
    assert by_id[None].n_base == 2
    assert licenses.scan_licenses(no_docs(spark)).collect() == []


def test_rare_words_lead_to_templates():
    entries = licenses.postings(licenses.BASE, {"mit": 3, "under": 900, "the": 999, "license": 40}, 1000)
    assert ("mit", 0, 2) in entries and len(entries) == 3


def test_notices_without_their_rarest_words(spark):
    """Words outside the key phrase that stand nowhere, or hardly anywhere, may be the ones a notice lacks."""
    texts = [
        (1, "redistribution and use in source and binary forms with the following changes"),
        (2, "some code here licensed under the gnu general public license version 3"),
        (3, "some code here licensed under the gnu general public license version 2"),
        (4, "see all of our terms of the mozilla public license version 2 0"),
        (5, "forms with"),
        *[(10 + i, "gnu mozilla general public license version 2 0 3 redistribution source binary use") for i in range(20)],
    ]
    docs = edge_docs(spark, texts)
    found = licenses.license_digest(licenses.scan_licenses(docs))
    expected, columns = compare_with_sql(spark, "op6_license_scan", "documents", docs.select("doc_id", "text"), "cast(doc_id as bigint) as doc_id, text")
    assert sorted((tuple(None if v != v else v for v in r) for r in found.select(*columns).collect()), key=repr) == expected
    labels = {r.doc_id: r.labels for r in found.collect()}
    assert [labels[i] for i in range(1, 6)] == ["bsd", "gpl-3", "gpl-2", "mpl-2", ""]


URLS = [
    "https://www.example.net/en/a?x", "https://example.net/en/", "https://example.net/en", "http://NET/", "http://a.net#x", "http://a.net",
    "https://notexample.net/en/1", "https://example.com/de/x#y", "https://sub.sub.example.com/de/", "https://example.com.evil/de/", "https://example.org/fr/",
    "https://org/fr/", "https://example.org:80/fr/", "no scheme", "", None, "x://", "https://user@example.net/en/x", "a://b://c.net/", "http://example.net./en/",
    "http://..net/x", "http://net?/x", "http://a.b.c.d.example.net/en/x",
]


def test_urls_against_sql_and_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, URLS[0], "x")], "page_id long, url string, host string")
    found = url_filters.filter_urls(pages, url_filters.rule_table(spark, URL_RULES))
    expected, columns = compare_with_sql(spark, "op8_url_filters", "pages", pages.select("page_id", "url"), "cast(page_id as bigint) as page_id, url")
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == expected


def test_nested_rules_across_ranges(spark):
    """Many hosts, rules at every depth, several ranges: each url against each rule."""
    rules = [("block", "t0", "/"), ("allow", "d1.t0", "/"), ("block", "d1.t0", "/x/"), ("allow", "s.d1.t0", "/x/"), ("block", "d5.t1", None), ("allow", "T2", "/y"), ("allow", "d1.t0", "/x/"), ("block", None, "/"), ("block", "", "/"), (None, "t3", "/")]
    urls = [f"http://{sub}d{d}.t{t}{path}" for sub in ("", "s.", "q.s.") for d in range(12) for t in range(4) for path in ("/", "/x/1", "/y")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filters.filter_urls(pages, url_filters.rule_table(spark, rules), default="allow").collect()

    def judge(host, path):
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in ((a, (h or "").lower(), p or "") for a, h, p in rules if a and h) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    assert len(found) == len(urls)
    assert all((r.rule, r.verdict) == judge(r.host, r.path) for r in found)
    nothing = url_filters.rule_table(spark, [("block", None, "/")])
    assert {r.verdict for r in url_filters.filter_urls(pages, nothing, default="block").collect()} == {"block"}
    assert url_filters.filter_urls(pages.limit(0), url_filters.rule_table(spark, rules)).collect() == []


def brute_sketch(text):
    def of_long(value, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed % (1 << 64))

    def chained(values, seed=42):
        for v in values:
            seed = of_long(v, seed)
        return seed

    def signed(v):
        return v - (1 << 64) if v >> 63 else v

    words = [signed(xxhash.xxh64_intdigest(w, seed=42)) for w in (text or "").encode().split()]
    anchors = set()
    for i in range(len(words) - 2):
        a, b, c = words[i : i + 3]
        if min(a, c) <= b:
            anchors.add(chained((a, b, c)) & 0xFFFFFFFF)
    if 0 < len(words) < 3:
        anchors.add(chained(words, xxhash.xxh64_intdigest(b"short", seed=42)) & 0xFFFFFFFF)
    return sorted(anchors)[:64]


def brute_likeness(a, b):
    union = sorted(set(a) | set(b))[:64]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def test_fingerprints_of_texts_and_edits(spark):
    texts = {i: t for i, t in EDGE_TEXTS if i is not None} | {20: " ".join(f"t{i}" for i in range(300)), 21: " ".join(f"t{i}" for i in range(310))}
    docs = edge_docs(spark, list(texts.items()))
    found = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, following = texts[i] or "", texts[after] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        own, other, nearby = brute_sketch(text), brute_sketch(edited), brute_sketch(following)
        row = found[i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert row.fingerprint == "".join(f"{x:08x}" for x in own)
        assert row.edited_fingerprint == "".join(f"{x:08x}" for x in other)
        assert row.near_edited == pytest.approx(brute_likeness(own, other))
        assert row.near_next == pytest.approx(brute_likeness(own, nearby))


def test_next_rows_with_null_and_repeated_ids(spark):
    rows = fingerprints.compare_edits(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS)
    # The null id comes last, its next is the largest id.
    alone = next(r for r in rows if r.doc_id is None)
    text = EDGE_TEXTS[0][1]
    n = len(text) // 3
    assert alone.edited_sha256 == hashlib.sha256((text[: len(text) - n] + dict(EDGE_TEXTS)[10][:n]).encode()).hexdigest()
    assert fingerprints.compare_edits(no_docs(spark)).collect() == []
    single = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    assert fingerprints.compare_edits(single).first().near_next == 1.0


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "before it " + passage), (2, passage + " after it all")], "doc_id long, text string")
    left, right = (r.anchors for r in fingerprints.fingerprint(docs).orderBy("doc_id").collect())
    inner = {(a.position - 2, a.hash) for a in left if a.position >= 2}
    assert inner == {(a.position, a.hash) for a in right if a.position <= 47}
    pair = spark.createDataFrame([(left, right)], "l array<struct<position:int,hash:bigint>>, r array<struct<position:int,hash:bigint>>")
    matched = pair.select(fingerprints.matched_anchors(pair.l, pair.r).alias("m")).first().m
    assert matched and {m.left - m.right for m in matched} == {2}


def test_native_plans_hold_no_python(spark):
    for name in ("op2_syncmer_fingerprints", "op6_license_scan", "op8_url_filters"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan, name
