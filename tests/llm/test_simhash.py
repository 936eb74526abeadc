"""Fingerprints, links and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import simhash
from tests.llm.support import EDGE_TEXTS, components, edge_docs, no_docs


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(value):
    return value % (1 << 64)


def brute_components(prints):
    """prints: {doc_id: fingerprint} -> {doc_id: smallest reachable doc_id}"""
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return components(ids, linked)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_match_the_definition(spark):
    docs = edge_docs(spark)
    found = [(r.doc_id, unsigned(r.fp)) for r in simhash.fingerprints(docs).collect()]
    assert sorted(found, key=str) == sorted([(i, brute_fingerprint(t)) for i, t in EDGE_TEXTS], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_match_brute_force(spark, seed):
    """Chains and clusters: steps of one and two bits, also three in one byte apart, and a cluster of many."""
    rng = random.Random(seed)
    values = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            values.add(value)
            for _ in range(rng.choice([1, 2, 2, 3])):
                value ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(16)}
    prints = dict(enumerate(sorted(values)))
    table = spark.createDataFrame([(signed(v),) for v in prints.values()], "fp long")
    found = {frozenset((unsigned(r.a), unsigned(r.b))) for r in simhash.links(table).collect()}
    expected = {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert found == expected
    edges = spark.createDataFrame([tuple(sorted(map(signed, e))) for e in found], "a long, b long")
    grouped = {r.node: r.component for r in simhash.components(edges).collect()}
    nodes = {signed(x) for e in found for x in e}
    assert grouped == components(nodes, [tuple(map(signed, e)) for e in found])


def test_groups_of_texts(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    # A chain of small edits, of which neighbours may link though the ends do not.
    texts, current = {}, base.split()
    for i in range(25):
        texts[100 - i] = " ".join(current)
        current = list(current)
        current[rng.randrange(len(current))] = f"edit{i}"
    texts |= {1: None, 2: " ", 3: "", 200: base, 201: base.upper()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.fingerprint_digits(simhash.near_duplicates(docs)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(prints)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert found[1].component_id == found[2].component_id == found[3].component_id == 1
    assert len(set(expected.values())) < len(set(prints.values()))


def test_edges(spark):
    rows = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS)
    same = {r.component_id for r in rows if r.doc_id in (6, 7)}
    assert same == {6}
    assert simhash.near_duplicates(no_docs(spark)).collect() == []


def test_entries_of_many_fingerprints_link_by_lookup():
    values = np.arange(400, dtype=np.uint64) * np.uint64(3)
    found = {frozenset((int(a), int(b))) for x, y in simhash.links_within(values, (0, 1)) for a, b in zip(x, y, strict=True)}
    assert found == {frozenset((int(a), int(b))) for a in values for b in values if a < b and (int(a) ^ int(b)).bit_count() <= 2}


def similar(a, b):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_similar_texts_are_found_and_others_left(spark):
    rng = random.Random(8)
    texts = {}
    for family in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts[family * 100] = " ".join(base)
        for copy in range(1, 6):
            words = list(base)
            for _ in range(max(1, len(words) * copy // 250)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts[family * 100 + copy] = " ".join(words)
        # Half of it stands in another text.
        texts[family * 100 + 50] = " ".join(base[: len(base) // 2] + [f"own{rng.randrange(10**6)}" for _ in base])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    near = [(a, b) for f in range(30) for a in range(f * 100, f * 100 + 6) for b in range(a + 1, f * 100 + 6)]
    high = [found[a] == found[b] for a, b in near if similar(texts[a], texts[b]) >= 0.85]
    assert len(high) > 150 and sum(high) / len(high) > 0.97
    assert all(c // 100 == i // 100 for i, c in found.items())
    assert all(found[f * 100 + 50] == f * 100 + 50 for f in range(30))


def test_wide_edges(spark):
    rows = simhash.similar_texts(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[6] == by_id[7] == 6 and by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == 4
    assert simhash.similar_texts(no_docs(spark)).collect() == []
    assert simhash.all_near_duplicates(no_docs(spark)).collect() == []


def test_texts_below_the_share_stay_apart(spark):
    """Pairs on either side of the share, near each other by fingerprint."""
    rng = random.Random(12)
    texts = {}
    for family in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts[10 * family] = " ".join(base)
        for copy, edits in enumerate((3, 6, 8, 10), 1):
            words = list(base)
            for at in rng.sample(range(0, 300, 5), edits):
                words[at] = f"edit{rng.randrange(10**6)}"
            texts[10 * family + copy] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    every = [(a, b) for f in range(60) for a in range(10 * f, 10 * f + 5) for b in range(a + 1, 10 * f + 5)]
    expected = components(list(texts), [(a, b) for a, b in every if similar(texts[a], texts[b]) >= simhash.LEAST_SHARE])
    assert all(found[a] != found[b] for a, b in every if expected[a] != expected[b])
    together = [found[a] == found[b] for a, b in every if expected[a] == expected[b]]
    assert len(together) > 60 and sum(together) / len(together) > 0.9
    assert sum(expected[a] != expected[b] for a, b in every) > 60


def test_ids_are_packed_and_unpacked():
    assert simhash.whole(simhash.halves(np.array([1, 2**40 + 3]))).tolist() == [1, 2**40 + 3]


def family(templates, copies):
    """Many copies of each template, most of them just too unlike each other; some pairs and chains among them are alike."""
    rng = random.Random(21)
    texts = {}
    for t in range(templates):
        base = [f"w{t}x{i}" for i in range(150)]
        for n in range(t * copies, t * copies + copies):
            words = list(base)
            for at in rng.sample(range(2, 148, 5), 2 if n % 10 == 0 else 4):
                words[at] = f"own{n}x{at}"
            texts[2 * n] = " ".join(words)
            if n % 5 == 0:
                words[rng.randrange(150)] = f"other{n}"
                texts[2 * n + 1] = " ".join(words)
    return texts


def brute_links(texts, least):
    ids = sorted(texts)
    own = {i: {hash(tuple(t.split()[k : k + 5])) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    spread = Counter(s for shingles in own.values() for s in shingles)
    number = {s: k for k, s in enumerate(sorted(s for s, n in spread.items() if n > 1))}
    held = np.zeros((len(ids), len(number)), np.float32)
    for row, i in enumerate(ids):
        held[row, [number[s] for s in own[i] if s in number]] = 1
    sizes = np.array([len(own[i]) for i in ids], np.float32)
    out = []
    for first in range(0, len(ids), 1000):
        common = held[first : first + 1000] @ held.T
        alike = np.triu(common >= least * (sizes[first : first + 1000, None] + sizes - common), first + 1)
        out += [(ids[first + a], ids[b]) for a, b in zip(*np.nonzero(alike), strict=True)]
    return out


@pytest.mark.parametrize(("templates", "copies"), [(1, 1100), (2, 1100)])
def test_families_of_unlike_copies(spark, templates, copies):
    """Of the pairs that brute force finds at 0.8 or more, nine of ten end up in one group, and no others do."""
    texts = family(templates, copies)
    linked = brute_links(texts, simhash.LEAST_SHARE)
    expected = components(sorted(texts), linked)
    assert len(linked) > copies / 5 and len(set(expected.values())) > copies / 11
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    together = [found[a] == found[b] for a, b in linked]
    assert sum(together) >= 0.9 * len(together)
    assert all(expected[found[i]] == expected[i] for i in found)


def test_no_pair_of_a_large_family_is_left_out(spark, monkeypatch):
    """Groups are those of brute force, also where neither text of a pair is a representative and an entry takes several cells."""
    texts = family(1, 1100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = components(sorted(texts), brute_links(texts, simhash.LEAST_SHARE))
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == expected
    monkeypatch.setattr(simhash, "CELL_TEXTS", 40)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == expected


def test_sketches_differ_in_no_more_bits_than_shingles():
    rng = np.random.default_rng(5)
    for common, own in ((500, 3), (100, 40), (3000, 900), (0, 1)):
        drawn = np.unique(rng.integers(0, 2**63, common + 2 * own, np.int64).astype(np.uint64))
        a, b = drawn[: common + own], np.concatenate([drawn[:common], drawn[common + own :]])
        x, y = (np.frombuffer(simhash.parities(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_all_texts_that_meet_a_task_that_holds_texts_back_are_crowded(spark):
    """A text alone in its task meets four of the twenty texts that another task holds."""
    bands = np.arange(simhash.BANDS, dtype=np.uint64).tobytes()
    one = spark.createDataFrame([(i, 100, bytearray(bands)) for i in range(20)], "id long, size int, bands binary").coalesce(1)
    other = spark.createDataFrame([(99, 100, bytearray(bands))], "id long, size int, bands binary").coalesce(1)
    found = simhash.found_pairs(one.union(other), 1, 2, simhash.LEAST_SHARE).where("a = b")
    assert {r.a for r in found.collect()} == {*range(20), 99}


def made_pairs(classes):
    """Rows of the second level of bands, and its pairs of different texts."""
    found = simhash.found_pairs(classes, 2, 2, simhash.LEAST_SHARE).collect()
    return len(found), {(r.a, r.b) for r in found if r.a != r.b}


def test_higher_levels_make_no_pair_that_sketches_rule_out(spark):
    """Of a family of mostly unlike copies; no pair that links is lost, and four times the texts make about four times the rows."""
    rows = {}
    for copies in (150, 600):
        texts = family(1, copies)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        classes = simhash.shingle_bands(docs).withColumnRenamed("doc_id", "id").select("id", "size", "bands", "sketch").cache()
        held = {r.id: (r.size, np.frombuffer(r.sketch, np.uint64)) for r in classes.collect()}
        allowed = (1 - simhash.LEAST_SHARE) / (1 + simhash.LEAST_SHARE)
        every = made_pairs(classes.withColumn("sketch", F.lit(bytes(simhash.SKETCH_BITS // 8))))[1]
        rows[copies], pairs = made_pairs(classes)
        near = {(a, b) for a, b in every if np.bitwise_count(held[a][1] ^ held[b][1]).sum() <= allowed * (held[a][0] + held[b][0]) + 1e-6}
        assert pairs == near
        linked = set(brute_links(texts, simhash.LEAST_SHARE))
        assert {tuple(sorted(p)) for p in pairs} & linked == {tuple(sorted(p)) for p in every} & linked
        assert len(pairs) < 0.5 * len(every)
        classes.unpersist()
    assert rows[600] < 6 * rows[150]
