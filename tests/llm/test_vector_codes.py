"""Vector codes against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np

from folioforge.llm import vector_codes as vc

KIND = "vec_id long, embedding array<float>, label int, code int, error string"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, step by step: {row number: (vec_id, code, error, label_error)} as a sorted list, and the codebooks."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, math.ceil(max(len(v) for _, v, _ in kept) / parts))
    cut = [[(v + [0] * (parts * width - len(v)))[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            chosen = [near(c[k], books[k])[1] for c in cut]
            own = {j: [c[k] for c, x in zip(cut, chosen, strict=True) if x == j] for j in set(chosen)}
            books[k] = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[k])]
    final = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    out = [(i, "".join(f"{j:02x}" for _, j in f), e, sum(x for x, r in zip(errors, kept, strict=True) if r[2] == label)) for (i, _, label), f, e in zip(kept, final, errors, strict=True)]
    return sorted(out, key=repr), books


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], KIND)
    coded, books = vc.encode(table, **options)
    found = vc.code_digest(coded, books).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=repr), {r.codebooks_sha256 for r in found}, books


def digest(books):
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def vectors(rng, n, width=64):
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_match_plain_arithmetic(spark):
    rows = vectors(random.Random(1), 300)
    found, digests, books = run(spark, rows)
    expected, plain = brute(rows)
    assert found == expected
    assert digests == {digest(plain)} and books.tolist() == plain


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(2)
    book = rng.integers(-100, 100, (64, 4))
    # Parts near to entries, repeated ones and exact ties.
    part = np.concatenate([book[rng.integers(0, 64, 500)] + rng.integers(-3, 4, (500, 4)), book, np.repeat(book[:1], 50, axis=0)])
    book[40] = book[3]
    pivots = vc.pick_pivots(book[None], 4)[0]
    kept = np.sqrt(vc.squared(part[:, None], pivots[None])).astype(np.float32).astype(np.float64)
    entry, best, evaluated = vc.nearest(part, kept, book, pivots)
    full = vc.squared(part[:, None], book[None])
    assert (entry == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert evaluated < full.size / 4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    rows = vectors(rng, 20, 32)
    rows += [(100, None, 1), (101, [0.5, None], 1), (102, [nan] * 32, 1), (103, [inf] * 32, 2), (104, [-inf], None)]
    # Equal ids, a null id, vectors of other lengths, one of none, exact copies, negative numbers between integers.
    rows += [(3, rows[4][1], 5), (3, rows[4][1], 5), (None, rows[2][1], None), (50, [0.25, -0.001], None), (51, [], 9), (52, [-1 / 512] * 33, 9)]
    found, digests, _ = run(spark, rows)
    expected, plain = brute(rows)
    assert found == expected and digests == {digest(plain)}
    assert len(found) == 26


def test_fewer_vectors_than_entries_and_none(spark):
    rows = vectors(random.Random(4), 5, 16)
    assert run(spark, rows)[0] == brute(rows)[0]
    found, digests, _ = run(spark, [(1, None, 2)])
    assert found == [] and digests == set()
    assert run(spark, [])[0] == []


def test_very_large_components_stay_within_range(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, 0) for i in range(3)]
    found, _, books = run(spark, rows, entries=1, rounds=1)
    assert len(found) == 3 and abs(books).max() <= vc.LARGEST
    assert all(error >= 0 for _, _, error, _ in found)


def test_one_label_and_one_vector_hold_most_rows(spark):
    rng = random.Random(5)
    rows = vectors(rng, 60, 16)
    rows += [(1000 + i, rows[0][1], 1) for i in range(600)]
    found, digests, _ = run(spark, rows)
    expected, plain = brute(rows)
    assert found == expected and digests == {digest(plain)}
