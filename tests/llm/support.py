"""Rows that any crawl may hold, and brute-force versions shared by the tests."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} número {i}" for i in range(30_000))
EDGE_TEXTS = [
    (None, "a text without an id, in plain words that nobody else has written down so far"),
    (1, None),
    (2, ""),
    (3, " \t\n  "),
    (4, "x"),
    (5, LONG),
    (6, "the same words stand here twice and are repeated on purpose, under the MIT License"),
    (6, "the same words stand here twice and are repeated on purpose, under the MIT License"),
    (7, "the same words stand here twice and are repeated on purpose, under the MIT License"),
    (8, "$$$ 123 !!! ###"),
    (9, "Ünïcödé ▁ text  with   markers \u3000 and 日本語 and 🙂🙂"),
    (-3, "a" * 5000),
    (10, "A.\nB\r\nC\x0bD\x0cE\tF"),
]


def edge_docs(spark, texts=EDGE_TEXTS):
    """Documents with null columns and further columns whose names clash with ones used inside."""
    rows = [(i, t, None if n % 2 else "en", None, None, f"k{n}", n, "clash", b"x") for n, (i, t) in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, bucket string, found binary"
    return spark.createDataFrame(rows, kinds)


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def components(nodes, linked):
    """Smallest reachable node, by following links until nothing changes."""
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(best[a], best[b])
            if best[a] != least or best[b] != least:
                best[a] = best[b] = least
                changed = True
    return best
