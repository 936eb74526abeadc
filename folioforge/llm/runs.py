"""Periodic runs of words: maximal pairs of the LCP-interval tree whose distance is short against what they share.

A run of period q is a stretch in which words q apart are identical, as long as neighbours allow. Its start s and s + q
share all words up to its end, and differ in the word before them: a maximal pair at distance q. The other way round, a
maximal pair that shares l words at distance q is such a stretch of q + l words. So runs are read off the pairs, and
nothing is extended. The pair meets in the interval of the tree whose value is l, where s and s + q come from different
children. Had s + q not the next position after s in that interval, the one between would give a smaller period; so
an interval's positions are one sorted list, each with the class of its left word beside it, and only neighbours of
different classes can be pairs. Lists are merged small into large.

Documents are independent of each other, and only suffixes enter the tree that share LEAST words with another one that
has a different left word: all pairs of an interval without such two have the same word before them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import Words, identified, mix, slices, text_bytes

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUNS = "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


class Interval:
    """An LCP interval that is not complete yet: its value, its positions in order, and pairs found while merging."""

    __slots__ = ("value", "positions", "pairs")

    def __init__(self, value: int, positions: list[int]):
        self.value, self.positions, self.pairs = value, positions, []

    def merge(self, child: list[int], left: list[int], least_length: int, exponent: int) -> None:
        """Take in the positions of a child; note pairs across the two that may be neighbours of different classes."""
        small, large = sorted((child, self.positions), key=len)
        most = self.value // (exponent - 1)
        for at in small:
            place = bisect_left(large, at)
            for near in large[max(place - 1, 0) : place + 1]:
                distance = abs(at - near)
                if distance <= most and distance + self.value >= least_length and left[at] != left[near]:
                    self.pairs.append((min(at, near), max(at, near)))
        if len(small) * 8 < len(large):
            for at in small:
                insort(large, at)
        else:
            large = sorted(large + small)
        self.positions = large

    def neighbours(self) -> Iterator[tuple[int, int]]:
        """The pairs with no position of the complete interval between them."""
        for a, b in self.pairs:
            if self.positions[bisect_left(self.positions, a) + 1] == b:
                yield a, b


def maximal_pairs(suffixes: list[int], shared: list[int], left: list[int], least: int, least_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, distance, shared words) of the pairs that are runs, by a walk up the LCP-interval tree.

    ``suffixes`` are positions in lexicographic order, ``shared[i]`` the words that suffixes i and i + 1 have in common.
    """
    open_intervals: list[Interval] = []
    done = suffixes[:1]
    for i in range(1, len(suffixes) + 1):
        value = shared[i - 1] if i < len(suffixes) else 0
        while open_intervals and open_intervals[-1].value > value:
            interval = open_intervals.pop()
            interval.merge(done, left, least_length, exponent)
            for a, b in interval.neighbours():
                yield a, b - a, interval.value
            done = interval.positions
        if value >= least:
            if open_intervals and open_intervals[-1].value == value:
                open_intervals[-1].merge(done, left, least_length, exponent)
            else:
                open_intervals.append(Interval(value, done))
        if i < len(suffixes):
            done = [suffixes[i]]


def suffix_ranks(words: np.ndarray, rows: np.ndarray, room: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4, ... words of every suffix, within its row, until the ``wanted`` ones differ.
    ``room`` is the number of words from a position to the end of its row."""
    _, rank = np.unique(words, return_inverse=True)
    _, rank = np.unique(rows * (int(rank.max()) + 1) + rank, return_inverse=True)
    ranks, width, total = [rank.astype(np.int32)], 1, len(words)
    while len(np.unique(rank[wanted])) < len(wanted):
        after = np.zeros(total, np.int64)
        inside = room > width
        after[inside] = rank[np.flatnonzero(inside) + width] + 1
        _, rank = np.unique(rank.astype(np.int64) * (total + 1) + after, return_inverse=True)
        ranks.append(rank.astype(np.int32))
        width *= 2
    return ranks


def common_words(ranks: list[np.ndarray], room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` (each another) have in common at their start."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        fits = (room[a] - out >= width) & (room[b] - out >= width)
        at = np.flatnonzero(fits)
        same = ranks[level][a[at] + out[at]] == ranks[level][b[at] + out[at]]
        out[at[same]] += width
    return out


def runs_of_slice(words: Words, least_length: int, exponent: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each row of a slice, in order of start and period."""
    # The shortest shared stretch of a run with the smallest period.
    least = min(max(least_length - q, (exponent - 1) * q) for q in range(1, least_length + 1))
    hashes = words.hashes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(words.rows)]
    grams, starts = words.grams(hashes, least)
    if len(starts) > 1:
        row = words.row_of(starts)
        # The word before a position; the start of a row is a class of its own.
        left = np.zeros(len(hashes), np.uint64)
        left[1:] = hashes[:-1]
        left[words.first[:-1][words.first[:-1] < len(hashes)]] = 0
        keys = mix(grams + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        own = left[starts[order]]
        several = np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)
        candidates = np.sort(starts[order[np.repeat(several, np.diff(np.append(cuts, len(order))))]])
        if len(candidates):
            collect(words, hashes, left, candidates, found, least, least_length, exponent)
    return [np.array(sorted(own, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3) for own in found]


def collect(words: Words, hashes, left, candidates, found, least: int, least_length: int, exponent: int) -> None:
    """Runs of the rows that have candidate suffixes, written to ``found``."""
    chosen = np.unique(words.row_of(candidates))
    sizes = words.first[chosen + 1] - words.first[chosen]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(begins[-1]) + np.repeat(words.first[chosen] - begins[:-1], sizes)
    rows = np.repeat(np.arange(len(chosen)), sizes)
    room = np.repeat(begins[1:], sizes) - np.arange(begins[-1])
    wanted = np.searchsorted(places, candidates)
    ranks = suffix_ranks(hashes[places], rows, room, wanted)
    order = wanted[np.argsort(ranks[-1][wanted])]
    shared = common_words(ranks, room, order[:-1], order[1:])
    for start, period, value in maximal_pairs(order.tolist(), shared.tolist(), left[places].tolist(), least, least_length, exponent):
        found[chosen[rows[start]]].append((start - int(begins[rows[start]]), period + value, period))


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words that are left when each run keeps its first period only, joined by one space."""
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(dropped[:-1]) == 0
    return b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode()


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Runs of words of each whole text, and the text with each run cut to its first period:
    (doc_id, starts, lengths, periods, collapsed), one row for each row of ``docs``, runs by start, then period.

    Words are separated by ASCII white space and compared as they are. A run is a stretch of at least ``least_length``
    words and ``exponent`` times its smallest period that no neighbouring word extends. Null, empty and blank texts have
    no words, no runs and an empty collapsed text; repeated rows are rows of their own, and a null doc_id stays null.
    ``exponent`` is 2 at least.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            data, offsets = text_bytes(texts)
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                own = data[bounds[0] : bounds[-1]]
                runs = runs_of_slice(Words(own, bounds - bounds[0]), least_length, exponent)
                plain = own.tobytes()
                collapsed = [
                    collapse(plain[b:e].split(), r) for b, e, r in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), runs, strict=True)
                ]
                lists = [pa.array([r[:, i] for r in runs], pa.list_(pa.int64())) for i in range(3)]
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *lists, pa.array(collapsed, pa.string())], ["doc_id", "starts", "lengths", "periods", "collapsed"])

    return identified(docs).mapInArrow(run, RUNS)


def run_digest(found: DataFrame) -> DataFrame:
    """The strongest run of each document (four nulls without one), and digests of all runs and of the collapsed text."""
    runs = F.arrays_zip("starts", "lengths", "periods")

    def stronger(best: Column, run: Column) -> Column:
        # length / period of two runs, compared without division; runs come by start, then period, so the first of equal ones stays.
        more = best.isNull() | (run["lengths"] * best["periods"] > best["lengths"] * run["periods"])
        return F.when(more, run).otherwise(best)

    kind = "struct<starts:bigint,lengths:bigint,periods:bigint>"
    best = found.withColumn("best", F.aggregate(runs, F.lit(None).cast(kind), stronger))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["starts"].cast("string"), r["lengths"].cast("string"), r["periods"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("starts").cast("long").alias("n_runs"),
        F.col("best.starts").alias("start"),
        F.col("best.lengths").alias("length"),
        F.col("best.periods").alias("period"),
        F.expr("1000 * best.lengths div best.periods").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with known repetitions: where h = crc32(doc_id) is a multiple of 10 and there are n words, every word
    from a = g % n on is the one of a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8), g = h // 10. Other texts stay as they are."""

    def planted(doc_id: int | None, text: str | None) -> str | None:
        h = 1 if doc_id is None else crc32(str(doc_id).encode())
        words = (text or "").encode().split() if h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        period = words[a : a + p]
        return b" ".join(words[:a] + (period * (-(-(n - a) // p)))[: n - a]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            if not any(i is not None and crc32(str(i).encode()) % 10 == 0 for i in ids.to_pylist()):
                yield batch
                continue
            texts = [planted(i, t) for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "text"])

    return identified(docs).mapInArrow(run, "doc_id long, text string")
