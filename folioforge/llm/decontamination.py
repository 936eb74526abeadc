"""Benchmark decontamination: seeds, then local alignment.

Every run of SEED words of the test items is a seed, looked up in all texts: whichever of them a copy has left whole,
it is found by. A seed's place in text and item tells where the item would lie in the text; that window, unless it has
too few of the item's words to hold it, is aligned with the item by Smith-Waterman over words, which scores copies with
replaced, added or missing words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import Words, annotate, identified, restored, slices, text_bytes, windows

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
# A text holds an item if the alignment has this share of the item's best score, and so many matched words' worth.
LEAST_SIMILARITY = 0.5
LEAST_WORDS = 8
# Items are taken in blocks of about so many bytes, each broadcast for one pass over the texts.
BLOCK_BYTES = 4 << 20
# What separates words: ASCII that is neither letter nor digit.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
FILTER = 1 << 20


def item_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), SEPARATORS).hashes()


class Items:
    """Words of a block of items, and the distinct runs of SEED words with where each stands."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [row[0] for row in rows]
        self.words = [item_hashes(row[1]) for row in rows]
        grams, places = [], []
        for number, words in enumerate(self.words):
            bounds = np.array([0, len(words)])
            own, starts = windows(words, bounds, SEED)
            grams.append(own)
            places += [(number, int(s)) for s in starts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.grams, self.number = np.unique(flat, return_inverse=True)
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.grams & np.uint64(FILTER - 1)).astype(np.int64)] = True
        self.seeds: list[list[tuple[int, int]]] = [[] for _ in self.grams]
        for place, gram in zip(places, self.number.tolist(), strict=True):
            self.seeds[gram].append(place)


def gram_hits(texts: list[str], items: Items) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, hash of each, and the places and numbers of the items' runs among them."""
    encoded = [t.lower().encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    words = Words(np.frombuffer(b"".join(encoded), np.uint8), offsets, SEPARATORS)
    hashes = words.hashes()
    grams, starts = words.grams(hashes, SEED)
    if not len(items.grams):
        return words, hashes, starts[:0], starts[:0]
    may = np.flatnonzero(items.filter[(grams & np.uint64(FILTER - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.grams, grams[may]), len(items.grams) - 1)
    hit = items.grams[at] == grams[may]
    return words, hashes, starts[may[hit]], at[hit]


def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column("text")
    for first, last in slices(text_bytes(texts)[1]):
        yield first, last, [t or "" for t in texts.slice(first, last - first).to_pylist()]


def align(item: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of an item with each of several windows (0: no word): scores and the words they end at."""
    best = np.zeros(len(found), np.int64)
    end = np.zeros(len(found), np.int64)
    above = np.zeros((len(found), found.shape[1] + 1), np.int64)
    ramp = -GAP * np.arange(found.shape[1] + 1)
    for word in item:
        row = np.zeros_like(above)
        diagonal = above[:, :-1] + np.where(found == word, MATCH, MISMATCH)
        row[:, 1:] = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
        # A gap in the item: the best cell to the left, less a step's cost for each column.
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(len(row)), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
        above = row
    return best, end


def leaks_of(texts: list[str], items: Items) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, similarity, last word) of the items that texts hold."""
    words, hashes, starts, numbers = gram_hits(texts, items)
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    rows = words.row_of(starts)
    for row, start, number in zip(rows.tolist(), starts.tolist(), numbers.tolist(), strict=True):
        for item, position in items.seeds[number]:
            slack = slack_of(len(items.words[item]))
            # Neighbouring diagonals share a window.
            found[item].add((row, (start - position) // slack))
    for item, places in found.items():
        own = items.words[item]
        slack = slack_of(len(own))
        width = len(own) + 3 * slack
        needed = min(len(own), max(LEAST_WORDS, LEAST_SIMILARITY * len(own)))
        ordered = sorted(places)
        step = max(1, 2_000_000 // width)
        best: dict[int, tuple[float, int]] = {}
        for first in range(0, len(ordered), step):
            part = np.array(ordered[first : first + step], np.int64)
            low, high = words.first[part[:, 0]], words.first[part[:, 0] + 1]
            columns = (part[:, 1] * slack - slack)[:, None] + np.arange(width)
            inside = (columns >= low[:, None]) & (columns < high[:, None])
            window = np.where(inside, hashes[np.clip(columns, 0, len(hashes) - 1)], np.uint64(0))
            # A word of the window matches once at most, and a score is no more than that of its matches.
            may = np.isin(window, own).sum(axis=1) >= needed
            part, columns, low, window = part[may], columns[may], low[may], window[may]
            if not len(part):
                continue
            scores, ends = align(own, window)
            for row, score, last in zip(part[:, 0].tolist(), scores.tolist(), (columns[:, 0] + ends - 1 - low).tolist(), strict=True):
                best[row] = max(best.get(row, (0.0, 0)), (score / (MATCH * len(own)), last))
        for row, (similarity, last) in best.items():
            if similarity * len(own) >= needed:
                yield row, item, similarity, last


def slack_of(length: int) -> int:
    return 4 + length // 4


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text)
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items that texts hold: (doc_id, item_id, similarity, last_word).

    ``similarity``: alignment score over that of the whole item; ``last_word``: where the aligned stretch ends, words
    counted from 0. Found are items of which half, and eight words, or all of a shorter one, are held. Items of fewer
    than three words, empty and null ones are never found, nor does a null text hold any. A repeated row gives its
    pairs again; null ids stay null.
    """
    spark: SparkSession = docs.sparkSession
    kind = "doc_id long, item_id long, similarity double, last_word long"

    def search(rows: list[tuple[int | None, str]]) -> DataFrame:
        items = Items(rows)
        shared = spark.sparkContext.broadcast(items)  # of one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, _, texts in pieces_of(batch):
                    found = [(ids[first + row], own.ids[item], s, last) for row, item, s, last in leaks_of(texts, own)]
                    if found:
                        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "last_word"])

        return identified(docs).mapInArrow(run, kind)

    return reduce(DataFrame.union, map(search, item_blocks(benchmark)), spark.createDataFrame([], kind))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item of the benchmark."""
    def judge_by(items: Items):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of one block

        def judge(texts: list[str]) -> list[pa.Array]:
            clean = np.ones(len(texts), bool)
            for row, *_ in leaks_of(texts, shared.value):
                clean[row] = False
            return [pa.array(clean)]

        return judge

    for rows in item_blocks(benchmark):
        docs = restored(annotate(docs, judge_by(Items(rows)), "clean boolean").where("clean"), docs)
    return docs
