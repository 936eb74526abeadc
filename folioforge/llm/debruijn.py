"""Substring dedup by words: repeated paths of a graph of word k-mers.

Every run of K words is an edge of the graph, from its first K - 1 words to its last; a repeated edge is one that
stands at two coordinates or more. Only edges that can be repeated are looked at: the smallest of the inner runs of
ANCHOR words of an edge goes with it wherever it stands, so an edge whose smallest inner run stands nowhere else is
unique. The remaining edges meet by hash, are confirmed by a second hash, and come back to their source coordinates by
a join, where consecutive repeated edges compact into paths: the spans of repeated words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import (
    SECOND_MULTIPLIER,
    Words,
    identified,
    minimizers,
    prefix_sums,
    between,
    slices,
    text_bytes,
    text_key,
    window_starts,
    windows,
)
from folioforge.llm.repeats import BUCKET_KEYS, Keys, attach, distinct_texts, extent, find_repeated, unpack
from folioforge.operators.staging import release, stage

K = 35
ANCHOR = 16
SPANS = "key binary, n_words long, starts array<int>, ends array<int>, kept_sha256 string, n_removed long"


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for first, last in slices(offsets):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def edge_anchors(words: Words, hashes: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each edge of a slice, first word of its anchor, and hashes of all runs of ``anchor`` words by
    first word (runs across rows included, which no edge uses)."""
    starts = window_starts(words.first, k)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    sums = prefix_sums(hashes)
    begin = np.arange(len(hashes) - anchor + 1)
    runs = between(sums, begin, begin + anchor)
    return starts, minimizers(runs, k - anchor + 1)[starts], runs


def anchor_keys(k: int, anchor: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[Keys]:
        for first, _, data, offsets in sliced(batch):
            words = Words(data, offsets)
            _, anchors, runs = edge_anchors(words, words.hashes(), k, anchor)
            at = np.unique(anchors)
            row = words.row_of(at)
            yield row + first, at - words.first[row], runs[at], None

    return keys_of


def edge_keys(k: int, anchor: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[Keys]:
        found = batch.column("found")
        for first, last, data, offsets in sliced(batch):
            lists = found.slice(first, last - first).to_pylist()
            if not any(lists):
                continue
            words = Words(data, offsets)
            hashes = words.hashes()
            starts, anchors, _ = edge_anchors(words, hashes, k, anchor)
            repeated = np.zeros(len(hashes) + 1, bool)
            for row, own in enumerate(lists):
                repeated[words.first[row] + unpack(own)] = True
            starts = starts[repeated[anchors]]
            second = words.hashes(2, SECOND_MULTIPLIER)
            row = words.row_of(starts)
            yield (
                row + first,
                starts - words.first[row],
                between(prefix_sums(hashes), starts, starts + k),
                between(prefix_sums(second, SECOND_MULTIPLIER), starts, starts + k, SECOND_MULTIPLIER),
            )

    return keys_of


def merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches covered by windows of ``length``; those that touch are one."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length


def paths(attached: DataFrame, k: int) -> DataFrame:
    """Repeated edges of each text compacted into spans of words, and a digest of the words outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "text", "copies", "found")), strict=True)
            for key, text, copies, found in rows:
                words = text.encode().split()
                if copies > 1:
                    begin, end = (np.array([0]), np.array([len(words)])) if len(words) >= k else (np.zeros(0, int),) * 2
                else:
                    begin, end = merged(unpack(found), k)
                kept, last = [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    kept += words[last:b]
                    last = e
                kept += words[last:]
                values = (key, len(words), begin.tolist(), end.tolist(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in SPANS.split(", ")])

    return attached.select("key", "text", "copies", "found").mapInArrow(run, SPANS)


def repeated_words(docs: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """Spans of words that lie in a run of ``k`` words which stands more than once, in one text or in several:
    (doc_id, n_words, starts, ends, n_removed, kept_sha256), one row for each row of ``docs``.

    Null, empty and short texts have no spans. Texts that occur twice are repeated as a whole. A null doc_id stays null.
    """
    with distinct_texts(docs) as texts:
        size, groups = extent(texts)
        words = size // 6
        anchors = find_repeated(texts.select("key", "text"), anchor_keys(k, anchor), words // (5 * BUCKET_KEYS) + 1, groups, exact=False)
        anchors = stage(anchors, "repeated-anchors")
        candidates = attach(texts.select("key", "text"), anchors)
        edges = find_repeated(candidates.where("found is not null"), edge_keys(k, anchor), words // (2 * BUCKET_KEYS) + 1, groups, exact=True)
        spans = stage(paths(attach(texts, edges), k), "repeated-paths")
    release(anchors)
    keys = identified(docs).select("doc_id", text_key(F.col("text")).alias("key"))
    return keys.join(spans, "key").drop("key")
