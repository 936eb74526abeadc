"""Substring dedup by bytes: suffixes sampled at a difference cover, then merged.

Positions of a text are sampled at a difference cover of a period V, the longest that leaves blocks of BLOCK bytes: for
any two positions there is a shift below V that brings both onto sampled ones. Two places that share LENGTH bytes therefore share, at some sampled position of each
within V bytes, a block of LENGTH - V + 1 bytes. Sampled suffixes are sorted by their blocks, and blocks that sort next
to an equal one get a common name; a suffix can only be repeated over LENGTH bytes if it lies within V bytes before a
sampled one whose name is shared. These remaining suffixes are merged: runs of them that have one smallest inner string
in common meet where that string's hash sends them, bring the bytes they cover, and neighbours in the order of their
prefixes of LENGTH bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import SECOND_MULTIPLIER, between, byte_codes, identified, minimizers, prefix_sums, slices, text_bytes, text_key, window_starts
from folioforge.llm.repeats import BUCKET_KEYS, GROUPED, Keys, attach, by_text, distinct_texts, extent, find_repeated, grouped_rows, unpack
from folioforge.operators.staging import release, stage

LENGTH = 400
# Perfect difference sets by period, every remainder but 0 being the difference of exactly one pair.
COVERS = {
    273: (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
# A block has as many bytes at least, so that few positions share one by chance.
BLOCK = 96
# Bytes of the inner string by which remaining suffixes meet.
INNER = 32
# Bytes of text that a task holds before it sends them, and that a bucket gets.
TASK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
CONTEXTS = "bucket int, bytes binary, sizes binary, keys binary, context binary, starts binary"
SPANS = "key binary, starts array<int>, ends array<int>, n_removed long, n_spans long, kept_sha256 string"


def period_of(length: int) -> int:
    """The period of the cover for strings of ``length`` bytes."""
    fitting = [period for period in COVERS if length - period + 1 >= BLOCK]
    if not fitting:
        raise ValueError(f"strings of {length} bytes are too short: at least {min(COVERS) + BLOCK - 1}")
    return max(fitting)


def sampled_names(length: int, period: int):
    """Hashes of the blocks at sampled positions."""
    block = length - period + 1
    sampled = np.zeros(period, bool)
    sampled[list(COVERS[period])] = True

    def keys_of(batch: pa.RecordBatch) -> Iterator[Keys]:
        data, offsets = text_bytes(batch.column("text"))
        for first, last in slices(offsets):
            own, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            starts = window_starts(bounds, block)
            row = np.searchsorted(bounds, starts, "right") - 1
            fits = sampled[(starts - bounds[row]) % period] & (bounds[row + 1] - bounds[row] >= length)
            starts, row = starts[fits], row[fits]
            sums = prefix_sums(byte_codes(1)[own])
            yield row + first, starts - bounds[row], between(sums, starts, starts + block), None

    return keys_of


def remaining(named: np.ndarray, size: int, length: int, period: int) -> Iterator[tuple[int, int]]:
    """Ranges of the suffixes that lie less than a period before a named position and have ``length`` bytes."""
    named = np.sort(named)
    begin, end = np.maximum(named - period + 1, 0), np.minimum(named, size - length) + 1
    begin, end = begin[begin < end], end[begin < end]
    if not len(begin):
        return
    cut = np.flatnonzero(begin[1:] > np.maximum.accumulate(end)[:-1])
    yield from zip(begin[np.concatenate([[0], cut + 1])].tolist(), np.maximum.accumulate(end)[np.append(cut, len(end) - 1)].tolist(), strict=True)


def runs(text: bytes, named: np.ndarray, length: int, period: int) -> Iterator[tuple[int, int, int]]:
    """Remaining suffixes cut into runs with one smallest inner string: (its hash, first suffix, end of the suffixes)."""
    data = np.frombuffer(text, np.uint8)
    for begin, end in remaining(named, len(data), length, period):
        region = data[begin : end - 1 + length]
        sums = prefix_sums(byte_codes(1)[region])
        at = np.arange(len(region) - INNER + 1)
        inner = between(sums, at, at + INNER)
        least = minimizers(inner, length - INNER + 1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, [len(least)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(inner[least[a]]), begin + a, begin + b


def meet(attached: DataFrame, length: int, period: int, buckets: int) -> DataFrame:
    """Runs of remaining suffixes with the bytes they cover, sent to the bucket of their inner string. Runs that cover
    equal bytes are sent once by a task, with all their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list[tuple[bytes, int]]]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6)]
            for bucket, contexts in held.items():
                places = [(key, i, start) for i, own in enumerate(contexts.values()) for key, start in own]
                values = (
                    bucket,
                    b"".join(contexts),
                    np.fromiter(map(len, contexts), np.uint32, len(contexts)).tobytes(),
                    b"".join(p[0] for p in places),
                    np.array([p[1] for p in places], np.uint32).tobytes(),
                    np.array([p[2] for p in places], np.uint32).tobytes(),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in CONTEXTS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column("key")[i].as_py(), batch.column("text")[i].as_py().encode()
                for inner, begin, end in runs(text, unpack(batch.column("found")[i].as_py()), length, period):
                    covered = text[begin : end - 1 + length]
                    contexts = held.setdefault((inner >> 33) % buckets, {})
                    if covered not in contexts:
                        size += len(covered)
                    contexts.setdefault(covered, []).append((key, begin))
                    size += 20
                if size > TASK_BYTES:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    return attached.select("key", "text", "found").mapInArrow(run, CONTEXTS)


def merge(met: DataFrame, length: int, groups: int) -> DataFrame:
    """Suffixes whose first ``length`` bytes stand at two coordinates or more, as runs: (key, found)."""

    def compare(table: pa.Table) -> pa.Table:
        parts = {name: table.column(name).to_pylist() for name in table.column_names}
        data = np.frombuffer(b"".join(parts["bytes"]), np.uint8)
        per_row = [np.frombuffer(s, np.uint32).astype(np.int64) for s in parts["sizes"]]
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(per_row))])
        before = np.cumsum([0, *map(len, per_row)])
        context = np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64) + before[i] for i, c in enumerate(parts["context"])])
        begins = np.frombuffer(b"".join(parts["starts"]), np.uint32).astype(np.int64)
        keys = [k[16 * i : 16 * i + 16] for k in parts["keys"] for i in range(len(k) // 16)]
        copies = np.bincount(context, minlength=len(bounds) - 1)
        starts = window_starts(bounds, length)
        hashes = [np.zeros(len(starts), np.uint64) for _ in range(2)]
        for out, seed, multiplier in ((hashes[0], 1, None), (hashes[1], 2, SECOND_MULTIPLIER)):
            # A stretch of contexts at a time.
            for first, last in slices(bounds):
                own = slice(*np.searchsorted(starts, bounds[[first, last]]))
                at = starts[own] - bounds[first]
                codes = byte_codes(seed)[data[bounds[first] : bounds[last]]]
                arguments = () if multiplier is None else (multiplier,)
                out[own] = between(prefix_sums(codes, *arguments), at, at + length, *arguments)
        order = np.lexsort((hashes[1], hashes[0]))
        same = (hashes[0][order][1:] == hashes[0][order][:-1]) & (hashes[1][order][1:] == hashes[1][order][:-1])
        of = np.searchsorted(bounds, starts, "right") - 1
        repeated = copies[of] > 1
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        # Windows of context c are edge[c] to edge[c + 1].
        edge = np.searchsorted(starts, bounds)
        found_keys, found = [], []
        for c, begin, key in zip(context.tolist(), begins.tolist(), keys, strict=True):
            own = np.flatnonzero(repeated[edge[c] : edge[c + 1]])
            if len(own):
                # Runs of suffixes, as first and last.
                cut = np.flatnonzero(np.diff(own) > 1)
                pairs = np.stack([own[np.concatenate([[0], cut + 1])], own[np.append(cut, len(own) - 1)]], axis=1) + begin
                found_keys.append(key)
                found.append(pairs.astype(np.uint32).tobytes())
        return grouped_rows(found_keys, found, groups)

    return by_text(met.groupBy("bucket").applyInArrow(compare, GROUPED))


def covered(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of bytes covered by runs (first, last) of suffixes; stretches that touch are one."""
    if not len(found):
        return found, found
    pairs = found.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1] + length)
    cut = np.flatnonzero(pairs[1:, 0] > reach[:-1])
    return pairs[np.concatenate([[0], cut + 1]), 0], reach[np.append(cut, len(reach) - 1)]


def remove(attached: DataFrame, length: int) -> DataFrame:
    """Spans of each text and a digest of the bytes outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text, copies = batch.column("text")[i].as_py().encode(), batch.column("copies")[i].as_py()
                if copies > 1:
                    begin, end = (np.array([0]), np.array([len(text)])) if len(text) >= length else (np.zeros(0, int),) * 2
                else:
                    begin, end = covered(unpack(batch.column("found")[i].as_py()), length)
                kept, last = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.update(text[last:b])
                    last = e
                kept.update(text[last:])
                values = (batch.column("key")[i].as_py(), begin.tolist(), end.tolist(), int((end - begin).sum()), len(begin), kept.hexdigest())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in SPANS.split(", ")])

    return attached.select("key", "text", "copies", "found").mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of bytes covered by strings of ``length`` bytes that start more than once, one row for each distinct text:
    (key, starts, ends, n_removed, n_spans, kept_sha256), ``key`` being ``text_key`` of the text."""
    period = period_of(length)
    with distinct_texts(docs) as texts:
        size, groups = extent(texts)
        buckets = size * len(COVERS[period]) // period // BUCKET_KEYS + 1
        named = stage(find_repeated(texts.select("key", "text"), sampled_names(length, period), buckets, groups, exact=False), "shared-names")
        candidates = attach(texts.select("key", "text"), named).where("found is not null")
        merged = merge(meet(candidates, length, period, size // BUCKET_BYTES + 1), length, groups)
        spans = stage(remove(attach(texts, merged), length), "repeated-bytes")
    release(named)
    return spans


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of bytes covered by strings of ``length`` bytes that start more than once, in one text or in several:
    (doc_id, n_bytes, starts, ends, n_removed, n_spans, kept_sha256), one row for each row of ``docs``.

    Null and empty texts have no bytes, texts under ``length`` no spans. Texts that occur twice are repeated as a whole.
    Strings are judged on the input. A null doc_id stays null. ``length`` is 152 at least.
    """
    spans = repeated_spans(docs, length)
    keys = identified(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text_key(F.col("text")).alias("key"))
    return keys.join(spans, "key").drop("key")
