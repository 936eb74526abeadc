"""What several operators share: staging, and array code over the UTF-8 bytes of a batch of texts.

Array code runs inside Spark tasks, on slices of half a megabyte of text, so the memory of a task does not depend on
the size of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Texts of a slice together, unless one text alone is longer.
SLICE_BYTES = 1 << 19

# ASCII white space, the separators of words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SECOND_MULTIPLIER = 0xC2B2AE3D27D4EB4F | 1


# What the JVM hands to a Python worker at once: beside the heap, both hold it in memory that nothing else bounds.
BATCH_ROWS, BATCH_BYTES = 1000, "8MB"


def bound_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches for the session, unless it asks for smaller ones."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: further columns, whatever their names, cannot clash with an operator's own."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; rows with equal texts share them. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about ``limit`` bytes; at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


@lru_cache(maxsize=2)
def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, np.int64).astype(np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(length: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    known = _POWERS.get(multiplier)
    if known is None or len(known[0]) < length:
        size = 1 << max(10, int(length - 1).bit_length())
        known = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
            for base in (np.uint64(multiplier), np.uint64(pow(multiplier, -1, 2**64)))
        )
        if size <= 1 << 22:
            _POWERS[multiplier] = known
    return known[0][:length], known[1][:length]


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def prefix_sums(codes: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Sums from which ``between`` reads the hash of any stretch."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), multiplier)[0], out=sums[1:])
    return sums


def between(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hashes of the stretches [begin, end): equal for equal stretches wherever they lie."""
    return mix((sums[end] - sums[begin]) * powers(len(sums), multiplier)[1][begin])


class Words:
    """Words of a slice of texts: where each begins and ends, a hash of each, and the words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, lower: bool = False):
        self.rows = len(offsets) - 1
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + 32, data).astype(np.uint8)
        self.data = data
        table = np.ones(256, bool)
        table[list(separators)] = False
        inside = table[data]
        first, last = offsets[:-1][offsets[1:] > offsets[:-1]], offsets[1:][offsets[1:] > offsets[:-1]] - 1
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[first] = inside[first]
        ends[last] = inside[last]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        # Words of row r are first[r] to first[r + 1].
        self.first = np.searchsorted(self.begin, offsets)

    def hashes(self, seed: int = 1, multiplier: int = MULTIPLIER) -> np.ndarray:
        return between(prefix_sums(byte_codes(seed)[self.data], multiplier), self.begin, self.end, multiplier)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def grams(self, hashes: np.ndarray, n: int, multiplier: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a row, and the word each run begins at."""
        return windows(hashes, self.first, n, multiplier)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of all windows of n tokens that stay within their row; ``first`` holds the rows' bounds."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    fits = np.zeros(total + 1, np.int64)
    long = (first[1:] - first[:-1]) >= n
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:-1]) > 0)


def windows(tokens: np.ndarray, first: np.ndarray, n: int, multiplier: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    starts = window_starts(first, n)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return between(prefix_sums(tokens, multiplier), starts, starts + n, multiplier), starts


# Fixed, so that what is smallest does not depend on how long the rest of the array is.
POSITION_BITS = np.uint64(30)


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, where its smallest lies (the leftmost of equal ones).

    Smallest from each block's end backwards and each block's start forwards, so a window takes two steps.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    # The position in the low bits makes values distinct, and ties go to the left.
    padded = -(-len(values) // width) * width
    order = np.full(padded, np.iinfo(np.uint64).max, np.uint64)
    order[: len(values)] = (values >> POSITION_BITS << POSITION_BITS) | np.arange(len(values), dtype=np.uint64)
    blocks = order.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:count], forward[width - 1 : width - 1 + count])
    return (least & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def annotate(docs: DataFrame, compute: Callable[[list[str]], list[pa.Array]], kind: str) -> DataFrame:
    """All columns of ``docs``, under the names c0, c1, ..., and the columns of ``kind`` that ``compute`` gives for a
    list of texts (null as empty). Rows stay where they are, and names of ``docs`` cannot clash, not even with
    each other."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    added = StructType.fromDDL(kind)
    names = [*plain.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for begin, end in slices(text_bytes(texts)[1]):
                for first in range(begin, end, 4096):
                    part = batch.slice(first, min(end, first + 4096) - first)
                    found = compute([t or "" for t in part.column(at).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns, *found], names)

    return plain.mapInArrow(run, StructType([*plain.schema.fields, *added.fields]))


def restored(annotated: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, of the rows that are left."""
    return annotated.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
