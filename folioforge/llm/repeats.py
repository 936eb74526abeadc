"""Finding what occurs more than once among very many keys with coordinates in texts.

Rows of Spark are whole arrays here: a task collects the keys of its texts, sorts them by bucket and sends each bucket
one row of packed arrays, and the task that gets a bucket sorts its keys. A key that a task meets several times is sent
once, marked as repeated, and its other coordinates travel apart from the bucket, so a key that stands in a third of
all texts reaches its bucket at most once for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import identified, text_key
from folioforge.operators.staging import new_folder, remove_folder

# Keys that a task holds before it sends them, and keys that a bucket gets.
TASK_KEYS = 500_000
BUCKET_KEYS = 750_000

PACKED = "bucket int, keys binary, counts binary, positions binary, hashes binary, checks binary, repeated binary"
# Texts whose findings travel together, and what a bucket sends on for such a group.
GROUP_TEXTS = 4096
GROUPED = "texts int, keys binary, sizes binary, positions binary"
FOUND = "key binary, found binary"

# What a slice of texts gives: row of each key, position in the row's text, hash, second hash (or None).
Keys = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def key_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


@contextmanager
def distinct_texts(docs: DataFrame) -> Iterator[DataFrame]:
    """Table of the distinct texts (key, text, copies, n_bytes), null as empty, bucketed by key in shared storage, so that joins
    on key move no text; it goes when the block ends. Copies are dropped within each task before anything is shuffled."""
    spark = docs.sparkSession
    texts = identified(docs).select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = texts.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"distinct_texts_{uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = distinct.withColumn("n_bytes", F.octet_length("text").cast("long"))
    folder = new_folder(spark, name)
    try:
        sized.write.bucketBy(parts, "key").option("path", folder).option("compression", "zstd").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")
        remove_folder(spark, folder)


def extent(texts: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and the number of groups for their findings."""
    size, count = texts.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    return size or 0, count // GROUP_TEXTS + 1


def attach(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with what was found in each (null: nothing). Text stays where it lies."""
    return texts.join(found.hint("shuffle_hash"), "key", "left")


def unpack(found: bytes | None) -> np.ndarray:
    return np.frombuffer(found, np.uint32).astype(np.int64) if found else np.zeros(0, np.int64)


def grouped_rows(keys: list[bytes], found: list[bytes], groups: int) -> pa.Table:
    """Findings of a bucket, packed into one row for each group of texts."""
    out: list[list] = [[], [], [], []]
    if keys:
        # Keys are digests: any four of their bytes are spread evenly.
        group = np.frombuffer(b"".join(keys), np.uint32)[::4] % np.uint32(groups)
        order = np.argsort(group, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[begin:end].tolist()
            out[0].append(int(group[own[0]]))
            out[1].append(b"".join(keys[i] for i in own))
            out[2].append(np.array([len(found[i]) for i in own], np.uint32).tobytes())
            out[3].append(b"".join(found[i] for i in own))
    kinds = [pa.int32(), *[pa.binary()] * 3]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in GROUPED.split(", ")])


def by_text(grouped: DataFrame) -> DataFrame:
    """Findings of all buckets, one row for each text: (key, found)."""

    def gather(table: pa.Table) -> pa.Table:
        found: dict[bytes, list[bytes]] = {}
        for keys, sizes, positions in zip(*(table.column(c).to_pylist() for c in ("keys", "sizes", "positions")), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
            for i, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
                found.setdefault(keys[16 * i : 16 * i + 16], []).append(positions[begin:end])
        return pa.table({"key": pa.array(list(found), pa.binary()), "found": pa.array([b"".join(f) for f in found.values()], pa.binary())})

    return grouped.groupBy("texts").applyInArrow(gather, FOUND)


def packed_rows(keys: np.ndarray, rows: np.ndarray, positions: np.ndarray, hashes: np.ndarray, checks, repeated, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((rows, bucket))
    rows, positions, bucket, hashes, repeated = rows[order], positions[order].astype(np.uint32), bucket[order], hashes[order], repeated[order]
    checks = checks[order] if checks is not None else None
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    out: list[list] = [[] for _ in range(7)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        own = rows[begin:end]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        counts = np.diff(np.append(first, len(own))).astype(np.uint32)
        values = (int(bucket[begin]), keys[own[first]].tobytes(), counts.tobytes(), positions[begin:end].tobytes(), hashes[begin:end].tobytes(), checks[begin:end].tobytes() if checks is not None else None, np.packbits(repeated[begin:end]).tobytes())
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in PACKED.split(", ")])


def send(keys: np.ndarray, parts: list[Keys], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed arrays for the buckets; further coordinates of keys met before go to buckets below 0, which
    only hand them on."""
    rows, positions, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if not len(hashes):
        return
    checks = np.concatenate([p[3] for p in parts]) if parts[0][3] is not None else None
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if checks is not None:
        same &= checks[order][1:] == checks[order][:-1]
    again = np.zeros(len(order), bool)
    again[order[1:]] = same
    repeated = np.zeros(len(order), bool)
    repeated[order[:-1]] = same
    repeated |= again
    first, later = np.flatnonzero(~again), np.flatnonzero(again)
    # Within a bucket 32 more bits tell keys apart well enough to find candidates; exact searches send all 128.
    short = hashes.astype(np.uint32) if checks is None else hashes
    bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    yield packed_rows(keys, rows[first], positions[first], short[first], checks[first] if checks is not None else None, repeated[first], bucket[first])
    if len(later):
        away = -1 - (rows[later] % buckets)
        none = np.zeros(len(later), np.uint8)
        yield packed_rows(keys, rows[later], positions[later], none, None, none.astype(bool), away)


def find_repeated(texts: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[Keys]], buckets: int, groups: int, exact: bool) -> DataFrame:
    """Where keys stand that occur more than once: (key, found), a row for each text that has any.

    ``texts`` has the column key; ``keys_of`` gives the keys of a batch, slice by slice. ``exact``: keys are compared by
    128 bits; else by enough bits to find candidates.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, parts, rows = 0, [], [], 0
        for batch in batches:
            known.append(key_array(batch.column("key")))
            for own, positions, hashes, checks in keys_of(batch):
                parts.append((own + rows, positions, hashes, checks))
                held += len(own)
                if held >= TASK_KEYS:
                    yield from send(np.concatenate(known), parts, buckets)
                    held, parts = 0, []
            rows += batch.num_rows
            if not parts:
                known, rows = [], 0
        if parts:
            yield from send(np.concatenate(known), parts, buckets)

    def compare(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in table.column_names}
        if columns["bucket"][0] < 0:
            keep = None
        else:
            hashes = np.frombuffer(b"".join(columns["hashes"]), np.uint64 if exact else np.uint32)
            checks = np.frombuffer(b"".join(columns["checks"]), np.uint64) if exact else None
            sizes = [len(p) // 4 for p in columns["positions"]]
            keep = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(columns["repeated"], sizes, strict=True)]).astype(bool)
            order = np.lexsort((checks, hashes)) if exact else np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            if exact:
                same &= checks[order][1:] == checks[order][:-1]
            keep[order[1:]] |= same
            keep[order[:-1]] |= same
        found_keys, found, done = [], [], 0
        for own_keys, counts, positions in zip(columns["keys"], columns["counts"], columns["positions"], strict=True):
            counts, positions = np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(positions, np.uint32)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            if keep is None:
                chosen, per_text = positions, counts
            else:
                own = keep[done : done + len(positions)]
                chosen, per_text = positions[own], np.add.reduceat(own.astype(np.int64), bounds[:-1])
            ends = np.cumsum(per_text)
            for i in np.flatnonzero(per_text):
                found_keys.append(own_keys[16 * i : 16 * i + 16])
                found.append(chosen[ends[i] - per_text[i] : ends[i]].tobytes())
            done += len(positions)
        return grouped_rows(found_keys, found, groups)

    return by_text(texts.mapInArrow(collect, PACKED).groupBy("bucket").applyInArrow(compare, GROUPED))
