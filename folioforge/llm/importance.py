"""Importance resampling: texts are drawn by how much likelier a model of good texts makes them than a model of all.

Either model is a distribution over hashed words and word pairs. A text's weight is the mean logarithm of the ratio of
the two over its n-grams, for a passage of LENGTH n-grams so that long and short texts compare. Gumbel noise, a fixed
function of the id, is added, and the texts with the largest sums are drawn: a sample without replacement in proportion
to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import Words, identified, slices, text_bytes
from folioforge.operators.staging import stage

BUCKETS = 1 << 17
RANGES = 32
LENGTH = 100
# At most so many labelled rows make the model of good texts: those with the smallest hashes of their ids.
TARGET_ROWS = 20_000
SHARE = 0.75
SEED = 7
# Digits found by each pass of the search for the threshold, and passes.
DIGITS, PASSES = 14, 3


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a slice, and the row of each."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    pairs, starts = words.grams(hashes, 2)
    row = words.row_of(np.arange(len(hashes)))
    buckets = np.concatenate([hashes, pairs]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([row, row[starts]])


def count_buckets(flagged: DataFrame) -> DataFrame:
    """Occurrences by bucket: (part, every, target), each a stretch of the table of buckets. A task adds up all its
    texts before anything is shuffled."""
    width = BUCKETS // RANGES

    def rows(every: np.ndarray, target: np.ndarray, parts) -> Iterator[pa.RecordBatch]:
        stretch = [slice(p * width, (p + 1) * width) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([every[s].tobytes() for s in stretch]), pa.array([target[s].tobytes() for s in stretch])],
            ["part", "every", "target"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for first, last in slices(offsets):
                begin = offsets[first]
                buckets, row = text_grams(data[begin : offsets[last]], offsets[first : last + 1] - begin)
                every += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[good[first:last][row]], minlength=BUCKETS)
        yield from rows(every, target, range(RANGES))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, every, target in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(part, [np.zeros(width, np.int64), np.zeros(width, np.int64)])
                own[0] += np.frombuffer(every, np.int64)
                own[1] += np.frombuffer(target, np.int64)
        for part, (every, target) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([every.tobytes()]), pa.array([target.tobytes()])], ["part", "every", "target"])

    kind = "part int, every binary, target binary"
    return flagged.mapInArrow(count, kind).repartition(RANGES, "part").mapInArrow(add, kind)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Logarithm of the ratio of the two models for each bucket.

    Good: labelled quality 1 and not toxic. Every text counts for the model of all texts. Only BUCKETS sums come to the
    driver. Without good rows both models are the same up to smoothing.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TARGET_ROWS)
    # TARGET_ROWS numbers at most.
    flagged = identified(docs).join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")
    every, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    width = BUCKETS // RANGES
    for row in count_buckets(flagged.select("text", F.coalesce("good", F.lit(False)).alias("good"))).collect():
        stretch = slice(row.part * width, (row.part + 1) * width)
        every[stretch] += np.frombuffer(row.every, np.int64)
        target[stretch] += np.frombuffer(row.target, np.int64)
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((every + 1) / (every.sum() + BUCKETS))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) of each text; a text without words has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # a megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last in slices(offsets):
                begin = offsets[first]
                buckets, row = text_grams(data[begin : offsets[last]], offsets[first : last + 1] - begin)
                n = np.bincount(row, minlength=last - first)
                total = np.bincount(row, table[buckets], minlength=last - first)
                weight = LENGTH * total / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    return identified(docs).mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def threshold(keyed: DataFrame, share: float) -> float | None:
    """A key that ``share`` of all rows reach, found by counting ever finer steps; a pass brings 2 ** DIGITS counts."""
    low, high, total = keyed.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not total or low == high:
        return low
    wanted = max(1, round(share * total))
    for _ in range(PASSES):
        steps = 1 << DIGITS
        size = (high - low) / steps
        if size <= 0:
            break
        step = F.least(F.floor((F.col("key") - low) / size), F.lit(steps - 1))
        counts = keyed.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(step.alias("step")).count().collect()
        for row in sorted(counts, key=lambda r: -r["step"]):
            if row["count"] >= wanted:
                low, high = low + row["step"] * size, low + (row["step"] + 1) * size
                break
            wanted -= row["count"]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """Draw ``share`` of the texts: (doc_id, n_grams, log_weight, key, selected), one row for each row of ``docs``.

    Rows at the threshold itself are all drawn, so repeated rows, which have equal keys, are drawn or left together.
    Null and empty texts have weight 0, the weight of a text that either model makes equally likely. A null doc_id has
    noise of its own, the same for all such rows. Labels that are null or name no document are left out.
    """
    weighed = weigh(docs, fit(docs, labels))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    keyed = stage(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "importance-keys")
    limit = threshold(keyed, share)
    return keyed.withColumn("selected", F.col("key") >= F.lit(limit))
