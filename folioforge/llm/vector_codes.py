"""Vector codes: parts of vectors named by their nearest codebook entry, found with the pivots of LAESA.

Vectors of integers are cut into parts, and each part position has a codebook. A few entries of the first codebook are
its pivots, and stay so. The distances of every part to its pivots are computed once and kept beside it. In each round
the distances from pivots to the current entries give a lower bound for every part and entry, by the triangle
inequality; entries are taken in the order of that bound and evaluated exactly, in integers, until the bound of the next
one is above the least distance found. Sums and counts of a task's parts are added up before they are shuffled, so the
driver gets one codebook a round, whose size depends on the parameters and the dimension alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import bound_batches
from folioforge.operators.lookup import heavy_keys, lookup
from folioforge.operators.staging import release, stage

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE = 256
# Components beyond this count as this, which keeps sums of squares within 64 bits for up to 4,000 dimensions.
LARGEST = 1 << 24
# Rows whose distances are computed together.
BLOCK = 2048

Codebooks = np.ndarray  # parts x entries x width, integers


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, components): the rows whose vector holds neither null nor non-finite components, as integers."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limited = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-LARGEST * 1.0)), F.lit(LARGEST * 1.0)) * scale), F.lit(-LARGEST)), F.lit(LARGEST))
    return plain.where(F.col("vector").isNotNull() & finite).select("vec_id", "label", F.transform("vector", lambda x: limited(x).cast("int")).alias("components"))


def part_matrix(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """Rows x parts x width; a vector shorter than that is followed by zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (lengths == parts * width).all():
        return flat.reshape(-1, parts, width).astype(np.int64)
    out = np.zeros((len(column), parts * width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out.reshape(-1, parts, width)


def first_codebooks(vectors: DataFrame, dimension: int, parts: int, entries: int) -> Codebooks:
    """The parts of the ``entries`` smallest vec_ids; of equal ids the smaller vector, and null ids come last."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "components").select("components").limit(entries).collect()
    width = dimension // parts
    return part_matrix(pa.array([r.components for r in rows], pa.list_(pa.int32())), parts, width).transpose(1, 0, 2)


def pick_pivots(codebooks: Codebooks, pivots: int) -> np.ndarray:
    """Parts x pivots x width: of each codebook its first entry, then always the one farthest from those picked."""
    out = []
    for book in codebooks:
        picked, far = [0], squared(book, book[0])
        for _ in range(min(pivots, len(book)) - 1):
            picked.append(int(far.argmax()))
            far = np.minimum(far, squared(book, book[picked[-1]]))
        out.append(book[picked])
    return np.stack(out)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return (difference * difference).sum(axis=-1)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray, parts: int, width: int) -> DataFrame:
    """Adds ``to_pivots``: the distances of every part to its pivots, part by part, as 32-bit floats."""
    names = ["vec_id", "label", "components", "to_pivots"]
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = part_matrix(batch.column("components"), parts, width)
            distances = np.sqrt(np.stack([squared(matrix, pivots[None, :, p]) for p in range(pivots.shape[1])], axis=2))
            packed = [row.tobytes() for row in distances.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names)

    return vectors.mapInArrow(run, f"vec_id long, label {kind}, components array<int>, to_pivots binary")


def nearest(part: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of one part position (ties: the lowest), its squared distance, and how many distances
    were evaluated for it."""
    between = np.sqrt(squared(book[:, None], pivots[None]))
    rows = len(part)
    bound = np.zeros((rows, len(book)))
    for p in range(len(pivots)):
        # Distances are rounded, so the bound is lowered by more than that.
        margin = 1e-6 * (to_pivots[:, p, None] + between[None, :, p]) + 1e-6
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[None, :, p]) - margin, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2
    entry = order[:, 0].copy()
    best = squared(part, book[entry])
    evaluated, active = rows, np.arange(rows)
    for place in range(1, len(book)):
        active = active[bound[active, place] <= best[active]]
        if not len(active):
            break
        other = order[active, place]
        distance = squared(part[active], book[other])
        evaluated += len(active)
        better = (distance < best[active]) | ((distance == best[active]) & (other < entry[active]))
        best[active[better]] = distance[better]
        entry[active[better]] = other[better]
    return entry, best, evaluated


def assign(batch: pa.RecordBatch, codebooks: Codebooks, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of a batch: first row, matrix (rows x parts x width), entries and squared distances (rows x parts)."""
    parts, _, width = codebooks.shape
    for first in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(first, BLOCK)
        matrix = part_matrix(rows.column("components"), parts, width)
        kept = np.frombuffer(b"".join(rows.column("to_pivots").to_pylist()), np.float32).reshape(len(matrix), parts, -1)
        entries, distances = np.zeros((len(matrix), parts), np.int64), np.zeros((len(matrix), parts), np.int64)
        for k in range(parts):
            entries[:, k], distances[:, k], _ = nearest(matrix[:, k], kept[:, k].astype(np.float64), codebooks[k], pivots[k])
        yield first, matrix, entries, distances


def refined(vectors: DataFrame, codebooks: Codebooks, pivots: np.ndarray) -> Codebooks:
    """Each entry replaced by the mean of the parts nearest to it, rounded down; one that is nearest to none stays."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, matrix, chosen, _ in assign(batch, codebooks, pivots):
                slots = (chosen + np.arange(parts) * entries).ravel()
                counts += np.bincount(slots, minlength=parts * entries)
                np.add.at(sums, slots, matrix.reshape(-1, width))
        used = np.flatnonzero(counts)
        if len(used):
            slots = np.repeat(used, width)
            columns = (slots, np.tile(np.arange(width), len(used)), sums[used].ravel(), np.repeat(counts[used], width))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "place", "total", "n"])

    partial = vectors.select("components", "to_pivots").mapInArrow(run, "slot long, place long, total long, n long")
    # As many rows as the codebooks have components.
    rows = partial.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = codebooks.reshape(parts * entries, width).copy()
    for row in rows:
        out[row.slot, row.place] = row.total // row.n
    return out.reshape(parts, entries, width)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all whole vectors, (vec_id, label, code array<int>, error), and the codebooks they refer to.

    A vector that is null or holds null or non-finite components goes; every other row has one row of the result, rows
    with equal ids too. A component x counts as floor(``scale`` * x), limited to +-2**24. Vectors are as long as the
    longest, rounded up to a multiple of ``parts``; shorter ones are followed by zeros. With fewer vectors than
    ``entries`` a codebook is that much shorter; without any the result is empty. Runs jobs; what they share is a table
    in shared storage, so a lost executor costs its tasks only.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = whole_vectors(vectors, scale)
    kind = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code array<int>, error long"
    longest = kept.agg(F.max(F.size("components"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = max(1, -(-longest // parts))
    codebooks = first_codebooks(kept, width * parts, parts, entries)
    fixed = pick_pivots(codebooks, pivots)
    table = stage(with_pivot_distances(kept, fixed, parts, width), "pivot-distances")
    for _ in range(rounds):
        codebooks = refined(table, codebooks, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, matrix, chosen, distances in assign(batch, codebooks, fixed):
                rows = batch.slice(first, len(matrix))
                codes = pa.array(list(chosen.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), codes, pa.array(distances.sum(axis=1))], ["vec_id", "label", "code", "error"])

    coded = stage(table.mapInArrow(run, schema), "vector-codes")
    release(table)
    return coded, codebooks


def code_digest(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Codes as hex digits, the error summed over equal labels (nulls together), and a digest of the codebooks."""
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    # A null label is a label like any other, and one label may hold most rows.
    named = coded.select("vec_id", digits.alias("code"), "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("label"))
    totals = named.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = lookup(named, totals, key="label", row_id="vec_id", name="label_error", heavy=heavy_keys(named, "label"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
