"""SimHash near-duplicates: a byte-position index with count filtering.

Fingerprints of 64 bits that differ in at most two bits agree in at least six of their eight bytes. Each distinct
fingerprint is entered in the index under every choice of six byte positions, with the bytes found there, so two
fingerprints share an entry exactly if their tally of equal positional bytes reaches the guaranteed six. Within an
entry only two bytes are free: a link is verified by flipping up to two of those sixteen bits and looking the result
up, so no pairs are formed, and an entry of many fingerprints costs no more for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import MULTIPLIER, Words, bound_batches, identified, mix, slices, text_bytes, text_key
from folioforge.operators.lookup import heavy_keys, lookup
from folioforge.operators.staging import release, stage

SHINGLE = 3
BITS = 2
BYTES = 8
# Bytes that two fingerprints within BITS bits have in common at the least.
SHARED = BYTES - BITS
# Hashes whose bits are counted together.
BLOCK = 1 << 15
POSITIONS = list(combinations(range(BYTES), SHARED))


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[b:e], 42) for b, e in zip(begins[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for first in range(0, n, BLOCK):
        block = hashes[first : first + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each whole text; a text without words, null or empty has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py() or "", shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return identified(docs).mapInArrow(run, "doc_id long, fp long")


def flips() -> np.ndarray:
    """Sixteen bits with one or two of them set."""
    one = [1 << i for i in range(8 * BITS)]
    return np.array(one + [a | b for a, b in combinations(one, 2)], np.int64)


def free_bits(values: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for position in free:
        out = out << 8 | ((values >> np.uint64(8 * position)) & np.uint64(255)).astype(np.int64)
    return out


def links_within(values: np.ndarray, free: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between distinct fingerprints of one entry, as two arrays, a flip at a time."""
    bits = free_bits(values, free)
    order = np.argsort(bits)
    ordered = bits[order]
    if len(values) <= 16:
        a, b = np.triu_indices(len(values), 1)
        near = np.bitwise_count(bits[a] ^ bits[b]) <= BITS
        yield values[a[near]], values[b[near]]
        return
    for flip in flips():
        other = ordered ^ flip
        at = np.searchsorted(ordered, other)
        hit = (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == other) & (ordered < other)
        yield values[order[hit]], values[order[at[hit]]]


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that differ in at most BITS bits, a above b as unsigned numbers or
    below, each at least once. The fingerprints of an entry differ in sixteen bits only, which bounds their number."""
    masks = [sum(0xFF << 8 * p for p in positions) for positions in POSITIONS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    free = [tuple(p for p in range(BYTES) if p not in positions) for positions in POSITIONS]
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)]))
    # The table is small before it is multiplied, so it would be read by a few tasks.
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = spread.select("fp", entries.alias("entry")).select("fp", "entry.choice", "entry.shared")
    met = index.groupBy("choice", "shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            choices = batch.column("choice").to_pylist()
            lists = batch.column("fps")
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            left, right = [], []
            for row, choice in enumerate(choices):
                for a, b in links_within(values[bounds[row] : bounds[row + 1]], free[choice]):
                    left.append(a)
                    right.append(b)
            if left:
                a, b = (np.concatenate(x).view(np.int64) for x in (left, right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.select("choice", "fps").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of an undirected graph reaches: (node, component), for the nodes of ``edges``
    (a, b), by turns of large-star and small-star, each written to shared storage.

    Smallest neighbours are aggregates, and joins have one row for each node on the one side, so a node with a third of
    all edges is no bottleneck.
    """

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        joined = near.join(least, "a")
        moved = joined.where("b > a") if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("least").alias("b")))
        return out.where("a != b").distinct()

    def summary(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()

    current = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = summary(current)
    while state[0]:
        large = stage(star(current, True), "large-star")
        small = stage(star(large, False), "small-star")
        release(current, large)
        current = small
        before, state = state, summary(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Group texts by fingerprint: (doc_id, fp, component_id, n_links).

    ``component_id`` is the smallest doc_id that links reach, of texts with equal fingerprints or ones that differ in at
    most two bits; ``n_links`` counts the other fingerprints that a text's own is linked to. Null, empty and blank texts
    have fingerprint 0, linked like any other. A null doc_id stays null and is never the smallest, unless its group has
    no other; repeated rows are rows of one group.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = stage(links(classes.select("fp")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "fingerprint-links")
    degree = linked.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = classes.join(components(linked).withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    table = grouped.join(least, "component").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(table, "fp").select("doc_id", "fp", "component_id", "n_links")


def fingerprint_digits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


# --- Similar texts. Candidates come from bands of minhash values; the shingles of what is found are compared.

WIDE_SHINGLE = 5
# Share of the shingles of two texts, each counted once, that both have.
LEAST_SHARE = 0.8
# Bands of so many minhash values each: two texts that share 0.8 of their shingles have none in common once in 20 million times.
BANDS, BAND_ROWS = 32, 4
# Texts of an entry that every other one is paired with at first: those that have the most in common with others.
REPRESENTATIVES = 4
# Bits of a sketch, each the parity of a text's shingles that fall on it: two texts differ in at least as many shingles as bits.
SKETCH_BITS = 1024
# Texts on either side of a cell, cells' texts of a bucket, and texts of a cell up to which cells are compared together.
CELL_TEXTS, CELL_ROWS, SMALL_CELL = 2000, 50_000, 32
CELLS = "key long, cell long, upper boolean, id long, component long, size int, sketch binary"
# Where more texts than that meet, they meet again where two, three and four of their bands agree at once: bands so many
# places apart, around the circle of bands.
LEVELS, STRIDES = 4, (1, 3, 7)
# Entries that a task holds before it sends them, and that a bucket gets.
TASK_KEYS, BUCKET_KEYS = 500_000, 750_000
ENTRIES = "bucket int, keys binary, ids binary, sizes binary, standing binary, sketches binary"
# Pairs whose sketches are compared at once.
SKETCH_PAIRS = 1 << 14
# Shingles that a task keeps for the next pairs of a text.
KNOWN_SHINGLES = 1 << 21


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the shingles of each row of a slice, repeats included: of five words, of all if a row has fewer."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    shingles, starts = words.grams(hashes, WIDE_SHINGLE)
    cuts = np.searchsorted(starts, words.first)
    for row in range(words.rows):
        own = shingles[cuts[row] : cuts[row + 1]]
        if not len(own) and words.first[row] < words.first[row + 1]:
            short = hashes[words.first[row] : words.first[row + 1]]
            own = mix(np.array([(short * np.arange(1, 2 * len(short), 2, dtype=np.uint64)).sum()], np.uint64))
        yield own


@lru_cache(maxsize=1)
def minhash_factors() -> list[np.uint64]:
    drawn = np.random.default_rng(11).integers(1, 2**62, BANDS * BAND_ROWS, np.int64).astype(np.uint64)
    return list(drawn << np.uint64(1) | np.uint64(1))


def bands(shingles: list[np.ndarray]) -> list[bytes]:
    """Keys of the bands of each text, 8 bytes each, from its distinct shingles; none for a text without shingles."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return [b""] * len(shingles)
    together = np.concatenate(shingles)
    begins = (np.cumsum(sizes) - sizes)[filled]
    keys = np.zeros((len(filled), BANDS), np.uint64)
    for i, factor in enumerate(minhash_factors()):
        least = np.minimum.reduceat((together * factor) >> np.uint64(16), begins)
        band = i // BAND_ROWS
        keys[:, band] = mix(keys[:, band] + least + np.uint64(band + 1))
    out = [b""] * len(shingles)
    for row, own in zip(filled.tolist(), keys, strict=True):
        out[row] = own.tobytes()
    return out


def parities(shingles: np.ndarray) -> bytes:
    """Sketch of distinct shingles."""
    return np.packbits(np.bincount((shingles >> np.uint64(20)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1).tobytes()


def sketch_words(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sketches (texts x words of 64 bits) of a binary column, of which a row may hold several."""
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def shingle_bands(docs: DataFrame) -> DataFrame:
    """(doc_id, key, set, size, bands, sketch): of each text its key, 16 bytes that stand for its distinct shingles, their number, the
    keys of its bands and its sketch. A text with fewer than five words has its whole sequence for a shingle, one without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            sets, sizes, keys, sketches = [], [], [], []
            for first, last in slices(offsets):
                begin = offsets[first]
                distinct = [np.unique(s) for s in shingle_hashes(data[begin : offsets[last]], offsets[first : last + 1] - begin)]
                sets += [np.array([mix(s).sum(), mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum()], np.uint64).tobytes() for s in distinct]
                sizes += [len(s) for s in distinct]
                keys += bands(distinct)
                sketches += [parities(s) for s in distinct]
            columns = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "set", "size", "bands", "sketch"])

    keyed = identified(docs).withColumn("key", text_key(F.col("text")))
    return keyed.mapInArrow(run, "doc_id long, key binary, set binary, size int, bands binary, sketch binary")


def halves(ids: np.ndarray) -> bytes:
    """Low halves of all ids, then the high ones, which hardly differ and so compress."""
    return np.ascontiguousarray(ids).view(np.uint32).reshape(-1, 2).T.tobytes()


def whole(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint32).reshape(2, -1).T).view(np.int64).ravel()


def group_order(keys: np.ndarray, standing: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, then from the highest standing down (ties: smallest id); the first place of each one's group in that
    order, and the size of the group."""
    order = np.lexsort((ids, -standing, keys))
    begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(order)))
    return order, np.repeat(begins, lengths), np.repeat(lengths, lengths)


def may_share(a: np.ndarray, b: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs of texts a, b may have ``least`` of their shingles in common: those whose sketches differ in no more bits
    than such texts do in shingles. ``sketches`` holds one for each distinct id of ``ids``, in their order."""
    known, at = np.unique(ids, return_index=True)
    size = sizes[at].astype(np.int64)
    out = np.zeros(len(a), bool)
    for begin in range(0, len(a), SKETCH_PAIRS):
        x, y = (np.searchsorted(known, side[begin : begin + SKETCH_PAIRS]) for side in (a, b))
        differ = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
        out[begin : begin + SKETCH_PAIRS] = differ <= (1 - least) / (1 + least) * (size[x] + size[y]) + 1e-6
    return out


def pairs_with_first(
    order: np.ndarray, first: np.ndarray, ids: np.ndarray, sizes: np.ndarray, least: float, sketches: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representatives, others, and in how many groups they met: each of a group with the first REPRESENTATIVES before it, if
    their sizes and, where given, the sketches of the distinct ids allow ``least``."""
    place = np.arange(len(order)) - first
    out = []
    for nth in range(REPRESENTATIVES):
        at = np.flatnonzero(place > nth)
        other, lead = order[at], order[first[at] + nth]
        fits = np.minimum(sizes[other], sizes[lead]) >= least * np.maximum(sizes[other], sizes[lead]) - 1e-9
        out.append(np.stack([ids[lead[fits]], ids[other[fits]]], axis=1))
    pairs = np.concatenate(out)
    if not len(pairs):
        return pairs[:, 0], pairs[:, 1], np.zeros(0, np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    begins = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
    lead, other, met = pairs[begins, 0], pairs[begins, 1], np.diff(np.append(begins, len(pairs)))
    if sketches is None:
        return lead, other, met
    near = may_share(lead, other, ids, sizes, sketches, least)
    return lead[near], other[near], met[near]


def entry_keys(bands: np.ndarray, level: int) -> np.ndarray:
    """Keys (texts x entries) of a level from those of the bands (texts x BANDS): each of ``level`` bands together."""
    if level == 1:
        return bands
    out = []
    for stride in STRIDES:
        keys = np.full(bands.shape, level * 100 + stride, np.uint64)
        for step in range(level):
            keys = mix(keys * np.uint64(MULTIPLIER) + np.roll(bands, -step * stride, axis=1))
        out.append(keys)
    return np.concatenate(out, axis=1)


def found_pairs(classes: DataFrame, level: int, buckets: int, least: float) -> DataFrame:
    """Candidates (a, b, n) among ``classes`` (id, size, bands, from the second level on sketch): b meets a, one of its
    representatives, in n entries of a task or bucket; and a row (id, id, n) for each text of an entry of which not all texts were paired.

    A text stands the higher, the more other texts of its task have entries in common with it: of the edited copies of a text
    the least edited ones do, to which the others are nearest. Of a key that many texts of a task share only the
    representatives are sent on, the other texts are paired with them at once. So a bucket gets a few texts for each
    task, whatever the number of texts that share a key, and there are no more candidates than entries times representatives
    for each text. The texts of a higher level are fewer, and most of them too unlike each other, so their sketches are sent
    along, once for a task and bucket, and a pair that these rule out is not made.
    """

    def packed(buckets_of: np.ndarray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, standing: np.ndarray, known: np.ndarray, sketches: np.ndarray | None) -> pa.RecordBatch:
        order = np.lexsort((keys, buckets_of))
        parts = np.split(order, np.flatnonzero(np.diff(buckets_of[order])) + 1) if len(order) else []
        own = [b"" if sketches is None else sketches[np.searchsorted(known, np.unique(ids[p]))].tobytes() for p in parts]
        rows = [(int(buckets_of[p[0]]), keys[p].tobytes(), halves(ids[p]), sizes[p].astype(np.int32).tobytes(), standing[p].astype(np.int32).tobytes(), o) for p, o in zip(parts, own, strict=True)]
        kinds = (pa.int32(), *[pa.binary()] * 5)
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "ids", "sizes", "standing", "sketches"])

    def crowd(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, met = np.unique(ids, return_counts=True)
        return distinct, distinct, met

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        drawn: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            keys, ids, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            known, at = np.unique(ids[:: len(ids) // sum(map(len, drawn))] if drawn else ids[:0], return_index=True)
            sketches = np.concatenate(drawn)[at] if drawn else None
            order, first, lengths = group_order(keys, np.zeros(len(keys), np.int64), ids)
            shared = np.zeros(len(keys), np.int64)
            shared[order] = np.minimum(lengths - 1, 1 << 20)
            # All keys of a text stand together.
            text = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
            standing = np.bincount(text, weights=shared)[text].astype(np.int64)
            order, first, lengths = group_order(keys, standing, ids)
            place = np.arange(len(order)) - first
            many = lengths > 2 * REPRESENTATIVES
            sent = order[~many | (place < REPRESENTATIVES)]
            bucket = (keys[sent] % np.uint64(buckets)).astype(np.int64)
            # A size below zero: the task holds more texts of the key than it sends.
            held_back = np.zeros(len(keys), bool)
            held_back[order[many]] = True
            yield packed(bucket, keys[sent], ids[sent], np.where(held_back[sent], -sizes[sent], sizes[sent]), standing[sent], known, sketches)
            # Texts that are not sent on meet the representatives of the task here.
            own = order[many]
            begins = np.searchsorted(np.flatnonzero(many), first[many])
            lead, other, met = (np.concatenate(x) for x in zip(pairs_with_first(own, begins, ids, sizes, least, sketches), crowd(ids[own]), strict=True))
            if len(lead):
                yield packed(-1 - (other % buckets), lead.astype(np.uint64), other, met, met, known, None)

        waiting = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("bands"))
            filled = np.diff(offsets) > 0
            if not filled.any():
                continue
            keys = entry_keys(np.frombuffer(data.tobytes(), np.uint64).reshape(-1, BANDS), level)
            ids, sizes = (np.repeat(batch.column(c).to_numpy()[filled], keys.shape[1]) for c in ("id", "size"))
            held.append((keys.ravel(), ids, sizes))
            if level > 1:
                drawn.append(sketch_words(batch.column("sketch").filter(pa.array(filled))))
            waiting += keys.size
            if waiting >= TASK_KEYS:
                yield from rows()
                held, drawn, waiting = [], [], 0
        if held:
            yield from rows()

    def meet(table: pa.Table) -> pa.Table:
        def column(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        keys = column("keys", np.uint64)
        ids = np.concatenate([whole(x) for x in table.column("ids").to_pylist()])
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"a": keys.astype(np.int64), "b": ids, "n": column("sizes", np.int32).astype(np.int64)})
        order, first, lengths = group_order(keys, column("standing", np.int32).astype(np.int64), ids)
        sizes = column("sizes", np.int32)
        held_back = np.bincount(first, weights=sizes[order] < 0, minlength=len(order))[first] > 0
        sketches = None
        if level > 1:
            _, at = np.unique(np.concatenate([np.unique(whole(x)) for x in table.column("ids").to_pylist()]), return_index=True)
            sketches = sketch_words(table.column("sketches"))[at]
        met = zip(pairs_with_first(order, first, ids, np.abs(sizes), least, sketches), crowd(ids[order[held_back | (lengths > REPRESENTATIVES + 1)]]), strict=True)
        return pa.table(dict(zip("abn", map(np.concatenate, met), strict=True)))

    bound_batches(classes.sparkSession)
    return classes.select("id", "size", "bands", *["sketch"] * (level > 1)).mapInArrow(enter, ENTRIES).groupBy("bucket").applyInArrow(meet, "a long, b long, n long")


def sharing(own: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ``own`` (a, b, text_b) of which the texts have at least ``least`` of their shingles in common;
    ``texts`` (id, text) holds that of each ``a``.

    Many texts may be paired with one ``a``: those with the most are spread, as ``lookup`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def shingles(node: pa.Scalar, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            found = known.get(node.as_py())
            if found is None:
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                found = np.unique(next(shingle_hashes(data, np.array([0, len(data)]))))
                if size > KNOWN_SHINGLES:
                    known.clear()
                    size = 0
                known[node.as_py()] = found
                size += len(found)
            return found

        for batch in batches:
            kept = []
            for a, b, text, other in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                mine, others = shingles(a, text), shingles(b, other)
                common = len(np.intersect1d(mine, others, assume_unique=True))
                kept.append(common >= least * (len(mine) + len(others) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    named = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = lookup(own, named, key="a", row_id="b", name="text_a", heavy=heavy_keys(own.select("a"), "a"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, a, leads, text): one text of each of the classes ``wanted`` (id, least, key, a, leads), found by doc_id and key."""

    def place(doc_id: str):
        return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"), F.col("key")).alias("place")

    named = identified(docs).withColumn("key", text_key(F.col("text"))).select(place("doc_id"), "text")
    met = named.join(wanted.select(place("least"), "id", "a", "leads"), "place")
    return met.groupBy("place", "id", "a", "leads").agg(F.first("text").alias("text")).drop("place")


def similar_links(docs: DataFrame, classes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among the pairs ``found`` (a, b, distance) that make the same components as all of them with the share would.

    Each text is compared with the nearest that it was found with. Then only pairs between different components are left
    to compare, so texts of a large group are read once or twice, not once for each pair.
    """
    nearest = found.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("near")).select(F.col("near.a").alias("a"), "b")
    leading = found.select(F.col("a").alias("id")).distinct().withColumn("leads", F.lit(True))
    keyed = classes.select("id", "least", "key").join(nearest.withColumnRenamed("b", "id"), "id", "left").join(leading, "id", "left")
    # Written first, so that its size is known: where few texts are wanted, the others are not shuffled.
    wanted = stage(keyed.where("a is not null or leads"), "wanted-texts")
    texts = stage(class_texts(docs, wanted), "similar-texts")
    release(wanted)
    leads = texts.where("leads").select("id", "text")
    sure = stage(sharing(texts.where("a is not null").select("a", F.col("id").alias("b"), F.col("text").alias("text_b")), leads, least), "nearest-links")
    named = components(sure)
    rest = found.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    for end in "ab":
        rest = rest.join(named.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    apart = stage(rest.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b"), "pairs-apart")
    own = apart.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stage(sure.union(sharing(own, leads, least)), "wide-links")
    release(texts, sure, apart)
    return links


def cells_of(own: DataFrame) -> tuple[DataFrame, int]:
    """Texts of each entry of ``own`` (id, size, bands, sketch, component) that holds texts of several components, dealt to cells
    so that any two of different components share one: CELLS, and the number of rows.

    The largest component of an entry is set against the others, and these against each other, CELL_TEXTS by CELL_TEXTS, so the
    work on an entry is spread whatever its size, and most of it falls away where the texts of an entry are linked already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = text_bytes(batch.column("bands"))
            columns = [np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("id", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.frombuffer(data.tobytes(), np.int64), *columns)], ["key", "id", "component"])

    entries = own.select("id", "component", "bands").mapInArrow(run, "key long, id long, component long")
    each = entries.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    entry = each.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("lead")).where("total > lead.n")
    parts = F.struct(
        F.col("lead.component").alias("lead"),
        F.ceil(F.col("lead.n") / CELL_TEXTS).alias("leading"),
        F.ceil((F.col("total") - F.col("lead.n")) / CELL_TEXTS).alias("others"),
        "total",
        F.col("lead.n").alias("n"),
    )
    mixed = stage(entry.select("key", parts.alias("parts")), "mixed-entries")
    rows = mixed.agg(F.expr("sum(parts.n * parts.others + (parts.total - parts.n) * (parts.leading + parts.others))")).first()[0]
    named = entries.join(mixed.select("key"), "key", "left_semi")
    met = lookup(named, mixed, key="key", row_id="id", name="parts", heavy=heavy_keys(named.select("key"), "key"))
    # A cell is numbered by its parts: of others and of the largest component, or of two parts of others.
    is_lead = "component = parts.lead"
    part = F.expr(f"pmod(xxhash64(id), if({is_lead}, parts.leading, parts.others))").alias("part")
    against_lead = "transform(sequence(0L, parts.leading - 1), j -> struct((part * 1048576 + j) * 2 as cell, false as upper))"
    among_others = "transform(sequence(0L, parts.others - 1), j -> struct((least(part, j) * 1048576 + greatest(part, j)) * 2 + 1 as cell, part > j as upper))"
    of_lead = "transform(sequence(0L, parts.others - 1), i -> struct((i * 1048576 + part) * 2 as cell, true as upper))"
    dealt = met.withColumn("part", part).select("key", "id", "component", F.explode(F.expr(f"if({is_lead}, {of_lead}, concat({against_lead}, {among_others}))")).alias("c"))
    return dealt.select("key", "c.cell", "c.upper", "id", "component").join(own.select("id", "size", "sketch"), "id").select(*[f.split()[0] for f in CELLS.split(", ")]), rows or 0


def pairs_apart(own: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, distance) of ``own`` (id, size, bands, sketch, component) of different components that have a band in common and
    may have ``least`` of their shingles in common: all whose sketches differ in no more bits than such texts do in shingles."""
    cells, rows = cells_of(own)
    allowed = (1 - least) / (1 + least)

    def compare(table: pa.Table) -> pa.Table:
        keys, cell, ids, component, size = (table.column(c).to_numpy() for c in ("key", "cell", "id", "component", "size"))
        upper = table.column("upper").to_numpy().astype(np.int64)
        sketches = sketch_words(table.column("sketch"))
        order = np.lexsort((upper, cell, keys))
        keys, cell, ids, component, size, upper, sketches = (x[order] for x in (keys, cell, ids, component, size, upper, sketches))
        size = size.astype(np.int64)
        # A cell of two parts has pairs across them only.
        across = (cell % 2 == 0) | (cell // 2 // 1048576 != cell // 2 % 1048576)
        begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (cell[1:] != cell[:-1])]))
        ends = np.append(begins[1:], len(ids))
        found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]

        def check(a: np.ndarray, b: np.ndarray) -> None:
            fits = (component[a] != component[b]) & (~across[a] | (upper[a] != upper[b]))
            a, b = a[fits], b[fits]
            differ = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
            near = (differ <= allowed * (size[a] + size[b]) + 1e-6) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
            a, b = a[near], b[near]
            if len(a):
                found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), differ[near]], axis=1))

        small = ends - begins <= SMALL_CELL
        end_of = np.repeat(np.where(small, ends, begins), ends - begins)
        at = np.arange(len(ids))
        for step in range(1, SMALL_CELL):
            at = at[at + step < end_of[at]]
            check(at, at + step)
        words = np.ascontiguousarray(sketches.T)
        for begin, end in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
            # The first part stands before the other.
            middle = begin + int(np.searchsorted(upper[begin:end], 1)) if across[begin] else end
            for first in range(begin, middle, 64):
                last, other = min(first + 64, middle), middle if across[begin] else first + 1
                differ = np.zeros((last - first, end - other), np.uint16)
                for word in words:
                    differ += np.bitwise_count(word[first:last, None] ^ word[None, other:end])
                a, b = np.nonzero(differ <= allowed * (size[first:last, None] + size[None, other:end]) + 1e-6)
                later = b + other > a + first
                check(a[later] + first, b[later] + other)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table(dict(zip(("a", "b", "distance"), pairs.T, strict=True)))

    bucket = F.pmod(F.xxhash64("key", "cell"), F.lit(rows // CELL_ROWS + 1)).alias("bucket")
    return cells.select("*", bucket).groupBy("bucket").applyInArrow(compare, "a long, b long, distance long").distinct()


def links_of(docs: DataFrame, classes: DataFrame, met: list[DataFrame], least: float) -> DataFrame:
    """Links (a, b) among the candidates of all levels."""
    if not met:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    pairs = reduce(DataFrame.union, met).where("a != b")
    # Those that meet in the most entries are the nearest.
    found = stage(pairs.groupBy("a", "b").agg((-F.sum("n")).alias("distance")), "candidates")
    release(*met)
    links = similar_links(docs, classes, found, least)
    release(found)
    return links


def links_apart(docs: DataFrame, classes: DataFrame, meeting: DataFrame, linked: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that those of the representatives leave out, between the texts ``meeting`` (id) where not all were paired."""
    named = components(linked).withColumnRenamed("node", "id")
    own = classes.join(meeting, "id", "left_semi").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = stage(own.select("id", "size", "bands", "sketch", "component"), "texts-apart")
    found = stage(pairs_apart(own, least), "pairs-of-components")
    release(own, meeting)
    links = similar_links(docs, classes, found, least) if found.head(1) else linked.limit(0)
    release(found)
    return links


def similar_texts(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Group texts that have at least ``least`` of their shingles of five words in common: (doc_id, component_id).

    Only such pairs link, and all of them that have a band in common: each text is compared with the representatives of the
    bands it is in, and where more texts meet, all those that this leaves in different groups are compared. Blank and null texts are alike. A null doc_id stays null and is never the smallest, unless its group has no other.
    """
    prints = stage(shingle_bands(docs), "shingle-bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    grouped = prints.groupBy("set", "size").agg(first.alias("first"), F.first(F.struct("bands", "sketch")).alias("own"))
    named = grouped.select("set", "size", "own.*", F.col("first.doc_id").alias("least"), F.col("first.key").alias("key"))
    classes = stage(named.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    met = []
    crowded = classes
    for level in range(1, LEVELS + 1):
        total = crowded.where("size > 0").count() * BANDS * (len(STRIDES) if level > 1 else 1)
        if not total:
            break
        met.append(stage(found_pairs(crowded, level, total // BUCKET_KEYS + 1, least), "found-pairs"))
        if level == 1:
            meeting = stage(met[-1].where("a = b").select(F.col("a").alias("id")).distinct(), "crowded-texts")
        crowded = classes.join(met[-1].where("a = b").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    linked = links_of(docs, classes, met, least)
    if met:
        linked = linked.union(links_apart(docs, classes, meeting, linked, least))
    joined = classes.select("set", "size", "id", "least").join(components(linked).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    table = joined.join(smallest, "component").select("set", "size", "component_id")
    return prints.select("doc_id", "set", "size").join(table, ["set", "size"]).select("doc_id", "component_id")


def all_near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups by either measure, joined where they share a text: (doc_id, component_id). ``docs`` has distinct ids."""
    close = near_duplicates(docs).select("doc_id", F.col("component_id").alias("close"))
    similar = similar_texts(docs).select("doc_id", F.col("component_id").alias("similar"))
    both = stage(close.join(similar, "doc_id"), "near-duplicates")
    # A group is named by its smallest id, so only groups that differ need joining.
    named = components(both.where("close != similar").select(F.col("close").alias("a"), F.col("similar").alias("b")).distinct())
    joined = both.join(named.withColumnRenamed("node", "close"), "close", "left")
    return joined.select("doc_id", F.coalesce("component", "close").alias("component_id"))
