"""Language identification with bit-sliced Bloom filters.

An n-gram is three code points around a letter, everything that is no letter being one boundary sign. A filter has a
bit for each language at each of its slots, so one look-up returns all languages that an n-gram occurs in. A text's
hits are counted for each language, the hits that a filter of that fill gives by chance are taken off, and the language
with the most remaining hits wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import annotate, identified, mix, restored, slices, text_bytes
from folioforge.operators.staging import stage

# An n-gram counts as one of a language if it makes up this share of its n-grams, so a language has at most the inverse.
LEAST_SHARE = 1 / 20_000
HASHES = 3
# Slots for each n-gram of any language.
SLOTS_PER_GRAM = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageFilter:
    """``planes``: for each eight languages a byte for each slot."""

    languages: tuple[str, ...]
    planes: np.ndarray

    def false_hits(self) -> np.ndarray:
        """Chance, for each language, that an n-gram foreign to it is returned."""
        bits = np.unpackbits(self.planes, axis=0, bitorder="little")[: len(self.languages)]
        return bits.mean(axis=1) ** HASHES


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, each as one number, and the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[~letters()[points]] = 0
    centre = np.flatnonzero(points)
    values = points[centre - 1] << 42 | points[centre] << 21 | points[centre + 1]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return values, np.searchsorted(ends, centre, "left")


def slots(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Slots of n-grams by double hashing; ``size`` is a power of two."""
    hashed = mix(values.astype(np.uint64))
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return [((hashed + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def count_grams(labelled: DataFrame) -> DataFrame:
    """Occurrences of each n-gram by language: (lang, gram, n), summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (values, counts) in known.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for first, last in slices(text_bytes(texts)[1]):
                values, row = grams([t or "" for t in texts.slice(first, last - first).to_pylist()])
                names, code = np.unique(np.array(langs.slice(first, last - first).to_pylist(), object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    own, counts = np.unique(values[code[row] == i], return_counts=True)
                    if str(name) in known:
                        before, earlier = known[str(name)]
                        own, at = np.unique(np.concatenate([before, own]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([earlier, counts]), len(own)).astype(np.int64)
                    known[str(name)] = (own, counts.astype(np.int64))
            if sum(len(v) for v, _ in known.values()) > 1_000_000:
                yield from rows()
                known = {}
        yield from rows()

    return labelled.mapInArrow(run, "lang string, gram long, n long")


def train(labelled: DataFrame) -> LanguageFilter:
    """Fill the filters from rows (text, lang); rows without lang teach nothing.

    All rows are counted. What comes to the driver is at most 1 / LEAST_SHARE n-grams for each language.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = stage(count_grams(rows.where("lang is not null and text is not null")), "language-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    typical = summed.join(totals, "lang").where(F.col("n") >= F.col("total") * LEAST_SHARE).select("lang", "gram").toPandas()
    languages = tuple(sorted(typical["lang"].unique()))
    size = 1 << max(10, int(len(typical) * SLOTS_PER_GRAM - 1).bit_length())
    planes = np.zeros((max(1, -(-len(languages) // 8)), size), np.uint8)
    for number, language in enumerate(languages):
        values = typical.loc[typical["lang"] == language, "gram"].to_numpy(np.int64)
        for slot in slots(values, size):
            planes[number // 8, slot] |= np.uint8(1 << number % 8)
    return LanguageFilter(languages, planes)


def score_texts(texts: list[str], model: LanguageFilter) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: no letter, or no language known) and score of each text."""
    values, row = grams(texts)
    n = np.bincount(row, minlength=len(texts))[: len(texts)]
    if not model.languages:
        return np.full(len(texts), -1), np.zeros(len(texts))
    places = slots(values, model.planes.shape[1])
    hits = []
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    for plane in model.planes:
        masks = plane[places[0]]
        for slot in places[1:]:
            masks = masks & plane[slot]
        tally = np.bincount(row * 256 + masks, minlength=len(texts) * 256).reshape(len(texts), 256)
        hits.append(tally @ bits)
    counts = np.concatenate(hits, axis=1)[:, : len(model.languages)]
    chance = np.minimum(model.false_hits(), 0.999)
    corrected = np.clip((counts - n[:, None] * chance) / (1 - chance), 0, n[:, None])
    best = corrected.argmax(axis=1)
    score = corrected[np.arange(len(texts)), best] / np.maximum(n, 1)
    return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Language of each whole text: (doc_id, lang_pred, score).

    ``score``: share of the text's n-grams that its language holds, less chance hits. ``und`` with score 0 for null
    texts, texts without a letter, and where no language was learned; of equally good languages the first by name. One
    row for each row; a null doc_id stays null.
    """
    # A few hundred kilobytes for each eight languages: LEAST_SHARE bounds the n-grams.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            for begin, end in slices(text_bytes(texts)[1]):
                for first in range(begin, end, 4096):
                    last = min(end, first + 4096)
                    number, score = score_texts([t or "" for t in texts.slice(first, last - first).to_pylist()], own)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, last - first), pa.array(names[number], pa.string()), pa.array(score)],
                        ["doc_id", "lang_pred", "score"],
                    )

    return identified(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageFilter, least_score: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language and at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[str]) -> list[pa.Array]:
        number, score = score_texts(texts, shared.value)
        return [pa.array((number >= 0) & (score >= least_score))]

    return restored(annotate(docs, judge, "known boolean").where("known"), docs)
