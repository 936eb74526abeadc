"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model may hold a whitespace marker after another character, so no piece crosses the start of a marked
word, and a text's ids are those of its marked words one after the other. A task keeps a table of the distinct marked
words it has met, has the library segment each of them once, and joins their ids back by position. A model whose
pieces do cross markers, or that changes characters before it segments, has whole texts segmented instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import identified, slices, text_bytes

MARKER = "▁"
# Distinct chunks that a task remembers; beyond, it starts a new table.
TABLE_ENTRIES = 200_000
MARKED = re.compile(f"{MARKER}+[^{MARKER}]*")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=2)
def can_chunk(model: str) -> bool:
    """Whether marked words are segmented independently: no piece crosses a marker, nothing is normalised, and a text
    begins with a marker."""
    own = processor(model)
    pieces = (own.id_to_piece(i) for i in range(own.get_piece_size()))
    crossing = any(MARKER in p.lstrip(MARKER) for p in pieces)
    probe = "ﬁ  Å\t１"
    return not crossing and own.normalize(probe) == MARKER + probe.replace(" ", MARKER) and own.piece_to_id(MARKER) != own.unk_id()


def chunks(text: str) -> list[str]:
    """Marked words of a text, each without its first marker and with spaces for the others."""
    if not text:
        return []
    if "  " in text or MARKER in text or text[0] == " " or text[-1] == " ":
        marked = MARKER + text.replace(" ", MARKER)
        return [m[1:].replace(MARKER, " ") for m in MARKED.findall(marked)]
    return text.split(" ")


class ChunkTable:
    """Ids of distinct chunks, laid end to end."""

    def __init__(self, model: str):
        self.model, self.marker = processor(model), processor(model).piece_to_id(MARKER)
        self.number: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, new: list[str]) -> None:
        # The library adds the marker in front; a lone marker it would take for an empty text.
        found = [own or [self.marker] for own in self.model.encode(new, num_threads=1)]
        for chunk in new:
            self.number[chunk] = len(self.number)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for own in found for i in own), np.int32, int(lengths.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each."""
        if len(self.number) > TABLE_ENTRIES:
            self.number, self.ids, self.begin = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        split = [chunks(t) for t in texts]
        flat = [c for own in split for c in own]
        if new := [c for c in dict.fromkeys(flat) if c not in self.number]:
            self.add(new)
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        begin, lengths = self.begin[at], self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(begin - (ends - lengths), lengths) + np.arange(total)]
        per_text = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate([[0], ends])[per_text]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids of each whole text, as the library encodes it: (doc_id, ids). Null and empty texts have no ids; every row
    gives one row, repeated ones too, and a null doc_id stays null. ``model`` is a path that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model) if can_chunk(model) else None
        for batch in batches:
            texts = batch.column("text")
            offsets = text_bytes(texts)[1]
            for first, last in slices(offsets):
                part = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                if table is not None:
                    ids, bounds = table.encode(part)
                else:
                    found = processor(model).encode(part, num_threads=1)
                    bounds = np.cumsum([0, *map(len, found)])
                    ids = np.fromiter((i for own in found for i in own), np.int32, int(bounds[-1]))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], ["doc_id", "ids"])

    return identified(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of lists of ids, by the library's decode: (doc_id, ids, text). Null lists count as empty, whose text is
    empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [own.decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    columns = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return columns.mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
