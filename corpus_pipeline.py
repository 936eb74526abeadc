"""The corpus pipeline: language ID, near duplicates, repeated bytes, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``.
All but the last keep the columns of ``documents``, whatever further ones there are and whatever their names. Rows are
told apart by id and text where they have to be, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontamination, langid, pieces, simhash, suffixes
from folioforge.llm.common import text_key
from folioforge.llm.queries import piece_model, table
from folioforge.operators.staging import stage

# A text of which less than this share of n-grams belongs to its language is in none of those known.
LEAST_LANGUAGE_SCORE = 0.25


# Bytes from which on a repeated string is removed: what 51 words take up, in all but one of a hundred places of the texts.
REPEATED_BYTES = 230


def plainly_named(docs: DataFrame) -> DataFrame:
    """Columns c0, c1, ..., whatever names ``docs`` has for them, and ``key``, which stands for the text."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumn("key", text_key(F.col(f"c{docs.columns.index('text')}").cast("string")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts in none of the languages that the labelled rows teach."""
    model = langid.train(docs.select("text", "lang"))
    return langid.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: texts whose fingerprints of 64 bits differ in at most two,
    or that share four in five of their shingles of five words. The one with the smallest id stays; a null id
    only if there is no other, and any one of several rows with the same id and text."""
    rows = plainly_named(docs)
    doc_id = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    # Rows with one id and different texts are different documents, so id and text together name a row.
    named = rows.select(doc_id.alias("id"), "key", F.xxhash64(doc_id, "key").alias("row"), F.col(f"c{docs.columns.index('text')}").cast("string").alias("text"))
    groups = simhash.all_near_duplicates(named.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    chosen = named.select("id", "key", "row").join(groups.distinct(), "row").groupBy("component_id").agg(first).select("first.id", "first.key")
    # Both sides are dealt out by id and key, so the text is shuffled once.
    single = rows.withColumn("id", doc_id).dropDuplicates(["id", "key"])
    kept = single.join(chosen.withColumnRenamed("id", "_id").withColumnRenamed("key", "_key"), (F.col("id").eqNullSafe(F.col("_id"))) & (F.col("key") == F.col("_key")), "left_semi")
    return kept.drop("id", "key").toDF(*docs.columns)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings of bytes from the texts, with what they leave of code points that they cut; n_chars
    follows. A document of which only white space is left goes; one that was blank or null before stays as it is."""
    rows = plainly_named(docs)
    spans = suffixes.repeated_spans(docs, REPEATED_BYTES).where(F.size("starts") > 0).select("key", "starts", "ends")
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars")
    joined = rows.join(spans, "key", "left").drop("key").withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(at).to_pylist()
                for i, (starts, ends) in enumerate(zip(part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True)):
                    if starts:
                        own = texts[i].encode()
                        texts[i] = b"".join(own[b:e] for b, e in zip([0, *ends], [*starts, len(own)], strict=True)).decode(errors="ignore")
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    left = joined.mapInArrow(cut, joined.schema).where("starts is null or " + f"c{at}" + r" rlike '[^\\x20\\x09-\\x0D]'")
    length = F.when(F.col("starts").isNotNull(), F.char_length(f"c{at}")).otherwise(F.col(f"c{chars}"))
    kind = docs.schema["n_chars"].dataType
    return left.withColumn(f"c{chars}", length.cast(kind)).drop("starts", "ends").toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the text that they decode to: (doc_id, n_tokens, ids, text)."""
    model = piece_model()
    return pieces.decode(pieces.encode(docs, model), model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeated_text", repeated_text),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

# No stage but the first could be written in SQL: the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
