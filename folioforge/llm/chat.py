"""Chat formatting by relational means: turns are collected as structs, sorted, merged and joined by Spark expressions.

A block of the output is ``<turn>role<says>text</turn>`` and a line feed; adjacent turns of one role share a block, with
``<also>`` between their texts, so nothing is lost by the merge. A control string that stands in a text or a role gets a
backslash after its angle bracket (``</turn>`` is written ``<\\/turn>``, that one with two, and so on), which keeps all
other text as it is and can be undone. What a model learns from is marked beside the text, as lengths of alternating runs
of code points outside and inside the mask.

Formatting is Spark expressions only, each linear in the length of a conversation. Reading back is a pass over the
characters of the output, in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import bound_batches

TURN, SAYS, ALSO, END = "<turn>", "<says>", "<also>", "</turn>\n"
CONTROL = r"(turn>|says>|also>|/turn>)"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)" + CONTROL, r"<\\$1$2")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)" + CONTROL, r"<\1\2", text)


def format_chats(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row for each conv_id: (conv_id, formatted, mask), ``mask`` being the lengths of runs of code points, outside
    the mask first, then inside, and so on; texts of the role ``learned`` are inside, escapes included.

    Turns come by turn, nulls last, then role and text, so ties and repeated rows have a defined order; all of them
    stay. A null role or text counts as empty. Turns without a conv_id are one conversation, whose conv_id is null.
    A conversation is one cell of the result, so its turns meet in one task, as they have to.
    """
    cell = F.struct(
        F.col("turn").isNull().alias("none"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), cell.alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # Where a block starts: a turn whose predecessor has another role. A block ends where the next one starts.
    numbers = F.sequence(F.lit(1), F.size("turns"))
    starts = F.filter(numbers, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    cut = sorted_turns.withColumn("starts", starts)

    def block(start: Column, number: Column) -> Column:
        after = F.when(number + 1 < F.size("starts"), F.element_at("starts", F.least(number + 2, F.size("starts")))).otherwise(F.size("turns") + 1)
        merged = F.slice("turns", start, after - start)
        return F.struct(F.element_at("turns", start)["role"].alias("role"), F.transform(merged, lambda t: escaped(t["text"])).alias("texts"))

    blocks = cut.select("conv_id", F.transform("starts", block).alias("blocks"))
    said = F.transform("blocks", lambda b: F.concat(F.lit(TURN), escaped(b["role"]), F.lit(SAYS), F.array_join(b["texts"], ALSO), F.lit(END)))
    return blocks.select("conv_id", F.array_join(said, "").alias("formatted"), mask("blocks", learned).alias("mask"))


def mask(blocks: str, learned: str) -> Column:
    """Run lengths, a pair for each piece of text: what lies before it outside the mask, and the text if it is learned.
    A text that is not learned has its length counted outside, so runs inside may be empty, and the last run is outside."""
    before = F.char_length(F.lit(TURN)) + F.char_length(F.lit(SAYS))

    def pairs(b: Column) -> Column:
        head = before + F.char_length(escaped(b["role"]))
        return F.transform(
            b["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(len(ALSO))).alias("outside"),
                F.char_length(text).alias("chars"),
                (b["role"] == learned).alias("inside"),
                F.when(i == F.size(b["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("after"),
            ),
        )

    pieces = F.flatten(F.transform(blocks, pairs))
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(p["inside"], F.array(p["outside"], p["chars"], p["after"], F.lit(0))).otherwise(
                F.array(p["outside"] + p["chars"] + p["after"], F.lit(0))
            ),
        )
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of the output."""
    out = []
    for block in formatted.split(END)[:-1]:
        role, texts = block.removeprefix(TURN).split(SAYS, 1)
        out.extend((unescaped(role), unescaped(text)) for text in texts.split(ALSO))
    return out


def masked_texts(formatted: str, runs: list[int]) -> list[str]:
    """What lies under the mask, run by run, escapes undone."""
    out, at = [], 0
    for outside, inside in zip(runs[::2], runs[1::2], strict=True):
        at += outside
        if inside:
            out.append(unescaped(formatted[at : at + inside]))
        at += inside
    return out


def chat_digest(chats: DataFrame) -> DataFrame:
    """What is read back from the output of each conversation: turns, and the text under the mask."""
    bound_batches(chats.sparkSession)
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for formatted, runs in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns, loss = read_turns(formatted), "".join(masked_texts(formatted, runs))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                values = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], [c.split()[0] for c in kind.split(", ")])

    return chats.select("conv_id", "formatted", "mask").mapInArrow(run, kind)


def with_control_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one more conversation, whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
