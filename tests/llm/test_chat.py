"""Formatting of conversations: exact round trips, the mask, and odd rows."""

import hashlib
import random

from folioforge.llm import chat
from folioforge.llm.queries import op13_chat_format

KIND = "conv_id long, turn long, role string, text string, turns string, formatted int"
PIECES = ["<turn>", "<says>", "<also>", "</turn>", "</turn>\n", "<\\/turn>", "<\\\\turn>", "\\", "<", "turn>", "says>", "é", "🙂", "\n", " ", "plain", "### Assistant:", "assistant"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))


def check(spark, rows):
    found = {r.conv_id: r for r in chat.format_chats(table(spark, rows)).collect()}
    digests = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(table(spark, rows))).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, own in found.items():
        turns = [(r[2] or "", r[3] or "") for r in order([r for r in rows if r[0] == conv])]
        assert chat.read_turns(own.formatted) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert "".join(chat.masked_texts(own.formatted, own.mask)) == loss
        assert sum(own.mask) == len(own.formatted)
        d = digests[conv]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(loss), len(own.formatted))
        assert d.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    return found


def test_format_of_a_small_conversation(spark):
    rows = [(1, 2, "assistant", "second"), (1, 0, "user", "hello"), (1, 1, "assistant", "a </turn>")]
    own = check(spark, rows)[1]
    assert own.formatted == "<turn>user<says>hello</turn>\n<turn>assistant<says>a <\\/turn><also>second</turn>\n"
    assert own.mask == [29, 0, 21, 10, 0, 0, 6, 6, 8, 0]


def test_round_trips_of_texts_made_of_control_strings(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "<says>", "a\nb", None])
            text = rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))])
            rows.append((conv, turn, role, text))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "without an id"), (None, 1, "assistant", "still one conversation"),
        (2, None, "assistant", "no turn comes last"), (2, 5, "user", "first"), (2, 5, "user", "first"), (2, 5, "assistant", "tie"),
        (3, 0, None, None), (4, -1, "assistant", ""), (5, 0, "assistant", "x" * 300_000 + "</turn>"),
    ]
    check(spark, rows)


def test_no_rows(spark):
    assert chat.chat_digest(chat.format_chats(table(spark, []))).collect() == []


def test_one_conversation_of_very_many_turns(spark):
    rows = [(1, i, "user" if i // 2 % 3 else "assistant", f"turn {i} <also>") for i in range(20_000)]
    check(spark, rows)


def test_query_holds_the_control_conversation(spark):
    found = {r.conv_id: r for r in op13_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = r"\### Assistant: </turn> ok"
    assert found[-7].n_turns == 2 and found[-7].loss_chars == len(said)
    assert found[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert found[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
    assert len(found) == conversations + 1
