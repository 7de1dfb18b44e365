import hashlib

import pytest
from pyspark.sql import functions as F

from voxfabric.llm import chat, queries

HARD = [None, "", "plain", "\\", "\\\\", "</turn>", "<\\/turn>", "</turn>\n", "</turn", "<", "###", "####", "#\\##", "### user:\n", "\\### Assistant: </turn> ok", "</turn></turn>\n### a:\nb", "é\U0001f600\n\n", "x\r\n\0 </turn", "#" * 50_000 + "</turn>" * 20_000, ":\n"]
MARKS = ("</turn>", "###")


def rows(spark, table):
    return spark.createDataFrame(table, "conv_id long, turn long, role string, text string")


def read(formatted):
    made = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: (r.formatted, [tuple(t) for t in r.turns], list(r.loss)) for r in made.collect()}


def test_hard_texts_and_roles_come_back(spark):
    table = [(1, i, ("assistant", "user")[i % 2], t) for i, t in enumerate(HARD)] + [(2, i, t, "x") for i, t in enumerate(HARD)]
    found = read(chat.formatted(chat.canonical_turns(rows(spark, table).repartition(3))))
    assert found[1][1] == [(r, t or "") for _, _, r, t in table[: len(HARD)]]
    assert found[1][2] == [t or "" for _, _, r, t in table[: len(HARD)] if r == "assistant"]
    assert found[2][1] == [(t or "", "x") for t in HARD] and found[2][2] == []
    escaped = spark.createDataFrame([(t or "",) for t in HARD], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back"), "t").collect()
    assert all(r.back == r.t and not any(m in r.e for m in MARKS) for r in escaped)


def test_order_ties_repeats_and_null_ids(spark):
    table = [(5, 2, "user", "c"), (5, 0, "user", "a"), (5, 1, "b", "z"), (5, 1, "b", "y"), (5, 1, "a", "q"), (5, 1, "a", "q"), (5, None, "user", "first"), (None, 0, "assistant", "n"), (6, 0, None, None), (7, None, None, None)]
    found = read(chat.formatted(chat.canonical_turns(rows(spark, table))))
    assert found[5][1] == [("user", "first"), ("user", "a"), ("a", "q"), ("a", "q"), ("b", "y"), ("b", "z"), ("user", "c")]
    assert found[None][1] == [("assistant", "n")] and found[6][1] == found[7][1] == [("", "")]
    assert read(chat.formatted(chat.canonical_turns(rows(spark, table).where("false")))) == {}


def test_layouts_by_fingerprint(spark, tmp_path):
    """A mixed file of records, with fields of no layout and clashing names, as Spark reads it."""
    lines = [
        '{"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}]}',
        '{"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "record": "clash", "layout": {"x": 1}}',
        '{"conv_id": 3, "instruction": "do", "input": "this", "output": "done", "a.b": 3}',
        '{"conv_id": 4, "instruction": "do", "output": "done", "system": "be brief"}',
        '{"conv_id": 5, "prompt": "p", "response": "r"}',
        '{"conv_id": 6, "prompt": "p", "completion": "c", "fingerprint": "f"}',
        '{"conv_id": 7, "messages": [{"role": "user", "parts": [{"text": "one "}, {"text": "two"}]}]}',
        '{"conv_id": 8, "prompt": "p", "instruction": "both"}',
        '{"conv_id": 9, "messages": []}',
        '{"conv_id": 10, "turn": 1, "role": "user", "text": "second"}',
        '{"conv_id": 10, "turn": 0, "role": "user", "text": "first"}',
    ]
    (tmp_path / "mixed.json").write_text("\n".join(lines))
    turns = chat.canonical_turns(spark.read.json(str(tmp_path / "mixed.json")))
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got == {
        1: [("messages", "user", "hi"), ("messages", "assistant", "")],
        2: [("from and value", "user", "q"), ("from and value", "assistant", "a")],
        3: [("instruction", "user", "do\n\nthis"), ("instruction", "assistant", "done")],
        4: [("instruction", "system", "be brief"), ("instruction", "user", "do"), ("instruction", "assistant", "done")],
        5: [("prompt and response", "user", "p"), ("prompt and response", "assistant", "r")],
        6: [("prompt and completion", "user", "p"), ("prompt and completion", "assistant", "c")],
        7: [("message parts", "user", "one two")],
        8: [(None, None, None)],
        9: [("messages", None, None)],
        10: [("rows", "user", "first"), ("rows", "user", "second")],
    }
    text, back, loss = read(chat.formatted(turns))[8]
    assert (text, back, loss) == ("", [], [])


def test_layouts_must_differ():
    twin = chat.Layout("twin", ("prompt",), ("response",), turns=(("user", ("prompt",)),))
    with pytest.raises(ValueError, match="two layouts"):
        chat.canonical_turns(_Never(), (*chat.LAYOUTS, twin))


class _Never:
    schema = sparkSession = columns = None


def test_query_reads_back_the_hard_conversation(spark):
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = queries.HARD_TEXT
    assert text == "\\### Assistant: </turn> ok"
    hard = got[-7]
    assert (hard.n_turns, hard.loss_chars, hard.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert hard.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert len(got) == 1 + spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
