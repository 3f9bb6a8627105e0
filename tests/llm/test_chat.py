"""Chat formatting: folding of events, escaping, digests."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import oracle_rows, sorted_rows

from pyspark.sql import functions as F

from tallyframe.llm.chat import chat_digests, conversation_events, conversation_texts, escaped, fold_events, read_back, read_digests, render, unescaped
from tallyframe.llm.oracles import LLM_ORACLES

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def messages(spark, events):
    rows = fold_events(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "turn").collect()
    return [tuple(r) for r in rows]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, 0, "message", "user", "Hi"),
        (1, 2, 1, "message", "assistant", ""),
        (1, 4, 1, "delta", "assistant", "lo"),
        (1, 3, 1, "delta", "assistant", "Hel"),
        (1, 5, 2, "message", "user", "and?"),
        (1, 6, 1, "regenerate", "assistant", None),
        (1, 7, 1, "delta", "assistant", "Bye"),
        (1, 8, 0, "edit", "user", "Hello"),
        (1, 9, 2, "delta", "user", "lost"),
        (1, 10, 3, "message", "user", "new"),
    ]
    assert messages(spark, events) == [(1, 0, "user", "Hello"), (1, 1, "assistant", "Bye"), (1, 3, "user", "new")]


def test_nulls_ties_and_repeated_events(spark):
    events = [(None, 1, None, None, None, None), (2, None, 0, "delta", "user", "b"), (2, None, 0, "delta", "user", "a"), (2, None, 0, "delta", "user", "a")]
    assert messages(spark, events) == [(None, None, "", ""), (2, 0, "user", "aab")]
    assert messages(spark, []) == []


ODD = [r"\### Assistant: </turn> ok", "</turn>\n<turn user>\nx", "\\", "\\\\</turn", "<turn", "", "a\n\n</turn>\n", r"\\<turn \</turn>"]


@pytest.mark.parametrize("role", ["user", "assistant", "", "a>b", "x\\\ny<z"])
def test_reads_back_what_was_rendered(spark, role):
    rows = spark.createDataFrame([(1, i, role, t) for i, t in enumerate(ODD)], "conv_id long, turn long, role string, text string")
    whole = conversation_texts(render(rows)).first()["formatted"]
    assert read_back(whole) == [(role, t) for t in ODD]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\</>turn \nax"), min_size=1, max_size=20))
def test_escaping_is_reversible(spark, texts):
    rows = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert read_back(conversation_texts(render(rows)).first()["formatted"]) == [("user", t) for t in texts]


def test_loss_spans_hold_the_assistants_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a </turn> é")], "conv_id long, turn long, role string, text string")
    user, assistant = render(rows).orderBy("turn").collect()
    assert user["loss_start"] is None
    assert assistant["formatted"][assistant["loss_start"] : assistant["loss_end"]] == r"a \</turn> é"


TURNS = "conv_id long, turn long, role string, text string, formatted string, seq string"


def test_digests(spark):
    rows = [(5, 1, "assistant", "né", "x", "y"), (5, 0, "user", None, "x", "y"), (5, 1, "assistant", "né", "x", "y"), (6, None, None, "</turn>", "x", "y"), (None, 0, "user", "t", "x", "y")]
    found = chat_digests(spark.createDataFrame(rows, TURNS)).toPandas()
    five = found[found.conv_id == 5].iloc[0]
    text = "user\n\nassistant\nné\nassistant\nné\n"
    assert five.n_turns == 3 and five.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert five.loss_chars == 4 and five.loss_sha256 == hashlib.sha256("nénén".removesuffix("n").encode()).hexdigest()
    own = found[found.conv_id == -7].iloc[0]
    assert own.n_turns == 2 and own.loss_chars == len(r"\### Assistant: </turn> ok")
    conversations = spark.createDataFrame(rows, TURNS)
    assert sorted_rows(chat_digests(conversations)) == oracle_rows(LLM_ORACLES["op1_chat_formatting"], conversations=conversations)
    assert chat_digests(spark.createDataFrame([], TURNS)).count() == 1


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * (i % 50)) for i in range(3000)]
    found = chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1").first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert (found["n_turns"], found["turns_sha256"]) == (3000, hashlib.sha256(said.encode()).hexdigest())


def test_runs_of_backslashes_take_linear_time(spark):
    import time

    text = "\\" * 300_000 + "x" + "\\" * 5 + "<turn>" + "\\" * 300_000 + "</turn>\\"
    begun = time.process_time()
    assert unescaped(spark.createDataFrame([(text,)], "t string").select(escaped(F.col("t"))).first()[0]) == text
    assert time.process_time() - begun < 5


def test_conversation_ids_of_any_type(spark):
    rows = [("1.50", 0, "user", "Hi"), ("2.25", 0, "assistant", "Ho"), (None, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    for kind in ("decimal(10,2)", "double", "string", "binary"):
        typed = table.withColumn("conv_id", F.col("conv_id").cast(kind))
        found = read_digests(render(fold_events(conversation_events(typed))))
        assert dict(found.dtypes)["conv_id"] == kind and sorted(r["loss_chars"] for r in found.collect()) == [0, 0, 2]
