r"""Chat formatting from event logs.

A conversation is a log of events with a sequence number: ``message`` opens a turn with a text,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it and discards every
later turn that the log had begun before. The log is folded into final messages, which are then
rendered with a template.

Turns are folded by (conversation, turn), so a conversation that holds a third of all rows is spread
over tasks; only the numbers of its events pass through a window over the conversation.

The template puts ``<turn ROLE>`` and a line break before a text, a line break and ``</turn>`` after
it. A text may contain such strings: one backslash goes before every ``<turn`` and ``</turn`` of a
text, after any backslashes that already stand there, and reading takes it away again, so every
text comes back as it was. In roles, backslash, ``<``, ``>`` and line breaks are escaped.

Defined results: a null text is empty, a null role is empty, a null kind is ``message``. Events with
equal sequence numbers are ordered by kind (in the order above), role and text. Repeated rows are
separate events. Turns whose only events are deltas begin empty. An empty log gives no messages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import map_arrow

KINDS = ("message", "delta", "edit", "regenerate")
ASSISTANT = "assistant"

_TURN = re.compile(r"(?<!\\)<turn ([^<>\n]*)>\n(.*?)\n(?<!\\)</turn>\n", re.S)
# Runs of backslashes are tried from their start only, so time grows with the text.
_ESCAPED = re.compile(r"(?<!\\)\\(\\*+</?turn)")
_ROLE = re.compile(r"\\(.)")
_ROLE_MARKS = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}


def conversation_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as a log: a ``message`` event for each row.

    Rows come in order of turn, rows of the same turn in order of role and text, nulls first. The key of
    a message is (turn, number within the turn), so no window holds the texts of a conversation.
    """
    same = Window.partitionBy("conv_id", "_turn").orderBy("role", "text")
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    place = F.struct("_turn", F.row_number().over(same).alias("number"))
    return rows.select("conv_id", place.alias("seq"), place.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    ``seq`` and ``turn`` are of any types that can be ordered.
    """
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0))
    # As a struct, the key is never null, and nulls inside it are equal: grouping and join share a shuffle.
    log = events.select(
        F.struct("conv_id", "turn").alias("key"),
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.col("seq"), rank.alias("rank")).alias("at"),
    )
    reset = F.when(F.col("kind") != "delta", F.col("at"))
    started = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    # The last event of a turn that sets its text, and what was appended from there on.
    last = Window.partitionBy("key")
    marked = log.withColumn("from", F.max(reset).over(last))
    kept = marked.where(F.col("from").isNull() | (F.col("at") >= F.col("from")))
    turns = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "role", started.alias("text")))).alias("parts"))
    spans = log.groupBy("key").agg(F.min("at").alias("first"), F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("regenerated"))
    before = Window.partitionBy("key.conv_id").orderBy("key.turn").rowsBetween(Window.unboundedPreceding, -1)
    # A turn begun before an earlier turn was made anew no longer belongs to the conversation.
    alive = spans.withColumn("cut", F.max("regenerated").over(before)).where(F.col("cut").isNull() | (F.col("first") > F.col("cut"))).select("key")
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r != "")
    messages = turns.select(
        "key",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )
    return messages.join(alive, "key", "left_semi").select("key.conv_id", "key.turn", "role", "text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+</?turn)", r"\\$1")


def escaped_role(role: Column) -> Column:
    for mark, plain in (("\\\\", "\\"), ("\\l", "<"), ("\\g", ">"), ("\\n", "\n")):
        role = F.replace(role, F.lit(plain), F.lit(mark))
    return role


def render(messages: DataFrame) -> DataFrame:
    """Each message with its formatted string and the loss span inside it.

    ``loss_start`` and ``loss_end`` are code points of ``formatted``, null for other roles than the
    assistant's. A conversation is its messages' strings in order of turn, one after another.
    """
    head = F.concat(F.lit("<turn "), escaped_role(F.col("role")), F.lit(">\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == ASSISTANT
    return messages.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, body, F.lit("\n</turn>\n")).alias("formatted"),
        F.when(learned, F.length(head)).alias("loss_start"),
        F.when(learned, F.length(head) + F.length(body)).alias("loss_end"),
    )


def conversation_texts(rendered: DataFrame) -> DataFrame:
    """One formatted string for each conversation."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "formatted")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["formatted"]), "").alias("formatted"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string."""
    return [(_ROLE.sub(lambda m: _ROLE_MARKS[m[1]], role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def read_digests(rendered: DataFrame) -> DataFrame:
    """Digests of what is read back from the rendered messages of each conversation.

    The messages stream by in order, so memory holds one message whatever the conversation's length.
    """
    schema = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long".format(rendered.schema["conv_id"].dataType.simpleString())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, begun, kind = None, False, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if not begun or conv != at:
                    if begun:
                        done.append((at, turns, said.hexdigest(), chars, learned.hexdigest(), size))
                    at, begun, turns, chars, size = conv, True, 0, 0, 0
                    said, learned = hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(formatted):
                    said.update(f"{role}\n{text}\n".encode())
                    turns += 1
                if start is not None:
                    text = unescaped(formatted[start:end])
                    learned.update(text.encode())
                    chars += len(text)
                size += len(formatted)
            if len(done) > 1000:
                yield made(done, kind)
                done = []
        if begun:
            done.append((at, turns, said.hexdigest(), chars, learned.hexdigest(), size))
            yield made(done, kind)

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return map_arrow(rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "formatted", "loss_start", "loss_end"), task, schema)


def chat_digests(turns: DataFrame) -> DataFrame:
    """All conversations folded, rendered and read back, with one conversation that quotes the template."""
    spark = turns.sparkSession
    quoting = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(own)
    return read_digests(render(fold_events(conversation_events(rows))))
