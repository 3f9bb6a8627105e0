"""Conversation structure repair by Hirschberg's divide and conquer over four states.

Rows of a conversation are taken by turn (nulls first), and within a turn by role, the first 64 characters of
the text and a digest of it. The first of these faults counts for a row: blank (nothing but white space),
duplicate (role and text seen earlier in the conversation), truncated (the last character that isn't white
space is none of ``.!?``). The cheapest edits make the role initials ``(s?(ua)+)?``: Keep costs 0, Rerole to
user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert of an empty user or assistant
message 3; an undeleted truncated row adds 3. Among equal costs the edits' initials that are least in ASCII win.

A repair is a path through four states (nothing yet, after system, after user, after assistant), where inserts
belong to the row that follows them. In the middle of a span, the forward vector (least cost of each state
before it) and the backward vector (least cost from each state on) meet, and the optimal crossing of least
audit is chosen; then both halves are solved alike, so only vectors are held, never a table of rows by states.
Spellings that have consumed the same rows end with a row's letter, so none is the beginning of another: the
forward vector carries, besides costs, the order of the states' least spellings, and that order alone decides
between optimal crossings.

On the cluster, all rows are range-sorted once; a part of that order is a block, whatever conversations it
holds. A conversation over several blocks, such as one with a third of all rows, is solved in parallel:
each block is reduced to its costs and spelling orders from every state to every state (bounded by the number
of parts, not of rows), crossings at the block borders are chosen from these by the same meeting of vectors,
and then every block is solved between its crossings. Only the digest of a repaired conversation streams
through one task, message by message, since a hash can't be split.

Defined results: a null role or text is one space; a null turn sorts first and takes no part in gaps; rows with
a null ``conv_id`` are one conversation; roles other than s, u, a initials (the empty one too) can't be kept;
repeated rows are duplicates; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, ready_workers, written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; ``DONE`` is a legal end.
STATES, DONE = range(4), 4
ROLES = {"u": "user", "a": "assistant"}
#: Codes of rows: place of the initial in "sua" (3: another one), plus 4 if truncated; or that the row must go.
GONE = 8
NEVER = 1 << 40
#: A state that costs more than another by this is in no optimal path: two inserts and a delete align them.
BEYOND = 12
#: Conversations up to this many rows share solutions.
SHORT = 12
#: Sort keys of the rows of a conversation.
ORDER = ["conv_id", "turn", "role", "_head", "_digest", "_any"]


def made_next(state: int) -> tuple[int, str]:
    """State and initial of an inserted or reroled message."""
    return (3, "a") if state == 2 else (2, "u")


def kept_next(state: int, initial: int) -> int | None:
    return {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, initial))


@cache
def steps(code: int) -> tuple[dict[int, tuple[int, str, str]], ...]:
    """For each state, the states after a row of this code: cost, letters and roles of the best way there."""
    found: tuple[dict, ...] = ({}, {}, {}, {})
    for start in STATES:
        at, letters, roles = start, "", ""
        for inserts in range(3):
            ways = [(at, DELETE, "D", "-")]
            if code != GONE:
                unended = UNENDED * (code >= 4)
                state, role = made_next(at)
                ways.append((state, REROLE + unended, "R", role))
                state = kept_next(at, code % 4)
                if state is not None:
                    ways.append((state, KEEP + unended, "K", "="))
            for state, cost, letter, role in ways:
                way = (INSERT * inserts + cost, letters + letter, roles + role)
                found[start][state] = min(found[start].get(state, way), way)
            at, role = made_next(at)
            letters, roles = letters + "I", roles + role
    return found


#: From each state the inserts to a legal end.
TAILS = ((0, "", ""), (2 * INSERT, "II", "ua"), (INSERT, "I", "a"), (0, "", ""))


@cache
def forward(vector: tuple, code: int) -> tuple[int, tuple]:
    """The vector (cost and spelling order of each state, None: never) after a row, and what its costs fell by."""
    best: dict[int, tuple] = {}
    for state, held in enumerate(vector):
        if held:
            for after, (cost, letters, _) in steps(code)[state].items():
                way = (held[0] + cost, held[1], letters)
                best[after] = min(best.get(after, way), way)
    least = min(way[0] for way in best.values())
    order = sorted(w[1:] for w in best.values())
    return least, tuple((best[s][0] - least, order.index(best[s][1:])) if s in best and best[s][0] <= least + BEYOND else None for s in STATES)


@cache
def backward(vector: tuple, code: int) -> tuple[int, tuple]:
    """The vector (cost from each state on) before a row, and what its costs fell by."""
    costs = [min((cost + vector[after] for after, (cost, _, _) in ways.items()), default=NEVER) for ways in steps(code)]
    least = min(costs)
    return least, tuple(min(c - least, NEVER) for c in costs)


def from_state(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in STATES)


def to_end(end: int) -> tuple:
    return tuple(t[0] for t in TAILS) if end == DONE else tuple(0 if s == end else NEVER for s in STATES)


def crossing(before: tuple, after: tuple) -> int:
    """The state of the audit-least optimal path where a forward and a backward vector meet."""
    return min((held[0] + after[s], held[1], s) for s, held in enumerate(before) if held)[2]


def last_step(code: int, start: int, end: int) -> tuple[str, str]:
    """Letters and roles of one row between two states."""
    if end != DONE:
        return steps(code)[start][end][1:]
    ways = ((cost + TAILS[s][0], letters + TAILS[s][1], roles + TAILS[s][2]) for s, (cost, letters, roles) in steps(code)[start].items())
    return min(ways)[1:]


def solve(codes: bytes, start: int = 0, end: int = DONE) -> list[tuple[str, str]]:
    """Letters and roles of each row of the best path from ``start`` to ``end``."""
    found: list[tuple[str, str]] = []
    spans = [(0, len(codes), start, end)] if codes else []
    while spans:
        low, high, enters, leaves = spans.pop()
        if high - low == 1:
            found.append(last_step(codes[low], enters, leaves))
            continue
        middle = (low + high) // 2
        before, after = from_state(enters), to_end(leaves)
        for i in range(low, middle):
            before = forward(before, codes[i])[1]
        for i in range(high - 1, middle - 1, -1):
            after = backward(after, codes[i])[1]
        meets = crossing(before, after)
        spans += [(middle, high, meets, leaves), (low, middle, enters, meets)]
    return found


@lru_cache(maxsize=1 << 16)
def solved(codes: bytes) -> list[tuple[str, str]]:
    """``solve`` of a short whole conversation; most of these are alike."""
    return solve(codes)


def summary(codes: bytes) -> list[int]:
    """A block as costs and spelling orders from every state to every state; -1: never."""
    numbers = []
    for start in STATES:
        vector, base = from_state(start), 0
        for code in codes:
            fell, vector = forward(vector, code)
            base += fell
        for held in vector:
            numbers += [base + held[0], held[1]] if held else [-1, -1]
    return numbers


def block_crossings(summaries: list[list[int]]) -> list[tuple[int, int]]:
    """The states in which the best path enters and leaves each block of a conversation."""
    befores, before = [], {0: (0, 0)}
    for numbers in summaries:
        best: dict[int, tuple] = {}
        for state, held in before.items():
            for after in STATES:
                cost, order = numbers[8 * state + 2 * after : 8 * state + 2 * after + 2]
                if cost >= 0:
                    way = (held[0] + cost, held[1], order)
                    best[after] = min(best.get(after, way), way)
        ranks = sorted(way[1:] for way in best.values())
        before = {s: (way[0], ranks.index(way[1:])) for s, way in best.items()}
        befores.append(before)
    after, meets = {s: t[0] for s, t in enumerate(TAILS)}, []
    for numbers, before in zip(reversed(summaries), reversed(befores)):
        meets.append(min((held[0] + after[s], held[1], s) for s, held in before.items() if s in after)[2])
        ways = {s: [numbers[8 * s + 2 * t] + c for t, c in after.items() if numbers[8 * s + 2 * t] >= 0] for s in STATES}
        after = {s: min(w) for s, w in ways.items() if w}
    leaves = meets[::-1]
    return list(zip([0, *leaves[:-1]], [*leaves[:-1], DONE]))


def spoken(turns: DataFrame) -> DataFrame:
    """The rows of conversations, nulls of role and text as one space."""
    one = F.lit(" ")
    return turns.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut of their sentence ends, repeated or given to the user, by a hash of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(place.cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def in_parts(rows: DataFrame) -> DataFrame:
    """The rows in order, each with its part of that order, its place there, and the faults it shows by itself.

    Rows are dealt by range, so neither a conversation nor a turn has to fit a task; equal rows, which any
    order of theirs suits, are told apart by a number.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    keyed = rows.withColumns({"_head": F.substring("text", 1, 64), "_digest": F.md5("text"), "_any": F.monotonically_increasing_id(), "_ended": ended})
    blank = F.col("_ended") == ""
    # The length of the role keeps role and text apart.
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    placed = keyed.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        blank.alias("blank"),
        (~blank & ~F.right("_ended", F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.when(~blank, said).alias("said"),
    )
    return written(placed, "placed")


def row_code() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("blank") | F.col("duplicate"), GONE).otherwise(kind + F.when(F.col("truncated"), 4).otherwise(0))


def coded(placed: DataFrame) -> DataFrame:
    """Each row as its place and code (part, place, conv_id, code)."""
    at = F.struct("part", "place")
    firsts = placed.where("said IS NOT NULL").groupBy("conv_id", "said").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows, firsts = placed.drop("turn", "text").alias("r"), firsts.drop("n").alias("f")
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.said") == F.col("f.said"))
    duplicate = F.coalesce(F.col("first") != at, F.lit(False)).alias("duplicate")
    marked = rows.join(firsts, same, "left").select("part", "place", "r.conv_id", "role", "blank", "truncated", duplicate)
    return written(marked.select("part", "place", "conv_id", row_code().cast("int").alias("code")), "codes")


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "place")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows of one conversation in one part: part, conv_id, first place, codes, crossings of the part."""
    at, codes, bounds = None, bytearray(), {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for part, place, conv, code, *ends in zip(*(columns[c] for c in ("part", "place", "conv_id", "code")), *([columns["enters"], columns["leaves"]] if "enters" in columns else [])):
            if at is not None and (part, conv) != at[:2]:
                if codes:
                    yield at[0], at[1], at[2], bytes(codes), bounds
                at, codes, bounds = None, bytearray(), bounds if part == at[0] else {}
            if at is None:
                at = (part, conv, place)
            if place < 0:
                bounds[conv] = tuple(ends)
                at = None
            else:
                codes.append(code)
    if codes:
        yield at[0], at[1], at[2], bytes(codes), bounds


def border_blocks(codes: DataFrame) -> DataFrame:
    """Summaries of the first and last block of each part, the only ones that others may continue."""
    kind = codes.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        def made(block: tuple) -> pa.RecordBatch:
            conv = pa.array([block[1]], schema.field("conv_id").type)
            return pa.RecordBatch.from_arrays([conv, pa.array([block[0]], pa.int32()), pa.array([summary(block[3])], pa.list_(pa.int64()))], names=["conv_id", "part", "numbers"])

        begun = None
        for block in blocks_of(seen()):
            if begun != block[0]:
                if held:
                    yield made(held)
                begun, held = block[0], None
                yield made(block)
            else:
                held = block
        if held:
            yield made(held)

    return map_arrow(in_blocks(codes), task, f"conv_id {kind}, part int, numbers array<bigint>")


def border_crossings(blocks: DataFrame) -> DataFrame:
    """Where the repair of a conversation over several blocks enters and leaves each of them."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def task(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["numbers"].to_pylist()))
        ends = block_crossings([numbers for _, numbers in rows])
        columns = [pa.array([p for p, _ in rows], pa.int32()), pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32())]
        conv = table["conv_id"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("conv_id").type)
        return pa.Table.from_arrays([conv, *columns], names=["conv_id", "part", "enters", "leaves"])

    ready_workers(blocks.sparkSession)
    several = blocks.groupBy("conv_id").count().where("count > 1").select(F.struct("conv_id").alias("key"))
    split = blocks.withColumn("key", F.struct("conv_id")).join(several, "key", "left_semi").drop("key")
    return split.groupBy("conv_id").applyInArrow(task, f"conv_id {kind}, part int, enters int, leaves int")


def edits_of(codes: DataFrame) -> DataFrame:
    """The edits of each row (part, place, conv_id, code, letters, roles); the last row's may end with inserts."""
    blocks = written(border_blocks(codes), "blocks")
    bounds = border_crossings(blocks).select("part", F.lit(-1).cast("long").alias("place"), "conv_id", F.lit(-1).alias("code"), "enters", "leaves")
    kind = codes.schema["conv_id"].dataType.simpleString()
    never = F.lit(None).cast("int")
    stacked = codes.withColumns({"enters": never, "leaves": never}).unionByName(bounds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), schema.field("conv_id").type, pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "place", "conv_id", "code", "letters", "roles"])

        for part, conv, place, block, ends in blocks_of(seen()):
            best = solve(block, *ends[conv]) if conv in ends else solved(block) if len(block) <= SHORT else solve(block)
            for i, (letters, roles) in enumerate(best):
                rows.append((part, place + i, conv, block[i], letters, roles))
                if len(rows) >= 4096:
                    yield made()
                    rows.clear()
        if rows:
            yield made()

    return map_arrow(in_blocks(stacked), task, f"part int, place bigint, conv_id {kind}, code int, letters string, roles string")


def repaired_messages(turns: DataFrame) -> DataFrame:
    """The messages of the repaired conversations in order (conv_id, turn, part, place, step, edit, role, text).

    ``turn`` is that of the row an edit belongs to; deleted rows give nothing; an inserted message is empty.
    """
    placed = in_parts(spoken(turns))
    edits = edits_of(coded(placed)).drop("conv_id", "code")
    own = lambda x: F.col("letters").substr(x, F.lit(1)) == "K"
    named = lambda x: F.when(F.col("roles").substr(x, F.lit(1)) == "u", "user").otherwise("assistant")
    kept = lambda x: F.col("letters").substr(x, F.lit(1)) != "I"
    each = F.transform(
        F.sequence(F.lit(1), F.length("letters")),
        lambda x: F.struct(
            x.alias("step"),
            F.col("letters").substr(x, F.lit(1)).alias("edit"),
            F.when(own(x), F.col("role")).otherwise(named(x)).alias("role"),
            F.when(kept(x), F.col("text")).otherwise("").alias("text"),
        ),
    )
    made = placed.join(edits, ["part", "place"]).select("conv_id", "turn", "part", "place", F.explode(each).alias("message"))
    return made.select("conv_id", "turn", "part", "place", "message.*").where("edit != 'D'")


class Report:
    """One conversation's figures, fed row by row."""

    def __init__(self) -> None:
        self.turns, self.least, self.most, self.last = 0, None, None, None
        self.faults = [0, 0, 0]
        self.illegal, self.initial = 0, None
        self.cost, self.audit = 0, []
        self.said, self.begun = hashlib.sha256(), False

    def row(self, turn: int | None, role: str, blank: bool, code: int) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        self.faults[0] += blank
        self.faults[1] += code == GONE and not blank
        self.faults[2] += 4 <= code < GONE
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def edits(self, letters: str, roles: str, role: str, text: str, code: int) -> None:
        self.audit.append(letters)
        for letter, made in zip(letters, roles):
            if letter == "D":
                self.cost += DELETE
                continue
            self.cost += {"K": KEEP, "R": REROLE, "I": INSERT}[letter] + UNENDED * (letter != "I" and 4 <= code < GONE)
            line = f"{role if letter == 'K' else ROLES[made]}:{'' if letter == 'I' else text}"
            self.said.update((f"\n{line}" if self.begun else line).encode())
            self.begun = True

    def values(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.said.hexdigest()


def repair_report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, edits and the digest of the repaired text of every conversation of ``turns``.

    ``rows`` (conv_id, turn, role, text without nulls in the last two) are what is left of them. Rows, their edits and one mark for each
    conversation are stacked and stream by in order, so nothing is joined and memory holds one message.
    """
    placed = in_parts(rows)
    edits = edits_of(coded(placed))
    kind = turns.schema["conv_id"].dataType.simpleString()
    texts = placed.drop("said", "truncated").withColumn("is_edit", F.lit(0))
    marks = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("place"), F.lit(0).alias("is_edit"))
    stacked = texts.unionByName(edits.withColumn("is_edit", F.lit(1)), allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    order = ["conv_id", "part", "place", "is_edit"]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        report, at, held, conv_kind = None, None, None, None

        def made() -> pa.RecordBatch:
            kinds = [conv_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            conv_kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if report is None or row["conv_id"] != at:
                    if report:
                        done.append((at, *report.values()))
                    report, at = Report(), row["conv_id"]
                    if len(done) >= 1024:
                        yield made()
                        done.clear()
                if row["is_edit"]:
                    report.row(held["turn"], held["role"], held["blank"], row["code"])
                    report.edits(row["letters"], row["roles"], held["role"], held["text"], row["code"])
                elif row["part"] >= 0:
                    held = row
        if report:
            done.append((at, *report.values()))
        if done:
            yield made()

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return map_arrow(stacked.repartition("conv_id").sortWithinPartitions(*order), task, schema)


def damage_repair_report(turns: DataFrame) -> DataFrame:
    """The report of all conversations after the damage."""
    return repair_report(turns, damaged(spoken(turns)))
