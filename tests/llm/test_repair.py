"""Conversation repair: against its reference SQL, and the divide and conquer against trying all edits."""

import itertools
import random
import re

import pytest
from llm_tables import oracle_rows, sorted_rows

from tallyframe.llm.oracles import LLM_ORACLES
from tallyframe.llm.repair import GONE, block_crossings, damage_repair_report, repaired_messages, repair_report, solve, spoken, summary

SCHEMA = "conv_id long, turn long, role string, text string, part string, audit string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def some_turns(seed=1, conversations=60):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        size = r.choice([1, 2, 3, 5, 9]) if conv else 700
        for i in range(size):
            role = ("user", "assistant")[i % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "User", "", None])
            text = r.choice(["Yes.", "No!", "why?", "so it", " \t", None, f"Text {i} of {conv}. ", f"cut {i}", "a.b \n", "é…", "long " * 400])
            rows.append((conv if conv != 5 else None, r.choice([i, i, i, i + 3, i // 2, None]), role, text))
    return rows


def tried(codes):
    """Cost and audit of the best edits among all sequences of edits and up to two inserts before each row and the end."""
    best = None
    for ways in itertools.product(*[[(n, op) for n in range(3) for op in ("D" if c == GONE else "DKR")] for c in codes], [(n, "") for n in range(3)]):
        said, cost, audit = "", 0, ""
        for (inserts, op), code in zip(ways, [*codes, None]):
            for letter in "I" * inserts + op:
                made = "a" if said[-1:] == "u" else "u"
                said += "" if letter == "D" else made if letter in "IR" else "sua?"[code % 4]
                cost += {"D": 4, "K": 0, "R": 3, "I": 3}[letter] + (3 if letter in "KR" and code >= 4 else 0)
            audit += "I" * inserts + op
        if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def cost_of(codes, audit):
    rows = iter(codes)
    return sum(3 if x == "I" else (4 if x == "D" else 3 * (x == "R") + 3 * (c >= 4)) if (c := next(rows)) is not None else 0 for x in audit)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_all_short_conversations_against_all_edits(size):
    for codes in itertools.product(range(9) if size < 3 else (0, 1, 2, 5, 7, 8), repeat=size):
        audit = "".join(letters for letters, _ in solve(bytes(codes)))
        assert (cost_of(codes, audit), audit) == tried(codes), codes


def plain_best(codes):
    """Cost and audit by keeping the least whole spelling of each state."""
    best = {0: (0, "")}
    nxt = lambda s: 3 if s == 2 else 2
    keep = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}

    def inserted(best):
        found = dict(best)
        for s, (cost, audit) in best.items():
            at = s
            for n in (1, 2):
                at = nxt(at)
                found[at] = min(found.get(at, (10**9, "")), (cost + 3 * n, audit + "I" * n))
        return found

    for code in codes:
        after = {}
        for s, (cost, audit) in inserted(best).items():
            ways = [(s, 4, "D")]
            if code != GONE:
                ways.append((nxt(s), 3 + 3 * (code >= 4), "R"))
                if (s, code % 4) in keep:
                    ways.append((keep[s, code % 4], 3 * (code >= 4), "K"))
            for t, c, letter in ways:
                after[t] = min(after.get(t, (10**9, "")), (cost + c, audit + letter))
        best = after
    return min(way for s, way in inserted(best).items() if s in (0, 3))


def test_long_conversations_and_their_blocks():
    r = random.Random(4)
    for round_ in range(200):
        codes = bytes(r.choice([r.randrange(9), 1, 2, i % 2 + 1]) for i in range(r.choice([5, 40, 300])))
        audit = "".join(letters for letters, _ in solve(codes))
        assert (cost_of(codes, audit), audit) == plain_best(codes)
        cuts = sorted({0, len(codes), *(r.randrange(1, len(codes)) for _ in range(round_ % 7))})
        blocks = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        bounds = block_crossings([summary(b) for b in blocks])
        parts = [solve(b, *ends) for b, ends in zip(blocks, bounds)]
        assert "".join(letters for part in parts for letters, _ in part) == audit


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_equal_to_the_reference_sql(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = turns(spark, some_turns())
        found = damage_repair_report(table)
        assert sorted_rows(found) == oracle_rows(LLM_ORACLES["op11_conversation_repair"], conversations=table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be good."), (1, 4, "assistant", "cut"),
        (2, None, None, None), (3, 7, "assistant", "Alone."), (4, 0, "user", "x " * 200000 + "end."), (4, 1, "assistant", "Ok!"),
        (None, 0, "user", "Null."), (None, 1, "assistant", "Null!"),
    ]
    table = turns(spark, rows)
    found = {r["conv_id"]: r for r in repair_report(table, spoken(table)).collect()}
    assert (found[1]["gaps"], found[1]["duplicate"], found[1]["truncated"], found[1]["audit"], found[1]["cost"]) == (3, 1, 1, "KKDK", 7)
    assert (found[2]["gaps"], found[2]["blank"], found[2]["audit"], found[2]["cost"]) == (0, 1, "D", 4)
    assert (found[3]["audit"], found[3]["cost"]) == ("IK", 3)
    assert found[4]["audit"] == found[None]["audit"] == "KK" and found[4]["cost"] == 0
    messages = repaired_messages(table).orderBy("conv_id", "part", "place", "step").collect()
    assert [(m["role"], m["text"]) for m in messages if m["conv_id"] == 3] == [("user", ""), ("assistant", "Alone.")]
    assert [m["role"] for m in messages if m["conv_id"] == 1] == ["system", "user", "assistant"]


def test_empty_table_and_dropped_conversations(spark):
    assert damage_repair_report(turns(spark, [])).count() == 0
    table = turns(spark, [(9, 1, "user", "Gone.")])
    row = repair_report(table, spoken(table).limit(0)).first()
    assert tuple(row)[1:8] == (0, 0, 0, 0, 0, 0, "") and row["repaired_sha256"].startswith("e3b0c442")
