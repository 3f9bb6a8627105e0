"""Decontamination: against its reference SQL, plain windows, and planted spans; no Python in the plan."""

import random
import re

from llm_tables import documents, oracle_rows, some_words, sorted_rows

from tallyframe.llm.decontaminate import SPAN, clean_documents, contaminated_spans, decontamination_report, item_sets, item_windows
from tallyframe.llm.oracles import LLM_ORACLES
from tallyframe.llm.runtime import written

ITEM_SCHEMA = "item_id long, text string, words string, items string"
LONG = [some_words(700 + i, 14 + 3 * i, 3000) for i in range(6)]
SHARED = some_words(800, 12, 3000)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ITEM_SCHEMA)


def some_items(short=True):
    rows = [(i, " ".join(w + SHARED)) for i, w in enumerate(LONG)] + [(10, " ".join(LONG[0])), (0, " ".join(LONG[0] + SHARED)), (None, " ".join(LONG[1])), (11, None), (12, " \n- ")]
    return rows + ([(20, "Only Four, words here"), (21, "ONE"), (22, "a b c d e f g h i"), (2, "Only Four words, HERE")] if short else [])


def some_texts():
    r = random.Random(3)
    texts = [" ".join(some_words(i, r.randrange(1, 120), 3000)) for i in range(30)]
    for k, words in enumerate(LONG):
        for cut in (9, 10, 11, len(words)):
            around = some_words(900 + k, 30, 3000)
            texts.append(" ".join(around[:13] + words[:cut] + around[13:]))
        texts.append("; ".join(w.upper() for w in words[2:13]))
        texts.append(" ".join(words[-4:] + SHARED))
    texts += [" ".join(SHARED * 5), " ".join(["again"] * 40), "only four words here only four words here", "one one two", "é ñ one", "a b c d e f g h i j", "", None, " \t", "-" * 40]
    return [*texts, texts[31], texts[31], " ".join(some_words(5, 30000, 3000) + LONG[2] + some_words(6, 20000, 3000))]


def plain(texts, rows):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    windows = {}
    for item, text in rows:
        w = words(text)
        for i in range(max(len(w) - SPAN, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + SPAN]), set()).add(item)
    result = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                held = windows.get(tuple(w[i : i + size]))
                if held:
                    hit.update(range(i, i + size))
                    found |= held - {None}
        result.append((len(w), len(hit), len(found)))
    return result


def test_equal_to_the_reference_sql_and_to_plain_windows(spark):
    texts = some_texts()
    for short in (True, False):
        docs, bench = documents(spark, texts), items(spark, some_items(short))
        report = decontamination_report(docs, bench)
        assert sorted_rows(report) == oracle_rows(LLM_ORACLES["op13_decontamination"], documents=docs, benchmark=bench)
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in report.collect()}
        assert [found[i] for i in range(len(texts))] == plain(texts, some_items(short))


def test_null_and_repeated_ids(spark):
    text = " ".join(LONG[0])
    docs = documents(spark, [text, text, text, "nothing", None], ids=[None, 7, 7, None, None])
    rows = sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in decontamination_report(docs, items(spark, some_items(False))).collect())
    assert rows == [("7", len(LONG[0]), 2)] * 2 + [("None", 0, 0)] * 2 + [("None", len(LONG[0]), 2)]


def test_empty_tables(spark):
    docs, bench = documents(spark, ["a b c"]), items(spark, some_items())
    assert decontamination_report(docs.limit(0), bench).count() == 0
    assert [tuple(r)[1:4] for r in decontamination_report(docs, bench.limit(0)).collect()] == [(3, 0, 0)]


def test_spans_and_clean_rows(spark):
    texts = ["x y z", " ".join(["p", "q", *LONG[3][:12], "r"]), None]
    docs, bench = documents(spark, texts), items(spark, some_items(False))
    windows = written(item_sets(item_windows(bench)), "windows")
    _, found = contaminated_spans(docs, windows)
    assert [(r["start"], r["size"]) for r in found.first()["spans"]] == [(2, SPAN), (3, SPAN), (4, SPAN)]
    kept = clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 2}


def test_many_items_and_documents_with_one_passage(spark):
    passage = " ".join(SHARED)
    bench = items(spark, [(i, f"{passage} item{i}") for i in range(300)])
    docs = documents(spark, [f"doc{i} {passage}" for i in range(300)])
    rows = decontamination_report(docs, bench).collect()
    assert {(r["n_hit"], r["n_items"]) for r in rows} == {(12, 300)} and len({r["items_sha256"] for r in rows}) == 1


def test_no_python_in_the_plan(spark):
    plan = decontamination_report(documents(spark, some_texts()), items(spark, some_items()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
