"""Quality rules: against their reference SQL and plain measures; no Python in the plan."""

from llm_tables import documents, oracle_rows, plain_repeats, some_words, sorted_rows

from tallyframe.llm.oracles import LLM_ORACLES
from tallyframe.llm.quality import judged, measured, quality_filter, quality_report, thresholds

CLEAN = [" ".join(some_words(i, 60, 5000)) for i in range(40)]
ODD = [
    "", None, " \t\n", "short text", " ".join(["same"] * 50), "\n".join(["one line again"] * 30), " ".join(f"{w}$$$" for w in some_words(1, 60, 5000)),
    " | ".join(some_words(2, 60, 5000)), "a b c d e f g h x a b c d e f g h " * 3, "\x0bw\x0c" * 30, "é\u00a0ü " * 25, " ".join(some_words(3, 4000, 9)),
]


def test_equal_to_the_reference_sql(spark):
    docs = documents(spark, CLEAN + ODD + CLEAN[:3], langs=("en", None, "de"), sources=("a", "b", None, "a"))
    assert sorted_rows(quality_report(docs)) == oracle_rows(LLM_ORACLES["op5_quality_rules"], documents=docs)


def test_measures_equal_plain_ones(spark):
    rows = quality_report(documents(spark, CLEAN + ODD)).collect()
    for row in rows:
        text = (CLEAN + ODD)[row["doc_id"]]
        words = (text or "").encode().split()
        assert (row["n_words"], row["n_repeat_words"]) == (len(words), plain_repeats(text))
        assert row["word_chars"] == sum(len(w.decode()) for w in words)
        assert row["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")


def test_junk_goes_and_clean_texts_stay(spark):
    docs = documents(spark, CLEAN + ODD)
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(len(CLEAN))) <= ids
    assert not {len(CLEAN) + i for i in range(8)} & ids


def test_parts_of_a_table_give_the_same_thresholds(spark):
    quality = measured(documents(spark, CLEAN, sources=("a", "b"))).drop("text")
    fences = lambda q: sorted((r["_source"], sorted(r["fences"].items())) for r in thresholds(q).collect())
    assert fences(quality.repartition(7)) == fences(quality.coalesce(1))


def test_empty_table(spark):
    assert quality_report(documents(spark, [])).count() == quality_filter(documents(spark, [])).count() == 0


def test_no_python_and_texts_measured_once(spark, capsys):
    quality = measured(documents(spark, CLEAN).select("doc_id", "text", "lang", "source")).drop("text")
    capsys.readouterr()
    judged(quality, thresholds(quality)).where("_kept").explain("extended")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "MapIn" not in plan
