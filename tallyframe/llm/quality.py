"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text is measured in one pass. Fixed rules reject texts of under 20 words and texts of which
over 30 % of the words lie in repeated windows. Beyond them, each measure has a threshold of its own
for every language and source: the upper fence median + ``SPREADS`` x (upper quartile - median), where
the spread counts as one ``step`` of the measure at least, so that a measure which is constant in a
group rejects only what is far from it.

Quantiles come from mergeable sketches: counts of log-linear buckets (values under 128 are exact,
larger ones keep seven bits). Counts of parts add up, so they are aggregated before the shuffle and
give the same quantiles however the rows are dealt out. Thresholds are joined to the documents by
language and source.

Defined results: a null text has no words and fails; null languages and sources are groups of their
own; a repeated row counts again and gets the same verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import whole_text, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
#: Percent of the words in repeated windows.
MOST_REPEATED = 30
SPREADS = 6


@dataclass(frozen=True)
class Measure:
    """An integer share ``scale * part / whole`` and the smallest spread that counts."""

    name: str
    part: str
    whole: str
    scale: int
    step: int


MEASURES = (
    Measure("symbols", "n_symbols", "word_chars", 1000, 10),
    Measure("echoes", "n_echo_words", "n_words", 1000, 20),
    Measure("repeats", "n_repeat_words", "n_words", 1000, 50),
    Measure("line_copies", "n_dup_lines", "n_lines", 1000, 100),
    Measure("word_length", "word_chars", "n_words", 100, 100),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(starts: Column) -> Column:
    """How many words the windows at these ascending positions cover together."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    step = lambda so_far, p: F.struct((so_far["words"] + F.least(F.lit(WINDOW), p - so_far["last"])).alias("words"), p.alias("last"))
    return F.aggregate(starts, zero, step, lambda end: end["words"])


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, by the hashes of the words."""

    def starts(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        return let(ranked, twice)

    count = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(starts(w))))
    return F.when(count < 2, F.lit(0)).otherwise(some)


def word_measures(text: Column) -> Column:
    def of(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        echoes = lambda h: F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1))))
        counts = let(hashes, lambda h: F.struct(repeated_words(h).alias("repeated"), echoes(h).alias("echoes")))
        return F.struct(F.size(words).alias("words"), F.length(F.array_join(words, "")).alias("chars"), counts.alias("of"))

    return let(F.filter(F.split(text, SPACE), lambda w: w != ""), of)


def line_measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("copies")))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_quality`` of its measures and ``failed``, the fixed rules' verdict."""
    whole = whole_text(f"`{text}`")
    w, x = F.col("_words"), F.col("_lines")
    counts = {
        "n_words": w["words"],
        "word_chars": w["chars"],
        "n_symbols": F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, "")),
        "n_lines": x["lines"],
        "n_dup_lines": x["copies"],
        "n_repeat_words": w["of"]["repeated"],
        "n_echo_words": w["of"]["echoes"],
    }
    failed = (w["words"] < LEAST_WORDS) | (100 * w["of"]["repeated"] > MOST_REPEATED * w["words"])
    quality = F.struct(*[c.cast("long").alias(k) for k, c in counts.items()], failed.alias("failed"))
    return docs.withColumns({"_words": word_measures(whole), "_lines": line_measures(whole)}).withColumn("_quality", quality).drop("_words", "_lines")


def share(m: Measure) -> Column:
    quality = F.col("_quality")
    return F.floor(m.scale * quality[m.part] / F.greatest(quality[m.whole], F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket in the sketch."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def thresholds(quality: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Fences by language and source (_lang, _source, fences) of the rows that pass the fixed rules."""
    values = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), F.lit(m.step).alias("step"), bucket(share(m)).alias("value")) for m in MEASURES]))
    rows = quality.where(~F.col("_quality.failed")).select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"), values.alias("v"))
    sketches = rows.groupBy("_lang", "_source", "v.measure", "v.step", "v.value").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_lang", "_source", "measure")
    ranked = sketches.withColumns({"below": F.sum("n").over(group.orderBy("value")), "all": F.sum("n").over(group)})
    quartiles = ranked.groupBy("_lang", "_source", "measure", "step").agg(
        F.min(F.when(2 * F.col("below") >= F.col("all"), F.col("value"))).alias("median"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("all"), F.col("value"))).alias("upper"),
    )
    fence = F.col("median") + SPREADS * F.greatest(F.col("upper") - F.col("median"), F.col("step"))
    return quartiles.groupBy("_lang", "_source").agg(F.map_from_entries(F.collect_list(F.struct("measure", fence.alias("fence")))).alias("fences"))


def verdict() -> Column:
    """The fixed rules and the thresholds of the row's group.

    One expression that is not a conjunction: Spark would push a part of one below the join and
    measure the texts once more for it.
    """
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | (share(m) > F.col("_fences.fences")[m.name])
    return F.when(F.col("_quality.failed"), False).otherwise(~F.coalesce(beyond, F.lit(False)))


def judged(quality: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``quality`` (with columns of these names) and ``_kept``, the verdict."""
    groups = fences.select(F.struct("*").alias("_fences"))
    same = F.col(lang).eqNullSafe(F.col("_fences._lang")) & F.col(source).eqNullSafe(F.col("_fences._source"))
    return quality.join(groups, same, "left").withColumn("_kept", verdict()).drop("_fences")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts are measured once: the rows are written with their measures, which give the thresholds and then the
    verdict. Nothing but the sketches is shuffled.
    """
    # In a struct, columns of the caller can't clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    inputs = [F.col(f"_row.`{c}`").alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))]
    quality = written(measured(rows.select("_row", *inputs)).drop("text"), "quality")
    found = judged(quality, written(thresholds(quality), "fences"))
    return found.where("_kept").select("_row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """Measures and verdicts of every document."""
    quality = written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(quality, written(thresholds(quality), "fences")).select(
        "doc_id", *[F.col(f"_quality.{c}").alias(c) for c in columns], F.col("_quality.failed").alias("base_failed"), F.col("_kept").alias("kept")
    )
