"""Mixing sources to target weights by Poisson replication.

Every source gets a target share of the characters of the mix. The mean repetition rate of its
documents is that share times the size of the mix, divided by the characters it has. A document's
number of copies is a Poisson draw with this mean: a uniform number made from a hash of seed and id
is inverted through the distribution. Copies are then dealt out by a hash of seed, id and copy, and
sorted by it, which shuffles them globally.

A mean over ``PART`` is split into equal parts of at most ``PART``, each drawn with a hash of its
own; the sum of the draws has the same distribution, and no part's probabilities vanish. The
inverted distribution is a short table for each source.

Defined results: a null source is a source of its own; a null id is replaced by a hash of the text;
rows with the same id get the same number of copies; sources without characters, or with a target
of 0, give none. An empty table gives an empty result. Texts aren't changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import whole_text, written

PART = 16
#: Values of the inverted distribution: beyond them, a mean of PART has a probability under 1e-28.
VALUES = 80
#: Default targets: shares in proportion to characters to this power.
POWER = 0.5
SEED = "mix-1"


def rates(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = 1.0, power: float = POWER, source: str = "source", text: str = "text") -> DataFrame:
    """Sources with their mean repetition rates (_source, rate, parts, below).

    ``targets`` are weights by source, in any unit; ``epochs`` is the size of the mix in multiples of
    the corpus. ``below`` holds the probabilities of at most 0, 1, 2, ... in one part.
    """
    sizes = docs.select(F.col(f"`{source}`").alias("_source"), F.length(whole_text(f"`{text}`")).alias("n")).groupBy("_source").agg(F.sum("n").cast("double").alias("chars"))
    if targets is None:
        weight = F.pow("chars", F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col("_source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in targets.items()], F.lit(0.0))
    weighed = sizes.where("chars > 0").withColumn("weight", weight)
    whole = weighed.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all")).first()  # one row
    weights, everything = whole["weights"] or 1.0, whole["all"] or 0.0
    rate = F.col("weight") / weights * (everything * epochs) / F.col("chars")
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = weighed.withColumn("rate", rate).withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    zero = F.exp(-F.col("mean"))
    step = lambda so_far, k: F.struct((so_far["p"] * F.col("mean") / k).alias("p"), F.concat(so_far["below"], F.array(F.element_at(so_far["below"], -1) + so_far["p"] * F.col("mean") / k)).alias("below"))
    below = F.aggregate(F.sequence(F.lit(1), F.lit(VALUES)), F.struct(zero.alias("p"), F.array(zero).alias("below")), step, lambda end: end["below"])
    return table.select("_source", "rate", "parts", below.alias("below"))


def uniform(text: Column) -> Column:
    """A number from 0 to 1 (exclusive) from the first 52 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(key: Column, parts: Column, below: Column, seed: str = SEED) -> Column:
    """A Poisson draw: how many of the probabilities are not over the uniform number, summed over the parts."""

    def drawn(part: Column) -> Column:
        u = F.array(uniform(F.concat_ws("|", F.lit(seed), key, part.cast("string"))))
        return F.get(F.transform(u, lambda x: F.size(F.filter(below, lambda p: p <= x))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + drawn(part))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = 1.0, power: float = POWER, seed: str = SEED, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (``_doc``) repeated by their draws and shuffled, with ``_copy`` (from 1) and ``_place``."""
    table = written(rates(docs, targets, epochs, power, source, text), "rates").select(F.struct("*").alias("_rate"))
    # In a struct, columns of the caller can't clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    key = F.coalesce(F.col(f"_doc.`{id_column}`").cast("string"), F.md5(whole_text(f"_doc.`{text}`")))
    keyed = rows.join(table, F.col(f"_doc.`{source}`").eqNullSafe(F.col("_rate._source")))
    drawn = keyed.select("_doc", key.alias("_key"), copies(key, F.col("_rate.parts"), F.col("_rate.below"), seed).alias("_n")).where("_n > 0")
    out = drawn.select("_doc", "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    placed = out.select("_doc", "_copy", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), "_key", F.col("_copy").cast("string"))).alias("_place"))
    return placed.repartition("_place").sortWithinPartitions("_place")


def source_mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy and place of every copy in the mix."""
    return mix(docs.select("doc_id", "source", "text")).select("_doc.doc_id", "_doc.source", F.col("_copy").alias("copy"), F.col("_place").alias("place"))
