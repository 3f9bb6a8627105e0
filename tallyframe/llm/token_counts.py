"""Token counts without token ids.

Byte-level BPE works on each pre-token alone, so a document's number of tokens is the sum over its
distinct pre-tokens of (times it occurs) x (pieces it has). The pieces of every distinct pre-token
of the corpus are counted once, with the ``tokenizers`` library, into a table. Documents are reduced
to pre-token frequencies and joined to it.

The join is split by frequency. A pre-token that makes up at least one part in ``HOT_PARTS`` of all
occurrences is hot; there can be no more than ``HOT_PARTS`` of these, and only those of up to
``HOT_BYTES`` bytes count as hot, so their table has a proven bound and goes to every task. All
others are joined by a shuffle on the pre-token. Each occurrence takes one way or the other.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted row by
row; an empty table gives an empty result. Added special tokens in a text count 1 each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, texts_of, whole_text, written

#: At most so many pre-tokens are hot, of at most so many bytes each.
HOT_PARTS = 1 << 20
HOT_BYTES = 32
#: Distinct pre-tokens a task holds before it hands them on; they are added up after the shuffle.
HELD_PIECES = 200_000
#: The pattern of the byte-level pre-tokenizer (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PATTERN = regex.compile(BYTE_LEVEL.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_TOKENIZERS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_of(path: str):
    """The library's tokenizer and the pattern of its special tokens, loaded once in each worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        specials = sorted((t.content for t in loaded.get_added_tokens_decoder().values()), key=len, reverse=True)
        _TOKENIZERS[path] = loaded, regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
    return _TOKENIZERS[path]


def frequencies(text: str, specials) -> tuple[Counter, int]:
    """How often each pre-token occurs, and the number of special tokens."""
    parts = specials.split(text) if "<" in text or specials.search(text) else [text]
    found: Counter = Counter()
    for part in parts:
        found.update(_PATTERN.findall(part))
    return found, len(parts) - 1


def distinct_pieces(docs: DataFrame, vocabulary: str, text: str) -> DataFrame:
    """Every distinct pre-token of the corpus with its occurrences (piece, n)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, specials = tokenizer_of(vocabulary)
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for t in texts_of(batch):
                held.update(frequencies(t, specials)[0])
                if len(held) > HELD_PIECES:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    parts = map_arrow(docs.select(F.col(f"`{text}`").alias("_text")), task, "piece string, n long")
    return parts.groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """The number of tokens of each pre-token, counted once (piece, n, pieces)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, _ = tokenizer_of(vocabulary)
        for batch in batches:
            # Only lengths are asked for: no offsets are tracked and no ids leave the library.
            made = loaded.encode_batch_fast(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in made], pa.int32())], names=["piece", "n", "pieces"])

    return map_arrow(pieces, task, "piece string, n long, pieces int")


def hot_pieces(counts: DataFrame) -> dict[str, int]:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-total // HOT_PARTS))
    hot = counts.where((F.col("n") >= least) & (F.octet_length("piece") <= HOT_BYTES)).select("piece", "pieces")
    return {r[0]: r[1] for r in hot.collect()}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: list[str] = (), limit: int = 512) -> DataFrame:
    """The kept columns, n_bytes, n_tokens and over_limit of each row."""
    path = vocabulary or default_vocabulary()
    counts = written(piece_counts(distinct_pieces(docs, path, text), path), "pieces")
    hot = docs.sparkSession.sparkContext.broadcast(hot_pieces(counts))
    keep = list(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, specials = tokenizer_of(path)
        known = hot.value
        for batch in batches:
            totals, offsets, names, times = [], [0], [], []
            for t in texts_of(batch):
                found, total = frequencies(t, specials)
                for piece, n in found.items():
                    if (pieces := known.get(piece)) is None:
                        names.append(piece)
                        times.append(n)
                    else:
                        total += n * pieces
                totals.append(total)
                offsets.append(len(names))
            rest = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int32())], names=["piece", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)],
                names=["_row", "_hot", "_rest"],
            )

    # Rows are known by a number that is fixed once it is written, since ids may repeat or be null.
    numbered = docs.select(
        F.col(f"`{text}`").alias("_text"),
        F.struct(F.monotonically_increasing_id().alias("at"), F.octet_length(whole_text(f"`{text}`")).cast("long").alias("n_bytes"), *[F.col(f"`{k}`") for k in keep]).alias("_row"),
    )
    row = numbered.schema["_row"].dataType.simpleString()
    parts = written(map_arrow(numbered, task, f"_row {row}, _hot long, _rest array<struct<piece:string,n:int>>"), "frequencies")
    rare = parts.select(F.col("_row.at").alias("_at"), F.explode("_rest").alias("_r")).select("_at", F.col("_r.piece").alias("piece"), F.col("_r.n").alias("_n"))
    summed = rare.join(counts.select("piece", "pieces"), "piece").groupBy("_at").agg(F.sum(F.col("_n") * F.col("pieces")).alias("_more"))
    total = F.col("_hot") + F.coalesce("_more", F.lit(0))
    return (
        parts.select("_row", "_hot", F.col("_row.at").alias("_at"))
        .join(summed, "_at", "left")
        .select(*[F.col(f"_row.`{k}`").alias(k) for k in keep], F.col("_row.n_bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return count_tokens(docs, vocabulary, keep=["doc_id"], limit=limit)
