"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over: a token that
spans it would have to contain it. Every such pair inside a pre-token is therefore a certain cut.
The fragments between cuts are encoded by themselves and their ids are concatenated, which gives
exactly the ids of the whole pre-token.

The vocabulary file is a ``tokenizers`` JSON file of a byte-level BPE model with an end-of-word
suffix, lower-cased NFC text and a splitting pattern that drops white space. Added special tokens
found in the raw text become their own ids. Without a decoder in the file, decoding joins the
tokens' strings with one space, special tokens included.

Defined results: null and empty texts give no ids, and no ids decode to the empty string. Repeated
rows are encoded one by one; other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import apart, map_arrow, texts_of

#: Encoded pre-tokens that a worker keeps; it starts anew beyond that, which changes no result.
KEPT_WORDS = 500_000
#: Rows of a slice hold at most so many bytes, unless it is one row.
SLICE_BYTES = 1 << 25
#: Fragments up to this many bytes are merged by a plain scan, longer ones with a queue.
SHORT = 48
NO_MERGE = (1 << 60, -1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def splitting_pattern(pre_tokenizer: dict) -> str:
    for part in pre_tokenizer.get("pretokenizers", [pre_tokenizer]):
        if part["type"] == "Split":
            return part["pattern"]["Regex"]
    raise ValueError("the vocabulary file has no splitting pattern")


class ForcedBoundaryBpe:
    """The model of a vocabulary file, with the byte pairs that its tokens contain."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        model = parsed["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = {
            (self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a.removesuffix(self.suffix) + b])
            for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        }
        self.specials = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.split_specials = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        # White space is the Unicode property, without the separators 1C to 1F.
        self.find_words = regex.compile(splitting_pattern(parsed["pre_tokenizer"]).replace(r"\s", r"\p{White_Space}"))
        characters = byte_characters()
        self.first_ids = [self.vocabulary[c] for c in characters]
        self.last_ids = [self.vocabulary[c + self.suffix] for c in characters]
        to_byte = {c: b for b, c in enumerate(characters)}
        self.inside: set[tuple[int, int]] = set()
        for token in self.vocabulary:
            codes = [to_byte[c] for c in token.removesuffix(self.suffix)]
            self.inside.update(zip(codes, codes[1:]))
        strings = [""] * (max([*self.vocabulary.values(), *self.specials.values()]) + 1)
        for token, number in [*self.vocabulary.items(), *self.specials.items()]:
            strings[number] = token
        self.strings = pa.array(strings)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.starts, self.sizes = array("i"), array("q"), array("q")

    def merged(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        if len(ids) < 2:
            return ids
        return self.merged_short(ids) if len(ids) <= SHORT else self.merged_long(ids)

    def merged_short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        found = [merges.get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while (best := min(found)) is not NO_MERGE:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(found):
                found[i] = merges.get((ids[i], ids[i + 1]), NO_MERGE)
            if not found:
                break
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue, so that time grows with n log n."""
        merges, size = self.merges, len(ids)
        ids, after, before = list(ids), list(range(1, size + 1)), list(range(-1, size - 1))
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(size - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < size:
                before[after[j]] = i
                if found := merges.get((new, ids[after[j]])):
                    heapq.heappush(queue, (found[0], i, new, ids[after[j]], found[1]))
            if (k := before[i]) >= 0 and (found := merges.get((ids[k], new))):
                heapq.heappush(queue, (found[0], k, ids[k], new, found[1]))
        return [x for x in ids if x >= 0]

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every byte pair that no token contains."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_word(self, word: str) -> list[int]:
        *pieces, last = self.fragments(word.encode())
        ids: list[int] = []
        for piece in pieces:
            ids += self.merged([self.first_ids[b] for b in piece])
        return ids + self.merged([*(self.first_ids[b] for b in last[:-1]), self.last_ids[last[-1]]])

    def number(self, word: str, special: int | None = None) -> int:
        """The place of a pre-token among the encoded ones."""
        ids = self.encode_word(word) if special is None else [special]
        self.known[word if special is None else ("special", word)] = place = len(self.sizes)
        self.starts.append(len(self.values))
        self.sizes.append(len(ids))
        self.values.extend(ids)
        return place

    def words(self, text: str) -> list[int]:
        """The places of a text's pre-tokens, special tokens included."""
        places: list[int] = []
        start = 0
        if "<" in text or not all(s.startswith("<") for s in self.specials):
            for found in self.split_specials.finditer(text):
                places += self.plain(text[start : found.start()])
                key = ("special", found.group())
                places.append(self.known[key] if key in self.known else self.number(found.group(), self.specials[found.group()]))
                start = found.end()
        return places + self.plain(text[start:])

    def plain(self, text: str) -> list[int]:
        if not text:
            return []
        # Lower case by character, so a sigma at the end of a word stays the usual one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known, number = self.known, self.number
        return [known[w] if w in known else number(w) for w in self.find_words.findall(text)]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin and end."""
        if len(self.sizes) > KEPT_WORDS:
            self.forget()
        places = [self.words(t) for t in texts]
        flat = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=sum(map(len, places)))
        if not len(flat):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        # Views of the kept words, not copies; none outlives this call, so the arrays can grow again.
        sizes, starts, values = np.frombuffer(self.sizes, np.int64), np.frombuffer(self.starts, np.int64), np.frombuffer(self.values, np.int32)
        lengths = sizes[flat]
        ends = np.cumsum(lengths)
        take = np.repeat(starts[flat] - (ends - lengths), lengths) + np.arange(ends[-1])
        borders = np.concatenate([[0], np.cumsum([len(x) for x in places])])
        return values[take], np.concatenate([[0], ends])[borders]

    def encode_lists(self, texts: list[str]) -> pa.ListArray:
        values, offsets = self.encode_batch(texts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        flat = pa.array(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.strings.take(flat)), " ")


_MODELS: dict[str, ForcedBoundaryBpe] = {}


def model_of(path: str) -> ForcedBoundaryBpe:
    """The model of a file, read once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = ForcedBoundaryBpe(path)
    return _MODELS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def carried(df: DataFrame, keep: list[str], new: str) -> tuple[list, str]:
    """The kept columns and their schema; a kept column never has the new one's name."""
    if new in keep:
        raise ValueError(f"a kept column is already called {new}")
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [F.col(f"`{k}`") for k in keep], "".join(f"`{k}` {fields[k]}, " for k in keep)


def light(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``SLICE_BYTES`` or one row, so that lists of ids stay small as well."""
    for batch in batches:
        if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
            half = batch.num_rows // 2
            yield from light([batch.slice(0, half), batch.slice(half)])
        else:
            yield batch


def encode(df: DataFrame, vocabulary: str | None = None, text: str = "text", keep: list[str] = (), ids: str = "ids") -> DataFrame:
    """The kept columns of each row and the ids of its whole text."""
    path = vocabulary or default_vocabulary()
    columns, schema = carried(df, keep := list(keep), ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in light(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], model.encode_lists(texts_of(batch))], names=[*keep, ids])

    return map_arrow(df.select(F.col(f"`{text}`").alias(apart(keep)), *columns), task, f"{schema}`{ids}` array<int>")


def decode(df: DataFrame, vocabulary: str | None = None, ids: str = "ids", keep: list[str] = (), text: str = "text") -> DataFrame:
    """The kept columns of each row and the text of its ids."""
    path = vocabulary or default_vocabulary()
    columns, schema = carried(df, keep := list(keep), text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], model.decode_batch(batch.column(0))], names=[*keep, text])

    return map_arrow(df.select(F.col(f"`{ids}`").alias(apart(keep)), *columns), task, f"{schema}`{text}` string")


def digests_of(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them, a row for each document.

    A text is encoded, and its ids decoded, in one task by one worker: two Python stages in a row would hold
    the model twice and send all ids through the JVM between them.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in light(batches):
            ids = model.encode_lists(texts_of(batch))
            numbers = pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string()))
            columns = [batch.column(1), pc.cast(pc.list_value_length(ids), pa.int64()), digests_of(pc.binary_join(numbers, " ")), digests_of(model.decode_batch(ids))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select("text", "doc_id"), task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
