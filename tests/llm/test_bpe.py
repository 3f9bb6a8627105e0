"""BPE with forced boundaries and token counts, against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from llm_tables import documents
from tokenizers import Tokenizer

from tallyframe.llm import bpe
from tallyframe.llm import token_counts as tc

LETTERS = "ab 'sS<|>end\n\t.é1ßΣİ\u00a0日"


def texts():
    r = random.Random(3)
    own = ["", None, "<|startoftext|>Hi<|endoftext|>", "x <|endoftext", "ΑΣ ΟΔΟΣ Σ", "a" * 3000, "don't I'LL we've 12345 ½ x_y", "e\u0301te\u0301", " \n ", "  two  spaces  ", "<|endoftext|><|endoftext|>"]
    return own + ["".join(r.choice(LETTERS) for _ in range(r.randrange(80))) for _ in range(300)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_and_decoding_equal_the_library(spark, word_library):
    docs = documents(spark, texts())
    ids = bpe.encode(docs, keep=["doc_id", "label", "_text"])
    rows = bpe.decode(ids, keep=["doc_id", "ids", "label"]).collect()
    assert len(rows) == len(texts())
    for row in rows:
        want = word_library.encode(texts()[row["doc_id"]] or "", add_special_tokens=False).ids
        assert list(row["ids"]) == want and row["label"] == "z"
        assert row["text"] == word_library.decode(want, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token():
    model = bpe.model_of(bpe.default_vocabulary())
    assert model.fragments("hello".encode()) == [b"hello"]
    word = "日é#日".encode()
    pieces = model.fragments(word)
    assert b"".join(pieces) == word
    plain = model.merged([*(model.first_ids[b] for b in word[:-1]), model.last_ids[word[-1]]])
    assert model.encode_word(word.decode()) == plain


def test_short_and_long_merging_agree():
    model = bpe.model_of(bpe.default_vocabulary())
    r = random.Random(4)
    for _ in range(200):
        ids = [model.first_ids[ord(r.choice("abcdehilnorst"))] for _ in range(r.randrange(2, 60))]
        assert model.merged_short(list(ids)) == model.merged_long(list(ids))


def test_forgetting_words_changes_nothing(monkeypatch, word_library):
    model = bpe.ForcedBoundaryBpe(bpe.default_vocabulary())
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    for text in texts()[:40]:
        values, _ = model.encode_batch([text or ""])
        assert values.tolist() == word_library.encode(text or "", add_special_tokens=False).ids


def test_round_trip_digests(spark, word_library):
    row = bpe.bpe_round_trip(documents(spark, ["Hello, world!"])).first()
    ids = word_library.encode("Hello, world!", add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = bpe.bpe_round_trip(documents(spark, [None])).first()
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_round_trip(documents(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [tc.HOT_PARTS, 4])
def test_counts_equal_the_library(spark, monkeypatch, parts):
    """Whether most pre-tokens take the table of frequent ones or the shuffle."""
    monkeypatch.setattr(tc, "HOT_PARTS", parts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    every = texts() + texts()[:5]
    docs = documents(spark, every, ids=[*range(len(every) - 2), None, 0])
    rows = tc.token_counts(docs).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in every)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_counts_of_an_empty_table(spark):
    assert tc.token_counts(documents(spark, [])).count() == 0


def test_one_worker_a_task(spark, capsys):
    bpe.bpe_round_trip(documents(spark, texts())).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_slices_are_bounded_by_bytes(spark, monkeypatch, word_library):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 200)
    model = bpe.model_of(bpe.default_vocabulary())
    batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array([t or "" for t in texts()])], names=["text"])
    slices = list(bpe.light([batch]))
    assert bpe.pa.Table.from_batches(slices).to_pylist() == batch.to_pylist()
    assert all(s.num_rows == 1 or s.nbytes <= 200 for s in slices)
    found = [ids for s in slices for ids in model.encode_lists(s.column(0).to_pylist()).to_pylist()]
    assert found == [word_library.encode(t or "", add_special_tokens=False).ids for t in texts()]
