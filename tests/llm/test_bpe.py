import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import byte_bpe
from corpusloom.llm.queries import bpe_tokenizer

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODER = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
WANTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    (packed,) = ENCODER.encode([text])
    assert ids(packed) == WANTED.encode_ordinary(text)
    assert ENCODER.decode(packed).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theainrs 'd\n\t1é中\x1c\x85　", max_size=80))
def test_texts_with_many_merges(text):
    assert ids(ENCODER.encode([text])[0]) == WANTED.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, "thehehe" * 500, "é" * 700, " " * 999, "<|endoftext|>", "\n" * 400 + "x"])
def test_long_pieces(text):
    assert ids(ENCODER.encode([text])[0]) == WANTED.encode_ordinary(text)


def test_matrix_and_heap_agree():
    rnd = random.Random(1)
    pieces = ["".join(rnd.choice("theainrsé") for _ in range(rnd.randint(1, 120))).encode() for _ in range(300)]
    assert [m.tolist() for m in ENCODER.merge_matrix(pieces)] == [ENCODER.merge_long(p) for p in pieces]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for i in range(20):
        text = f"some words number {i} and {i * i}"
        assert ids(encoder.encode([text])[0]) == WANTED.encode_ordinary(text)
    assert len(encoder.known) < 20


def test_documents(spark, documents, pairs):
    tokenizer = bpe_tokenizer(spark)
    for row in tokenizer.decode(tokenizer.encode(documents)).collect():
        assert ids(row.ids) == WANTED.encode_ordinary(row.text)
        assert row.n_tokens == len(row.ids) // 4 and bytes(row.decoded).decode() == row.text


def test_odd_rows(spark, odd, odd_pairs):
    tokenizer = bpe_tokenizer(spark)
    rows = tokenizer.decode(tokenizer.encode(odd)).collect()
    assert len(rows) == 11 and set(rows[0].asDict()) == {*odd.columns, "ids", "n_tokens", "decoded"}
    for row in rows:
        assert bytes(row.decoded).decode() == (row.text or "")
        assert hashlib.sha256(row.ids).digest() == hashlib.sha256(
            np.array(WANTED.encode_ordinary(row.text or ""), dtype="<u4").tobytes()
        ).digest()
    assert tokenizer.decode(tokenizer.encode(odd.limit(0))).count() == 0


def test_two_vocabularies_in_one_worker(spark, documents, tmp_path):
    path = tmp_path / "bytes.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    small = byte_bpe.Tokenizer(spark, str(path), public_tokenizers.PATTERN)
    both = small.encode(documents.limit(20)).selectExpr("doc_id", "text", "n_tokens AS n_bytes")
    for row in bpe_tokenizer(spark).encode(both).collect():
        assert row.n_bytes == len(row.text.encode()) and row.n_tokens == len(WANTED.encode_ordinary(row.text))


def test_round_trip_in_one_worker(spark):
    tokenizer = bpe_tokenizer(spark)
    rows = spark.createDataFrame([(1, "Aé  x\n"), (2, None), (2, ""), (None, "\x00 naïve 🙂")], "doc_id long, text string")
    once = tokenizer.round_trip(rows, keep=["doc_id"])
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, tokenizer.decode(tokenizer.encode(rows, keep=["doc_id"])).collect()))
