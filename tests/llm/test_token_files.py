from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rewardloom.llm import queries as Q
from rewardloom.llm import token_files
from rewardloom.session import scratch_table_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = Q.op1_token_files(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert list(map(tuple, got)) == expected([(d["doc_id"], d["text"]) for d in docs])


def test_awkward_rows_and_copies_across_shards(spark, awkward):
    more = awkward.unionAll(awkward.where("doc_id = 5 or doc_id is null").limit(3))
    docs = more.unionAll(spark.createDataFrame([(6, "same")] * 40, "doc_id long, text string").selectExpr("doc_id", "text", *[f"null as {c}" for c in awkward.columns[2:]]))
    got = list(map(tuple, Q.written_and_read(docs).orderBy("start").collect()))
    assert len(got) == docs.count()
    starts = [0]
    for _, start, n, _ in got:
        assert start == starts[-1]
        starts.append(start + n)
    ids = [g[0] for g in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = {(d, n, c) for d, _, n, c in expected([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {(d, n, c) for d, _, n, c in got} == want
    assert Q.written_and_read(docs.limit(0)).collect() == []


def test_lookup_of_single_and_unknown_keys(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(3000)], "doc_id long, text string")
    files = token_files.write(docs, scratch_table_path(spark, "token_files"), PATH, 2)
    asked = spark.createDataFrame([(17, 0), (2999, 0), (17, 1), (5000, 0)], "doc_id long, copy long")
    found = {r["doc_id"]: bytes(r["ids"]) for r in files.payloads(asked).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert found == {k: np.array([*tokenizer.encode(f"text number {k}").ids, 2], "<u2").tobytes() for k in (17, 2999)}


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    levels = token_files.perfect_levels(h1, h2)
    assert sorted(token_files.slots(levels, h1, h2).tolist()) == list(range(n))


def test_equal_hashes_raise():
    with pytest.raises(ValueError, match="128-bit"):
        token_files.perfect_levels(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_words_are_encoded_as_in_their_text():
    codes = token_files.Encoder(PATH)
    texts = ["", " ", "a  b", "x\n y z ", "　a b", "don't 12 <|endoftext|> z", "w" * 100 + " b"]
    whole = [np.array(codes.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert codes.encode(texts) == whole


def test_special_tokens_in_texts_are_read_as_the_library_reads_them(spark):
    texts = ["end <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " |endoftext|> <|", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, Q.written_and_read(docs).collect()))
    assert got == expected(list(enumerate(texts))) and got[0][2] == 5


def test_other_tokenizer_encodes_whole_texts():
    codes = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not codes.by_word and codes.encode(["Some  Text"]) == [np.array(codes.tokenizer.encode("Some  Text", add_special_tokens=False).ids, codes.dtype).tobytes()]


AWKWARD = [
    " ", "  ", "a", "Bc", "é", "à", "\u00a0", "\u2009", "\u3000", "\u0085", "\x1f", "\n", "\t", "\r\n", "\x00", "!", "123", "'s", "'", "(", "語", "’", "\U0001f600", "\u180e",
    "x" * 70, "ing", "The", "<|endoftext|>",
]


def test_mixed_texts_are_encoded_as_whole(monkeypatch):
    codes, draw = token_files.Encoder(PATH), random.Random(5)
    codes.known.limit = 300  # words come and go
    monkeypatch.setattr(token_files, "WORDS", 7)
    texts = ["".join(draw.choices([" "] * 12 + AWKWARD[draw.randint(0, 1) : draw.randint(20, len(AWKWARD))], k=draw.randint(0, 14))) for _ in range(4000)]
    whole = [np.array(x.ids, "<u2").tobytes() for x in codes.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert codes.encode(texts) == whole
    assert codes.encode(pa.array([None, *texts]).slice(1001, 2000)) == whole[1000:3000]
    assert len(codes.known) <= 300 and len(codes.known.old) <= 300


def test_cuts_are_where_matches_start():
    cut = lambda text: [int(x) for x in token_files.sure_cuts(np.frombuffer(text.encode(), np.uint8))]
    assert cut("ab, don't 12x.\nThe  a\u2009 b") == [2, 3, 7, 9, 12, 13, 14, 15]
    assert cut("") == cut("a") == cut(" ") == []


def test_words_are_shared_between_their_punctuations():
    codes, seen = token_files.Encoder(PATH), []
    learn = codes._learn
    codes._learn = lambda pieces: seen.extend(pieces) or learn(pieces)
    codes.encode([f"odd words{mark} odd words{mark}\nodd" for mark in ",.;:!?"])
    assert sorted(seen) == sorted(["odd", " odd", " words", *",.;:!?"])


def test_texts_are_encoded_in_runs_of_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "BYTES", 10)
    texts = pa.array(["abcd", None, "efgh", "x" * 35, "", "y"])
    assert list(token_files._parts(texts)) == [(0, 4), (4, 6)]
    assert list(token_files._parts(texts.slice(0, 0))) == []
