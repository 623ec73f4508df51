from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rewardloom.llm import bpe
from rewardloom.llm import queries as Q

PATH = public_tokenizers.path(Q.RANKS)


@pytest.fixture(scope="module")
def pairs():
    return bpe.byte_pairs(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def exact(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def same(pairs, exact, text):
    ids = pairs.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text), text[:60]
    assert pairs.decode(ids) == text.encode()


def test_texts(spark, pairs, exact):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        same(pairs, exact, r["text"])


def test_odd_texts(pairs, exact):
    rng = random.Random(3)
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(sorted(pairs.ranks), 2000)]
    for text in ["", " ", "  x", "x  ", " x  y \n z", "don't we'll", "a" * 9000, "ab" * 4000, " " * 500, "中" * 2000, "\x1c a \x1c", "　x　 y", "<|endoftext|>"]:
        same(pairs, exact, text)
    for _ in range(300):
        same(pairs, exact, "".join(rng.choices(tokens, k=40)))
        same(pairs, exact, "".join(rng.choices("aab ethin\n\t 　\x85中ы's9", k=200)))


def test_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.BytePairs(bpe.read_ranks(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    same(own, other, "The quick brown fox's 12 friends — ließen   grüßen.")


def test_query_and_awkward_rows(spark, awkward, exact):
    got = sorted(map(tuple, Q.encoded_and_decoded(awkward).collect()), key=str)
    want = []
    for r in awkward.collect():
        ids = exact.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert Q.encoded_and_decoded(awkward.limit(0)).count() == 0


def test_decode_column(spark, awkward):
    encoded = bpe.encode(awkward, PATH, public_tokenizers.PATTERN)
    back = encoded.select(bpe.decode_column(encoded["ids"], PATH, public_tokenizers.PATTERN).alias("b")).collect()
    assert sorted(bytes(r["b"]) for r in back) == sorted((r["text"] or "").encode() for r in awkward.collect())
