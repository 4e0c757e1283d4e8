"""Byte-pair encoding against the public library and by round trip."""

import os
import random

import pytest

from ferrule.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.DEFAULT_RANKS), reason="the vocabulary isn't here")
TEXTS = ["", " ", "a", "Hello  world", "<|endoftext|>", " \n\n x", "a" * 2000, "日本語テキスト🙂 " * 30, "   a  b \t c d e\x1c f\x85g '' 's 'll don't  ", "naïve café\r\n\r\n  x", "x" * 700 + " y"]


@pytest.fixture(scope="module")
def public():
    import tiktoken

    bpe = encode.BytePair(encode.read_ranks())
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})


def test_same_as_public(public):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(" \n\t  \x1c\x85ab1é½.'s🙂中") for _ in range(rng.randrange(60))) for _ in range(2000)]
    bpe = encode.BytePair(encode.read_ranks())
    ids, lengths = bpe.encode_batch(texts)
    at = 0
    for t, n in zip(texts, lengths):
        assert ids[at : at + n].tolist() == public.encode_ordinary(t)
        at += n


def test_long_merge_equals_short():
    bpe = encode.BytePair(encode.read_ranks())
    rng = random.Random(2)
    for _ in range(50):
        data = "".join(rng.choice("abcdeinst ") for _ in range(rng.randrange(2, 250))).encode()
        if data not in bpe.ranks:
            assert bpe.merge(data) == bpe._merge_long(data)


def test_frame(spark, public):
    rows = [(1, None, 9), (2, "", 9), (3, "ab cd", 9), (4, "ab cd", 9), (5, "word " * 20000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert got[1] == got[2] == [] and got[3] == got[4] == public.encode_ordinary("ab cd") and got[5] == public.encode_ordinary("word " * 20000)
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert encode.encode(df.limit(0)).count() == 0
