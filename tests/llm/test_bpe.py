import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from upkeep.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RNG = random.Random(8)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    for alphabet in ["a", "ab", "abc ", "aéß", "\U0001F600a ", "-=_", "the ing tion ", "01234", "日本語の", " \n\t", "Straße's"]:
        for n in (0, 1, 7, 60, 400):
            yield "".join(RNG.choice(alphabet) for _ in range(n))
    yield "a" * 20_000


def test_ids_equal_the_library(ranks, library):
    recent, pattern = bpe._Recent(bpe.Codec(ranks)), regex.compile(PATTERN)
    for text in samples():
        got = np.frombuffer(bpe.encode_text(text, pattern, recent), "<u4").tolist()
        assert got == library.encode_ordinary(text)


def test_tree_and_direct_merging_agree(ranks):
    codec = bpe.Codec(ranks)
    for text in samples():
        data = text.encode()
        if len(data) < 3000:
            assert codec.tree(data) == codec._merge_heap(data)
            if data and len(data) <= bpe.SMALL:
                assert codec.merge(data) == codec._merge_heap(data)


def test_joining_is_associative(ranks):
    codec = bpe.Codec(ranks)
    for _ in range(200):
        a, b, c = ("".join(RNG.choice("aeinst ") for _ in range(RNG.randrange(12))).encode() for _ in range(3))
        x, y, z = map(codec.tree, (a, b, c))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.tree(a + b + c)


def test_long_texts_in_blocks(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    recent, text = bpe._Recent(bpe.Codec(ranks)), "some words, and  more words 123 " * 20
    assert np.frombuffer(bpe.encode_text(text, regex.compile(PATTERN), recent), "<u4").tolist() == library.encode_ordinary(text)


def test_round_trip(spark):
    texts = list(samples())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in out} == dict(enumerate(texts))
