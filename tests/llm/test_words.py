import random

import numpy as np

from upkeep.llm import words

RNG = random.Random(7)


def texts():
    alphabet = ["a", "bc", "é", "\t", "\n", " ", "  ", "\x0b", "日"]
    return ["".join(RNG.choice(alphabet) for _ in range(RNG.choice([0, 1, 5, 40]))).encode() for _ in range(60)]


def test_equal_words_have_equal_hashes_and_others_do_not():
    data = texts()
    hashes, counts = words.word_hashes(data)
    flat = [w for t in data for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in data]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_texts_hash_like_short_ones(monkeypatch):
    data = [b"alpha beta gamma " * 20, b"x" * 40 + b" beta"]
    whole, _ = words.word_hashes(data)
    monkeypatch.setattr(words, "_LIMIT", 64)
    cut, counts = words.word_hashes(data)
    assert cut.tolist() == whole.tolist() and counts.tolist() == [60, 2]


def test_runs_stay_inside_their_text():
    data = [b"a b c d", b"", b"a b", b"b c d", b"c d a b c"]
    hashes, counts = words.word_hashes(data)
    runs, first, per_text = words.run_hashes(hashes, counts, 3)
    assert per_text.tolist() == [2, 0, 0, 1, 3]
    flat = [w for t in data for w in t.split()]
    seen = {tuple(flat[i:i + 3]): h for i, h in zip(first, runs.tolist())}
    assert seen[b"b", b"c", b"d"] == runs.tolist()[1] == runs.tolist()[2]
    assert len(set(seen.values())) == len(seen)


def test_nothing():
    hashes, counts = words.word_hashes([])
    assert len(hashes) == 0 and len(counts) == 0
    assert len(words.run_hashes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 5)[0]) == 0
