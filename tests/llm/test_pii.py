import random
import re
import sys
import time

import numpy as np
import pytest

from upkeep.llm import pii

RNG = random.Random(3)


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                         if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans_by_brute_force():
    parts = ["a", "x.y", "@", "@b.c", ".", "12", "255.", "4111 1111 1111 1111", "+1 (555) 010-1234", " ", "-", "_", "é",
             "10.0.0.1", "000300.1.1.1", "+", "\n", "@@", "4539578763621486"]
    for _ in range(3000):
        t = "".join(RNG.choice(parts) for _ in range(RNG.randrange(16)))
        assert pii.base_spans(t) == brute(t), t


def test_tokens_by_brute_force():
    for _ in range(500):
        t = "".join(RNG.choice("ab1@ \n\t.") for _ in range(RNG.randrange(25)))
        want = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if re.search("[0-9@]", m[0])]
        assert pii.tokens(t) == want


def test_long_mail_characters_take_linear_time():
    assert pii.base_spans("a" * 300_000 + " x@y.z " + "b" * 300_000)[0][1] == 0


@pytest.mark.parametrize("text", [
    "1" * 1_000_000, "1." * 400_000, ("1" * 999 + ".") * 800, "+1" + "." * 800_000, "+1( " * 100_000, "a@" * 300_000,
    "x@" + "a." * 300_000 + "@", ("1" * 25 + " ") * 20_000, "+1 (234) 56789012345678901 " * 10_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    spans = pii.base_spans(text)
    graph = pii.Graph()
    graph.add(0, text, spans)
    assert time.time() - began < 20
    short = text[:3000]
    assert pii.base_spans(short) == brute(short)


def test_numbers_of_thousands_of_digits():
    sys.set_int_max_str_digits(0)
    try:
        for t in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000, "0" * 6000 + "255.0.0.1", "9" * 5000 + ".1.1.1", "1.2.3." + "1" * 5000):
            assert pii.base_spans(t) == brute(t)
    finally:
        sys.set_int_max_str_digits(4300)


def test_unsure_spans_are_apart_and_in_order():
    for _ in range(300):
        t = "".join(RNG.choice(["+1 ", "1" * 21, "2 ", "x", "-", "(", "3" * 8]) for _ in range(30))
        spans = pii.unsure_spans(t)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(a < b for a, b in spans)


def test_message_passing_is_exact_on_a_tree():
    unary, pair = np.random.default_rng(1).normal(size=(4, pii.K)), np.random.default_rng(2).normal(size=(3, pii.K, pii.K))
    edges = np.array([[0, 1, 0], [1, 2, 1], [1, 3, 2]])
    got, _, _ = pii.propagate(unary, edges, pair, 60)
    want = np.zeros_like(unary)
    for y in np.ndindex(*(pii.K,) * 4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[t, y[i], y[j]] for i, j, t in edges))
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def corpus():
    rows = []
    for i in range(300):
        phone = f"+1 ({RNG.randrange(200, 999)}) 555-{RNG.randrange(1000, 9999)}"
        rows.append(" ".join(RNG.choice([phone, f"u{i}@mail{i % 9}.example.com", f"{i % 200}.{i % 7}.3.{i % 99}", "12", "word",
                                         "4539578763621486",
                                         "in 1999", "a1", "7"]) for _ in range(8)))
    return rows


def test_repeated_tokens_share_a_label(spark):
    rows = corpus()
    text = "call +1 (555) 555-1234 4111111111111111 or write; later +1 (555) 555-1234 again, the year 1999 and 42"
    docs = spark.createDataFrame(list(enumerate([*rows, text])), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}[len(rows)]
    base, added = ([text[s["start"]:s["end"]] for s in out[k]] for k in ("base", "added"))
    # The first number runs into the card, so the pattern drops it; its repetition names it.
    assert base == ["+1 (555) 555-1234"] and "+1 (555) 555-1234" in added
    assert not any("1999" in x or "42" in x for x in added)


def test_masking(spark):
    assert pii.masked("a x@y.z b", [(2, 0, 7)]) == "a <email> b"
    assert pii.masked("0123456789", [(1, 2, 5), (3, 3, 7), (8, 1, 9)]) == "0<card>7<ip>9"
    docs = spark.createDataFrame([(1, "mail x@y.z now", 14), (2, None, None)], "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask_pii(docs).collect()}
    assert out == {1: ("mail <email> now", 16), 2: (None, None)}
