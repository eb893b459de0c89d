import random
import re

from upkeep.llm import secret_scan

RNG = random.Random(11)


def brute(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
        if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def test_base_spans_by_brute_force(spark):
    parts = ["token", "secret", "Api_Key", "PASSWORD", ":", "=", " ", "\"", "'", "abc", "0123456789abcdef", "AKIA",
             "ABCDEFGH1234567", "é", "\U0001F600", "\n", "ſecret"]
    rows = [(i, "".join(RNG.choice(parts) for _ in range(RNG.randrange(30)))) for i in range(400)]
    rows += [(1000, "token: secret: abcdefghijkl1234"), (1001, "AKIAKIAAKIA" + "A" * 14)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in secret_scan.find_secrets(docs).collect()}
    assert out == {i: brute(t) for i, t in rows}


def test_random_strings_are_added_and_words_are_not(spark):
    syllables = ["the", "ing", "ation", "con", "ver", "able", "pro", "ment"]
    rows = []
    for i in range(300):
        words = ["".join(RNG.choice(syllables) for _ in range(RNG.randrange(1, 7))) for _ in range(60)]
        if i % 3 == 0:
            words[5] = "token=" + "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
                                          for _ in range(32))
        if i == 1:
            words[7] = "q7ZkX0vP2mWt9RbL4sYc8DnJ"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    added = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"]:s["end"]] for s in r["added"]]
             for r in secret_scan.find_secrets(docs).collect() if r["added"]}
    assert added == {1: ["q7ZkX0vP2mWt9RbL4sYc8DnJ"]}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghijklmnop0123")], "doc_id bigint, text string")
    plan = secret_scan.find_secrets(docs, [0.1] * secret_scan.CODES**2)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
