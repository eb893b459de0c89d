import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from upkeep.llm import permuterm

SCHEMA = "doc_id bigint, text string, word string, n int"


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def compared(spark, docs):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = sorted((tuple(r) for r in permuterm.group_variants(table).collect()), key=str)
    assert got == brute(docs)
    return got


def test_variants_by_brute_force(spark):
    family = ["balloon", "baloon", "balon", "ballooon", "balloons", "ballon", "bálloon", "zalloon"]
    docs = [(i, " ".join(family[:1 + i % 8]) + " Balloon BALLOON, balloon's Über-gänger überganger " * (i % 5))
            for i in range(300)]
    docs += [(1000 + i, "aaaaaaa aaaaaaaa aaaaaaaaa abababab babababa bababab ÀÉÎÕÜÝÞß àéîõüýþÿ x×÷yyyyyy") for i in range(20)]
    got = compared(spark, docs)
    assert any(r[1] for r in got) and max(r[4] for r in got) >= 3


def test_chains_lead_to_the_last(spark):
    docs = [(1, "tangling " * 2000), (2, "tanglings " * 150), (3, "tanglingss " * 12)]
    got = {r[0]: r for r in compared(spark, docs)}
    assert got["tanglingss"][1:3] == ("tanglings", "tangling") and got["tanglings"][2] == "tangling"


def test_ties_go_to_the_smallest(spark):
    docs = [(7, "maroon bassoon " + "bassoonx " * 40 + "bassoony " * 40 + "bassoon " * 3)]
    got = {r[0]: r for r in compared(spark, docs)}
    assert got["bassoon"][1] == "bassoonx"


def test_defined_cases(spark):
    long = "lettering " * 50_000 + "q" * 100_000 + " " + "q" * 100_000
    compared(spark, [(None, None), (None, ""), (1, "   "), (None, "letterin letterin lettering"), (2, long), (2, long),
                     (3, "ﬁﬂ İıſK 12345678 __________")])
    empty = spark.createDataFrame([], SCHEMA)
    assert permuterm.group_variants(empty).collect() == []


def test_rotations_meet_once(spark):
    words = ["abbaab", "aabbaab", "aabbaabb", "acbbaab"]
    found = spark.createDataFrame(list(enumerate(words)), "id bigint, word string")
    got = {words[r["id"]]: (r["n_near"], words[r["top"]]) for r in permuterm.near_words(found).collect()}
    assert got == {"aabbaab": (3, "abbaab"), "abbaab": (2, "aabbaab"), "aabbaabb": (1, "aabbaab"),
                   "acbbaab": (2, "abbaab")}
    assert permuterm.rotations(found).where(F.col("skips")).count() == sum(map(len, words))


def test_long_words_by_digests(spark):
    """Words about and over the length from which prefixes are digests."""
    base = "abcdefghij" * 20
    docs = []
    for size in (62, 63, 64, 65, 66, 67, 149, 150):
        for w in (base[:size], base[:size] + "q", "q" + base[1:size], base[:30] + base[29:size], base[:30] + "z" + base[31:size]):
            docs += [(len(docs), w), (len(docs) + 1, w), (len(docs) + 2, w)]
    assert any(r[4] >= 3 for r in compared(spark, docs) if len(r[0]) > 100)


def test_digests_equal_those_of_the_rotations():
    def digest(text):
        return [sum(ord(c) * pow(b, k, int(permuterm._PRIME)) for k, c in enumerate(text)) % int(permuterm._PRIME)
                for b in permuterm._BASES]

    word = "überlänge" * 9
    whole, skipped = permuterm.rotation_digests(word)
    for cut in range(len(word) + 1):
        assert whole[cut].tolist() == digest(word[cut:] + "$" + word[:cut])
        assert not cut or skipped[cut - 1].tolist() == digest(word[cut:] + "$" + word[:cut - 1])
