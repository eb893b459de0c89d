import random

from upkeep.llm import quality
from upkeep.llm.words import word_hashes

RNG = random.Random(9)


def brute_repeats(text: str, n: int = 8) -> int:
    w = text.split()
    runs = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    return len({p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + n)})


def test_repeated_words_by_brute_force():
    data = [" ".join(RNG.choice("abc") for _ in range(RNG.choice([0, 5, 8, 9, 30, 60]))) for _ in range(80)]
    data += ["x " * 40, "a b c d e f g h " * 3]
    assert quality.repeated_words(*word_hashes([t.encode() for t in data])) == [brute_repeats(t) for t in data]


def test_a_common_line_is_removed_and_copies_are_not(spark):
    own = [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(30)]
    menu = "Home Contact " + " ".join(f"m{i}" for i in range(30))
    rows = [(d, f"{own[d]}\n{menu}", "h") for d in range(30)]                       # a menu and own text
    rows += [(100 + d, f"{menu}\nshort {d}", "h") for d in range(5)]                # hardly more than the menu
    article = "\n".join(" ".join(f"c{j}y{i}" for i in range(20)) for j in range(4))
    rows += [(200 + d, article, "h") for d in range(40)]                            # copies of one article
    rows += [(300, f"{own[0]}\n{menu}", "other")]                                   # the menu is rare at this host
    out = {r["doc_id"]: r for r in quality.quality(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[d]["removed_words"] == 32 * (d > 0) and out[d]["kept"] for d in range(30))     # the first holder keeps it
    assert not any(out[100 + d]["kept"] or out[100 + d]["base_failed"] for d in range(5))
    assert all(out[200 + d]["removed_words"] == 0 and out[200 + d]["kept"] for d in range(40))
    assert out[300]["removed_words"] == 0


def test_two_long_shared_lines_are_removed(spark):
    notice = "Legal notice " + " ".join(f"n{i}" for i in range(40))
    footer = "Footer of the page " + " ".join(f"f{i}" for i in range(30))
    rows = [(d, f"Page {d}\n{notice}\n{footer}", "h") for d in range(30)]              # hardly any text of their own
    rows += [(100, f"{notice}\n" + " ".join(f"w{i}" for i in range(90)), "h")]
    out = {r["doc_id"]: r for r in quality.quality(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[d]["removed_words"] == 76 and not out[d]["kept"] for d in range(1, 30))
    assert out[0]["removed_words"] == 0 and out[0]["kept"]                              # one of them stays
    assert not any(out[d]["base_failed"] for d in range(30))
    assert out[100]["removed_words"] == 42 and out[100]["kept"]


def test_one_of_many_edited_copies_stays(spark):
    story = [" ".join(f"s{j}y{i}" for i in range(12)) for j in range(20)]
    rows = []
    for d in range(14):
        lines = list(story)
        lines[d] = f"an edited line {d}"
        rows.append((d + 5, "\n".join(lines), "h"))
    rows += [(100 + d, " ".join(f"w{d}x{i}" for i in range(40)), "h") for d in range(60)]
    out = {r["doc_id"]: r["kept"] for r in quality.quality(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [i for i in out if i < 100 and out[i]] == [5] and all(out[100 + d] for d in range(60))


def test_line_rule_by_brute_force(spark):
    rng = random.Random(6)
    common = [" ".join(f"c{k}w{i}" for i in range(rng.randrange(1, 30))) for k in range(12)]
    rows = []
    for d in range(160):
        lines = [rng.choice(common).upper() if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randrange(0, 9))]
        lines += [" ".join(f"d{d}x{i}" for i in range(rng.randrange(0, 25)))]
        rows.append((rng.choice([None, d, d, d, d % 7]), "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += rows[:10]
    norm = lambda x: " ".join(x.lower().split())
    held, texts = {}, {}
    for i, text, host in rows:
        texts.setdefault(host, set()).add(text)
        for line in {norm(x) for x in text.split("\n")} - {""}:
            at = held.setdefault((host, line), {})
            at[text] = min([x for x in (at.get(text), i) if x is not None], default=None)
    want = []
    for i, text, host in rows:
        n = 0
        for x in text.split("\n"):
            at = held.get((host, norm(x)), {})
            if len(at) > 10 and len(at) > 0.05 * len(texts[host]):
                ids = [v for v in at.values() if v is not None]
                n += len(x.split()) * (at[text] is None or at[text] != min(ids))
        want.append((i, n))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [(r["doc_id"], r["removed_words"]) for r in quality.quality(docs).collect()]
    # A doc_id on several texts of a host can make two of them the first by id: the hash decides.
    twice = {i for i in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == i}) > 1}
    assert sorted(x for x in got if x[0] not in twice) == sorted(x for x in want if x[0] not in twice)
    assert sum(n for _, n in got) > 0


def test_figures(spark):
    rows = [(1, "a# b\n a# b\na# b\n\n é", "s")]
    r = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (7, 11, 3, 1)
    assert r["base_failed"] and not r["kept"]
