"""Spelling variant grouping over permuterm rotations (operator 13).

A word ``w`` is marked with a terminator, ``w$``, and written in all its
rotations.  For a word ``a c b`` with a character ``c`` between the parts
``a`` and ``b``, the rotation that starts behind ``c`` is ``b $ a c``: its
prefix without the last character, ``b $ a``, names the word with that
character skipped and remembers where.  So in the sorted rotations

* words that differ in one replaced character stand in one group of equal
  prefixes ``b $ a``, each with its own last character;
* the word ``a b``, which lacks the character, has ``b $ a`` as a whole
  rotation and stands in the same group.

A group holds at most one word for each letter and one whole word (the prefix
fixes everything else), which is a bound of 91 members.  The groups are
scanned: every member takes the number of its neighbours there and the most
frequent of them.  A word with a run of equal letters loses the same letter in
several ways; only the first way of a run counts as an indel, so that every
pair of near words meets exactly once.

Counts are combined before they are shuffled (a frequent word costs a row per
task); rotations are made of distinct words only, and carry a number that
orders the words by count instead of the word.  Prefixes of very long words
are represented by digests (four residues of a polynomial, about 120 bits).

Defined cases: a null text has no words; a null doc_id is written as an empty
text in the hash; texts of any length are read whole, by one pattern; repeated
rows count again; ties between near words go to the smallest in code-point
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import drop_shared, map_arrow, shared_table

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS = 7
LEAST_COUNT = 2
EDIT_EVERY = 31
TIMES = 10                      # a form is at least so many times as frequent as its variant
LITERAL = 64                    # longest prefix that is written out
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_103_515_245, 715_225_739, 1_812_433_253 % ((1 << 31) - 1), 69_069_069)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of ``docs`` (``doc_id, text``).

    Only runs of ``LEAST_CHARS`` letters or more are taken: shorter ones make
    no word, and a deletion only shortens them."""
    found = F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LEAST_CHARS},}})"), 1)
    runs = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
            .withColumn("run", F.translate("run", _UPPER, _LOWER)))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    spelled = (runs.withColumn("h", h)
               .select(F.when(F.col("h") % EDIT_EVERY == 0, without(F.col("run"), at))
                       .otherwise(F.col("run")).alias("word")))
    return (spelled.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def ranked(docs: DataFrame) -> DataFrame:
    """``id, word, n`` as a table; a smaller id is a larger ``n``, then the
    smaller word in code-point order."""
    order = words(docs).orderBy(F.col("n").desc(), "word")
    return shared_table(order.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def rotations(found: DataFrame) -> DataFrame:
    """``prefix, id, skips, first``: rotations of ``word$`` less their last
    letter (``skips``; ``first`` if that letter begins a run of equal ones),
    and whole ones.  A prefix of more than ``LITERAL`` characters is named by
    its length and a digest, so a word costs room in proportion to its length."""
    size = F.length("word")
    cut = found.where(size <= LITERAL).withColumn("cut", F.explode(F.sequence(F.lit(0), size)))     # letters in front
    behind, front = F.substring("word", F.col("cut") + 1, size), F.substring(F.col("word"), F.lit(1), F.col("cut"))
    whole = cut.where(size < LITERAL).select(
        F.concat(behind, F.lit("$"), front).alias("prefix"), "id", F.lit(False).alias("skips"), F.lit(False).alias("first"))
    # The same rotation without its last letter, which is the letter before the cut.
    letter = F.substring("word", F.col("cut"), F.lit(1))
    before = F.substring("word", F.col("cut") - 1, F.lit(1))
    skipped = cut.where("cut > 0").select(
        F.concat(behind, F.lit("$"), F.substring(F.col("word"), F.lit(1), F.col("cut") - 1)).alias("prefix"),
        "id", F.lit(True).alias("skips"), ((F.col("cut") == 1) | (letter != before)).alias("first"))
    long = map_arrow(found.where(size >= LITERAL).select("id", "word"), _long_rotations,
                     "prefix string, id bigint, skips boolean, first boolean")
    return whole.unionByName(skipped).unionByName(long)


def rotation_digests(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all rotations of ``word$`` by the cut, whole (cuts 0 to L)
    and without the letter before the cut (cuts 1 to L): rows of residues of
    the polynomial of the characters at ``_BASES`` modulo ``_PRIME``."""
    c = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(c)
    cut = np.arange(n + 1)
    whole, skipped = [], []
    for base in _BASES:
        up, down = _powers(base, n + 2), _powers(pow(base, -1, int(_PRIME)), n + 2)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(c * up[:n] % _PRIME, out=total[1:])       # below 2^31 times the length
        total %= _PRIME
        # b = word[cut:], then the terminator, then a = word[:cut] or word[:cut - 1].
        b = (total[n] + _PRIME - total[cut]) % _PRIME * down[cut] % _PRIME
        b += up[n - cut] * np.uint64(ord("$")) % _PRIME
        a = up[n - cut + 1]
        whole.append((b + total[cut] * a) % _PRIME)
        skipped.append((b[1:] + total[:n] * a[1:]) % _PRIME)
    return np.stack(whole, axis=1), np.stack(skipped, axis=1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_PRIME))) % _PRIME])
    return out[:n]


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(word)
            whole, skipped = rotation_digests(word)
            new = [True] + [x != y for x, y in zip(word, word[1:])]
            for digests, length, first in ((whole, n + 1, None), (skipped, n, new)):
                if length <= LITERAL:
                    continue
                for lo in range(0, len(digests), 1 << 16):
                    part = digests[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{length}#" + ".".join(map(str, x)) for x in part.tolist()]),
                        pa.array([key] * len(part), pa.int64()), pa.array([first is not None] * len(part)),
                        pa.array(first[lo:lo + (1 << 16)] if first else [False] * len(part))],
                        ["prefix", "id", "skips", "first"])


def near_words(found: DataFrame) -> DataFrame:
    """``id, n_near, top``: the number of near words and the first of them in
    the order of ``ranked``."""
    groups = (rotations(found).groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("id", "skips", "first")))
                                                     .alias("members")).where(F.size("members") > 1))
    groups = groups.select(
        "members", F.filter("members", lambda x: x["skips"]).alias("skipping"),
        F.filter("members", lambda x: x["first"]).alias("indels"),
        F.filter("members", lambda x: ~x["skips"]).alias("whole"))
    member = groups.select("skipping", "indels", "whole", F.explode("members").alias("m"))
    others = F.when(F.col("m.skips"), F.concat(
        F.filter("skipping", lambda x: x["id"] != F.col("m.id")),
        F.when(F.col("m.first"), F.col("whole")).otherwise(F.slice("whole", 1, 0)))).otherwise(F.col("indels"))
    near = member.select(F.col("m.id").alias("id"), others["id"].alias("others")).where(F.size("others") > 0)
    return (near.select("id", F.size("others").alias("k"), F.array_min("others").alias("top"))
            .groupBy("id").agg(F.sum("k").alias("n_near"), F.min("top").alias("top")))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for ``id, form`` (ids): forms followed to the last.  Counts
    grow tenfold with each step, so a chain has at most 19 of them; each round
    doubles the way."""
    table = shared_table(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        above = table.select(F.col("id").alias("at"), F.col("root").alias("above"))
        followed = shared_table(
            table.join(above, table.root == F.col("at"), "left")
                 .select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            "roots")
        drop_shared(table)
        if followed.where("moved").isEmpty():
            return followed.drop("moved")
        table = followed


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    found = ranked(docs)
    near = near_words(found)
    best = found.select(F.col("id").alias("top"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    form = F.col("best_n") >= TIMES * F.col("n")
    judged = shared_table(
        found.join(near, "id", "left").join(best, "top", "left")
             .select("id", "word", F.when(form, F.col("best")).alias("form"), "n",
                     F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                     F.when(form, F.col("best_n")).alias("form_n"), F.when(form, F.col("top")).alias("to")), "forms")
    root = roots(judged.where("to is not null").select("id", F.col("to").alias("form")))
    last = found.select(F.col("id").alias("end"), F.col("word").alias("last"))
    return (judged.join(root, "id", "left").join(last, F.col("root") == F.col("end"), "left")
            .select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n"))
