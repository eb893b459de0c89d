"""Secrets by fixed rules and character Markov models (operator 5).

DataFrame functions only: nothing here runs Python on the executors.

Base spans come from three fixed patterns.  The method adds tokens that look
random: two first-order character models, one of random strings and one of
ordinary identifiers, are compared by the log-likelihood ratio of a token's
transitions.  The models are counted from labelled samples of the table
itself: values that the base patterns find in about ``SAMPLE_RANDOM``
documents, and the words of about ``SAMPLE_ORDINARY`` documents without those
values.  Only the two transition tables (at most 70 x 70 counts each) reach
the driver.

Java's regular expressions give matches but no positions.  The gaps between
the matches (the same pattern as a splitter) have the lengths that place them.

Defined cases: a null text is an empty one; a null doc_id is kept; repeated
rows are each scanned; an empty table gives an empty result; texts are never
cut; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]
# Fixed patterns.  Failing assignments still use up their text, so their
# length test comes after the match; the other two give the same matches with
# the length inside.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z_][A-Za-z0-9_]{3,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
CODES = len(ALPHABET) + 1           # code 0: any other character
SAMPLE_RANDOM = 20_000
SAMPLE_ORDINARY = 400
LEAST_TOTAL = 12.0                  # log-likelihood ratio of a whole token
LEAST_MEAN = 0.4                    # and of a transition

_SPAN = "array<struct<start:int,end:int>>"


def placed(text: Column, pattern: str, pick=None) -> Column:
    """Start and end (code points) of the matches of ``pattern`` in ``text``.

    ``pick`` maps the matches to an array of booleans of the same length; only
    true ones stay.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    spans = F.aggregate(
        sizes, start,
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["own"]).alias("end")))).alias("out")),
        lambda acc: acc["out"])
    if pick is not None:
        both = F.zip_with(spans, pick(found), lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
        spans = F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"),
                                                 x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All base spans of ``text``, kind by kind."""
    long_values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                              lambda v: F.length(v) >= ASSIGN_CHARS)
    return F.concat(_named(placed(text, ASSIGN, lambda _: long_values), "assign"),
                    _named(placed(text, ACCESS), "access"), _named(placed(text, HEX), "hex"))


def _codes(token: Column) -> Column:
    """Place in the alphabet of every character (split once, so linear time)."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c))


def _sample(docs: DataFrame, n: int, total: int) -> DataFrame:
    """About ``n`` documents by the MD5 of their doc_id, never more than twice that."""
    pick = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("bigint")
    return docs.where(pick < F.lit(float(n * (1 << 28) / max(1, total)))).limit(2 * n)


def _transitions(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of neighbouring character codes in the column ``token``."""
    codes = tokens.where(F.length("token") > 1).select(_codes(F.col("token")).alias("c"))
    pairs = codes.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("c") - 1),
        lambda i: F.element_at("c", i) * CODES + F.element_at("c", i + 1))).alias("pair"))
    return {divmod(r["pair"], CODES): r["count"] for r in pairs.groupBy("pair").count().collect()}


def _log_model(counts: dict[tuple[int, int], int]) -> list[list[float]]:
    """Log transition probabilities, each count one higher."""
    rows = [0] * CODES
    for (a, _), n in counts.items():
        rows[a] += n
    return [[math.log((counts.get((a, b), 0) + 1) / (rows[a] + CODES)) for b in range(CODES)] for a in range(CODES)]


def fit(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every transition, row by row; None if a sample is empty."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    text = F.col("text")
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_CHARS),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    random = _transitions(_sample(docs, SAMPLE_RANDOM, total).select(F.explode(values).alias("token")))
    plain = text
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    ordinary = _transitions(_sample(docs, SAMPLE_ORDINARY, total).select(
        F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("token")))
    if not random or not ordinary:
        return None
    a, b = _log_model(random), _log_model(ordinary)
    return [x - y for r, s in zip(a, b) for x, y in zip(r, s)]


def _random_looking(token: Column, ratio: Column) -> Column:
    """Whether a token's log-likelihood ratio says that it is random."""
    codes = _codes(token)
    steps = F.length(token) - 1
    total = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
                        lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(
                            acc["sum"] + F.get(ratio, acc["last"] * CODES + c)).alias("sum")),
                        lambda acc: acc["sum"])
    return token.rlike("[A-Za-z]") & (total >= F.greatest(F.lit(LEAST_TOTAL), F.lit(LEAST_MEAN) * steps))


def find_secrets(docs: DataFrame, ratio: list[float] | None = None) -> DataFrame:
    """``doc_id, base, added``: arrays of (kind, start, end) in code points, end
    exclusive, for every row of ``docs`` (``doc_id, text``); added spans do not
    overlap base ones."""
    ratio = ratio or fit(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, spans = F.col("text"), "array<struct<kind:string,start:int,end:int>>"
    rows = rows.select("doc_id", "text", base_spans(text).cast(spans).alias("base"))
    if ratio is None:
        return rows.select("doc_id", "base", F.array().cast(spans).alias("added"))
    # One literal array, folded once: the model is part of the plan.
    model = F.split(F.lit(" ".join(map(repr, ratio))), " ").cast("array<double>")
    looks = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda t: _random_looking(t, model))
    rows = rows.withColumn("looks", F.when(text.rlike(CANDIDATE), looks).otherwise(F.array().cast("array<boolean>")))
    some = F.exists("looks", lambda x: x)
    far = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    added = F.filter(placed(text, CANDIDATE, lambda _: F.col("looks")), far)
    return rows.select("doc_id", "base", F.when(some, _named(added, "markov")).otherwise(F.array().cast(spans))
                       .cast(spans).alias("added"))
