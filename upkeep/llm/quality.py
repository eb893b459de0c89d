"""Quality rules with cross-document line frequency (operator 9).

Text rules come from each text alone.  The method's verdict comes from all
documents of a host (the ``source`` column): every line is normalised and
hashed, the distinct documents that hold it are counted per host, lines above
the host's limit are removed, and a document that loses too many of its words
is rejected.

What counts as one document.  A line that recurs because its whole document
was copied is not boilerplate, so a holder of a line is identified by its whole
text: exact copies count once, in the number of holders and in the number of
texts of the host alike.  An edited copy is a document of its own.

The limit of a host is ``max(min_docs, share * distinct texts of the host)``.
A line above it is removed everywhere but in its first holder (the text with
the smallest doc_id; texts without one come last, by their hash): what many
documents repeat is kept once, so of a group of edited copies one stays whole,
and so does one of many pages that consist of nothing but a host's notices.

Defined cases: a null text is an empty one (no words, fails the base rule);
texts and lines of any length are read whole; a null source is a host of its
own; a null doc_id is kept; repeated rows are judged alike and each is
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import SLICE_BYTES, map_arrow, shared_table, slices, staged
from upkeep.llm.words import run_hashes, word_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 10
SHARE = 0.05
MIN_LEFT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
NO_SOURCE = "\0none"     # stands for a null source

_LINES = "array<struct<line:bigint,words:int>>"
_RULES = ("doc_id bigint, source string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
          f"n_dup_lines bigint, n_repeat_words bigint, lines {_LINES}")


def _key(data: bytes) -> int:
    return struct.unpack("<q", hashlib.blake2b(data, digest_size=8).digest())[0]


def normalise(line: bytes) -> bytes:
    """Lower case, white space runs as one space, trimmed."""
    return b" ".join(line.decode().lower().encode().split())


def line_entries(data: bytes) -> list[dict]:
    """The distinct normalised lines with words: hash, and words over all
    their occurrences."""
    words: dict[bytes, int] = {}
    for line in data.split(b"\n"):
        if norm := normalise(line):
            words[norm] = words.get(norm, 0) + norm.count(b" ") + 1
    return [{"line": _key(x), "words": n} for x, n in words.items()]


def repeated_words(hashes: np.ndarray, counts: np.ndarray, n: int = WINDOW) -> list[int]:
    """For each text, the words that lie in some run of ``n`` words that occurs
    twice or more in that text."""
    runs, first, per_text = run_hashes(hashes, counts, n)
    if not len(runs):
        return [0] * len(counts)
    text = np.repeat(np.arange(len(counts)), per_text)
    order = np.lexsort((runs, text))
    r, t = runs[order], text[order]
    same = (r[1:] == r[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(r), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(hashes) + 1, np.int64)
    at = first[order[twice]]
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(covered[ends]).tolist()


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, keys = batch.column(0), batch.column(1), batch.column(3)
        texts = [x or "" for x in batch.column(2).to_pylist()]
        data = [x.encode() for x in texts]
        for lo, hi in slices([len(x) for x in data], SLICE_BYTES):
            hashes, counts = word_hashes(data[lo:hi])
            cols: dict[str, list] = {k: [] for k in ("chars", "symbols", "dups", "lines")}
            for text, raw in zip(texts[lo:hi], data[lo:hi]):
                cols["chars"].append(len(text) - sum(text.count(c) for c in WHITE))
                cols["symbols"].append(sum(text.count(c) for c in SYMBOLS))
                full = [x for x in raw.split(b"\n") if x.strip()]
                cols["dups"].append(len(full) - len(set(full)))
                cols["lines"].append(line_entries(raw))
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo).cast(pa.int64()), sources.slice(lo, hi - lo).cast(pa.string()),
                keys.slice(lo, hi - lo), pa.array(counts, pa.int64()),
                pa.array(cols["chars"], pa.int64()), pa.array(cols["symbols"], pa.int64()),
                pa.array(cols["dups"], pa.int64()),
                pa.array(repeated_words(hashes, counts), pa.int64()),
                pa.array(cols["lines"], pa.list_(pa.struct(
                    [("line", pa.int64()), ("words", pa.int32())])))],
                ["doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "lines"])


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE,
            min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Rule figures and verdict of every row of ``docs`` (``doc_id, source, text``).

    Returns ``doc_id, source, text_key`` (a 64-bit hash of the text), ``n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    base_failed, kept``, one row per row.
    The figures and line hashes of each text are made in one pass and staged
    (hashes only, no text).  Counting groups by (host, line, text) first, so
    a line in a third of all documents is combined before each shuffle; the
    removed lines are matched to documents by a join that adaptive execution
    broadcasts or splits by measured size.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"),
                        "text", text_key().alias("text_key"))
    rows = shared_table(map_arrow(texts, _rules, _RULES).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = (rows.select("row", "doc_id", "source", "text_key", F.explode("lines").alias("x"))
                 .select("row", "doc_id", "source", "text_key", "x.*"))
    hosts = (rows.select("source", "text_key").distinct().groupBy("source")
                 .agg(F.count("*").alias("n_texts")))
    frequent = (lines.groupBy("source", "line", "text_key").agg(F.min("doc_id").alias("doc_id"))
                     .groupBy("source", "line")
                     .agg(F.count("*").alias("n_docs"),
                          F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
                     .where(F.col("n_docs") > min_docs)
                     .join(hosts, "source")
                     .where(F.col("n_docs") > share * F.col("n_texts"))
                     .select("source", "line", F.col("first.text_key").alias("first_key")))
    frequent = shared_table(frequent, "lines")
    removed = (lines.join(frequent, ["source", "line"])
                    .where("text_key <> first_key")
                    .groupBy("row").agg(F.sum("words").alias("removed_words")))
    left = F.col("n_words") - F.col("removed_words")
    judged = (rows.drop("lines").join(removed, "row", "left")
                .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("bigint"))
                .withColumn("base_failed", base_failed())
                .withColumn("kept", ~F.col("base_failed")
                            & (100 * left >= min_left_percent * F.col("n_words")))
                .select("doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "removed_words", "base_failed", "kept"))
    return staged(judged, rows, frequent)


def accepted(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose verdict is kept."""
    judged = quality(docs, **limits)
    kept = (judged.where("kept")
            .select(F.col("doc_id").alias("__llm_id"), F.col("source").alias("__llm_source"),
                    F.col("text_key").alias("__llm_key")).distinct())
    same = (F.col("doc_id").cast("bigint").eqNullSafe(F.col("__llm_id"))
            & (F.coalesce("source", F.lit(NO_SOURCE)) == F.col("__llm_source"))
            & (text_key() == F.col("__llm_key")))
    return staged(docs.join(kept, same, "left_semi"), judged)
