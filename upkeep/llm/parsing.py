"""Document fingerprints by locally consistent parsing (operator 8).

A text is a sequence of code points.  Deterministic coin tossing gives every
symbol a small label from the lowest bit in which it differs from its left
neighbour (repeated three times, so labels are below 8 and neighbours differ);
a symbol whose label is a local maximum starts a phrase.  Phrases are named by
a hash of their symbols, and the names are the symbols of the next level.  The
place of a phrase start depends on a few neighbours only, so equal substrings
are cut alike away from their ends, whatever stands before them.

A fingerprint is the ``SKETCH`` smallest ranks of a text's phrase names of all
levels, written in hexadecimal, sorted.  The rank of a name is its hash divided
by the weight of its level, 8 times that of the level below: a phrase counts
for about the text it spans, so a long text is sketched by its highest phrases
and a short one by all that it has, with one rule for every length.  The
likeness of two fingerprints is the usual bottom-k estimate of the (weighted)
Jaccard likeness of the name sets: of the smallest ranks of the union, the
share that is in both.  Two empty fingerprints have likeness 1, an empty and
another one 0.

Defined cases: a null text is an empty one; null doc_ids come first in the
order; rows with the same doc_id are ordered by a hash of the text, and dealt
by ranges of that hash where they are many (rows that repeat doc_id and text
stay in one part); a single row is its own next document; repeated rows are
each returned; an empty table gives an empty result; texts are never cut; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import map_arrow, slices
from upkeep.llm.words import U64, mix
from upkeep.session import ship_package

SKETCH = 48
LEVELS = 3
WEIGHT_BITS = 3                 # a level weighs 2^3 times the level below
RANK_BYTES = 5
SLICE_CHARS = 1 << 19
ROWS_PER_PART = 2000
MOST_PARTS = 16_384

_RADIX = np.cumprod(np.concatenate([[U64(1)], np.full(63, U64(0xA0761D6478BD642F))]))


def _table(bits: int) -> np.ndarray:
    """Next label for every pair (label, left label) of ``bits`` bits."""
    x, left = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    differ = x ^ left
    low = np.zeros_like(differ)
    for b in range(bits - 1, -1, -1):
        low[(differ >> b) & 1 == 1] = b
    return (2 * low + ((x >> low) & 1)).astype(np.uint8).ravel()


_SECOND, _THIRD = _table(7), _table(4)


def labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols ``x``; ``first`` marks the first of each text.
    Neighbours in a text must differ; their labels do, too."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ U64(1)
    differ = x ^ left
    low = differ & (~differ + U64(1))
    bit = (low.astype(np.float64).view(np.int64) >> 52) - 1023
    label = (2 * bit + ((x & low) != 0)).astype(np.uint8)
    for table, bits in ((_SECOND, 7), (_THIRD, 4)):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = table[(label.astype(np.int16) << bits) | left]
    return label


def next_level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of symbols ``x`` and the phrases that are first in their text."""
    # A run of one symbol becomes one symbol, so that neighbours differ.
    start = np.ones(len(x), bool)
    start[1:] = x[1:] != x[:-1]
    start[first] = True
    if not start.all():
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(x))).astype(U64)
        first = np.cumsum(start)[first] - 1
        x = np.where(length > 1, mix(x[at] * U64(0x9E3779B97F4A7C15) + length), x[at])
    label = labels(x, first)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[(first - 1)[first > 0]] = False        # the last of a text has no right neighbour
    peak[first] = True
    at = np.flatnonzero(peak)
    offset = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    names = mix(np.add.reduceat(mix(x) * _RADIX[offset & 63], at))
    return names, np.searchsorted(at, first)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct ranks, ``SKETCH`` at most, of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    ends = np.cumsum(size)
    owner = np.flatnonzero(size > 0)
    first = (ends - size)[owner]
    levels = []
    for level in range(LEVELS if len(x) else 0):
        x, first = next_level(x, first)
        rank = mix(x) >> U64(64 - 8 * RANK_BYTES + WEIGHT_BITS * level)
        levels.append((rank, np.append(first, len(x))))
    out = [np.zeros(0, U64)] * len(texts)
    for i, text in enumerate(owner):
        out[text] = np.unique(np.concatenate([h[f[i]:f[i + 1]] for h, f in levels]))[:SKETCH]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    rank = np.arange(1, len(both)) - np.cumsum(twice)       # distinct values up to each repeated one, less one
    n = min(SKETCH, len(both) - int(twice.sum()))
    return float((twice & (rank < n)).sum() / n)


def written(sketch: np.ndarray) -> str:
    return "".join(f"{x:0{2 * RANK_BYTES}x}" for x in sketch.tolist())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def part_bounds(quantiles: list[float], null_parts: int) -> list[tuple[int | None, int]]:
    """The least (doc_id, key) of each part but the first, in order.  A doc_id
    that is several quantiles (and a null one of several parts) is cut by
    equal ranges of the key."""
    least, out = -1 << 63, []
    out += [(None, least + (j << 64) // null_parts) for j in range(1, null_parts)]
    for value, times in sorted(Counter(int(q) for q in quantiles).items()):
        out += [(value, least + (j << 64) // times) for j in range(times)]
    return out


def part_numbers(ids: np.ndarray, none: np.ndarray, mine: np.ndarray,
                 bounds: list[tuple[int | None, int]]) -> np.ndarray:
    """For each row (doc_id, whether it is null, key), the number of bounds not
    above it, nulls first."""
    nulls = np.array([k for i, k in bounds if i is None], np.int64)
    known = [(i, k) for i, k in bounds if i is not None]
    at, key = np.array([i for i, _ in known], np.int64), np.array([k for _, k in known], np.int64)
    here = ~none
    out = np.searchsorted(nulls, mine, side="right").astype(np.int32)
    values = ids[here]
    low, high = np.searchsorted(at, values, side="left"), np.searchsorted(at, values, side="right")
    number = low.copy()
    for value in np.unique(values[high > low]):
        rows = values == value
        lo, hi = np.searchsorted(at, value, side="left"), np.searchsorted(at, value, side="right")
        number[rows] = lo + np.searchsorted(key[lo:hi], mine[here][rows], side="right")
    out[here] = len(nulls) + number
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """``part, doc_id, key, last, text``: the rows dealt by ranges of (doc_id,
    key) into parts and sorted; after the rows of a part stands one more,
    ``last``, that repeats the first row of the next part (of the first one
    after the last).

    Texts are shuffled once.  The driver gets the ranges and the first key of
    each part, ``MOST_PARTS`` at most.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, n_ids = rows.agg(F.count("*"), F.count("doc_id")).first()
    parts = int(min(MOST_PARTS, max(1, n // ROWS_PER_PART)))
    quantiles = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = part_bounds(quantiles, parts * (n - n_ids) // max(n, 1))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, none: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(part_numbers(ids.to_numpy(), none.to_numpy(), keys.to_numpy(), bounds))

    keyed = (rows.withColumn("key", F.xxhash64("text"))
             .withColumn("part", part_of(F.coalesce("doc_id", F.lit(0).cast("bigint")), F.col("doc_id").isNull(), "key"))
             .withColumn("last", F.lit(False)))
    heads = sorted(((r["part"], r["m"]["doc_id"], r["m"]["key"]) for r in
                    keyed.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("m")).collect()),
                   key=lambda r: r[0])
    columns = ["part", "doc_id", "key", "last", "text"]
    if not heads:
        return keyed.select(columns)
    before = [(heads[i - 1][0], doc, key) for i, (_, doc, key) in enumerate(heads)]
    ends = spark.createDataFrame(before, "to_part int, head_id bigint, head_key bigint")
    # At most MOST_PARTS narrow rows are broadcast.
    tails = (keyed.join(F.broadcast(ends), keyed.doc_id.eqNullSafe(ends.head_id) & (keyed.key == ends.head_key))
             .dropDuplicates(["to_part"])
             .select(F.col("to_part").alias("part"), "doc_id", "key", F.lit(True).alias("last"), "text"))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (keyed.select(columns).unionByName(tails).repartition(max(n_tasks, len(heads)), "part")
            .sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row of ``docs`` (``doc_id, text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in slices([len(x) for x in texts], SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array([written(s) for s in sketches(texts[lo:hi])], pa.string())],
                    ["doc_id", "fingerprint"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint string")


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to
    each other and to the next document's (ascending doc_id, then the first)."""
    def emit(ids: list, texts: list[str], follow: list[str], own: list[np.ndarray], nxt: list[np.ndarray]):
        changed = [edited(t, f) for t, f in zip(texts, follow)]
        new = sketches(changed)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([written(s) for s in own], pa.string()), pa.array([written(s) for s in new], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nxt)], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                 # the last row so far: part, doc_id, last, text, sketch
        for batch in batches:
            part, ids, last, text = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for lo, hi in slices([len(x) for x in text], SLICE_CHARS):
                rows = list(zip(part[lo:hi], ids[lo:hi], last[lo:hi], text[lo:hi], sketches(text[lo:hi])))
                rows = rows if held is None else [held, *rows]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]
                held = rows[-1]
                if pairs:
                    yield emit([a[1] for a, _ in pairs], [a[3] for a, _ in pairs], [b[3] for _, b in pairs],
                               [a[4] for a, _ in pairs], [b[4] for _, b in pairs])

    return map_arrow(in_order(docs), run, _OUT)
