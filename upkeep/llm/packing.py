"""Packing by optimal length buckets (operator 4).

The unit of length (token, below) is a run of at most ``UNIT_CHARS`` characters
of one word; ideographs, kana and Hangul syllables count one each.  So a text
without spaces has a length like any other.

Documents become pieces of at most ``MAX_TOKENS`` tokens (a longer one is cut
into full pieces and a rest, so every token is in exactly one piece; with the
texts given, the pieces of a document joined in order are its text).  The
global histogram of piece lengths, which has at most ``MAX_TOKENS`` entries
whatever the input, goes to the driver; dynamic programming chooses the bucket
boundaries with the least padding over all pieces.  A batch holds pieces of one
bucket, each padded to the bucket's length, within a budget of tokens.

Batches are filled by a global numbering inside each bucket.  It is made from
``SHARDS`` hashed shards of a bucket: numbers inside a shard plus the sizes of
the shards before it, so no task holds a bucket and only the last batch of a
bucket can be short.  The shard comes from doc_id, text and piece, so many rows
without a doc_id or with the same one are spread.  The table of shard sizes has
at most buckets x SHARDS rows and is broadcast on that bound.

Defined cases: a document without tokens (null or blank text) is one row with
length 0 and null bucket, batch and slot; texts of any length are cut into
pieces; a null doc_id is kept; repeated rows are packed each for itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from upkeep.llm.common import map_arrow, shared_table, slices, staged

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16_384
SHARDS = 1024
UNIT_CHARS = 8
# Blocks of ideographs, kana and Hangul syllables.
SYLLABLES = ((0x2E80, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F))
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_starts(text: str) -> np.ndarray:
    """The places (code points) at which the tokens of ``text`` begin."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    alone = np.zeros(len(c), bool)
    if len(c) and c.max() >= SYLLABLES[0][0]:
        for low, high in SYLLABLES:
            alone |= (c >= low) & (c <= high)
    run = ~_SPACE[np.minimum(c, 32)] | (c > 32)
    run &= ~alone
    at = np.arange(len(c))
    # Where the run that a character belongs to begins.
    first = run.copy()
    first[1:] &= ~run[:-1]
    began = np.maximum.accumulate(np.where(first, at, 0)) if len(c) else at
    return np.flatnonzero(alone | (run & ((at - began) % UNIT_CHARS == 0)))


def pieces_of(text: str, starts: np.ndarray, max_tokens: int) -> list[str]:
    """The text cut before every ``max_tokens``-th token but the first; what
    stands between two tokens goes with the first of them."""
    cuts = [0, *starts[max_tokens::max_tokens].tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def best_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total
    padding; the last is the largest length.

    ``cost[j]`` after k rounds is the least padding of the lengths up to the
    j-th with k buckets; a bucket over lengths i+1..j pads each to length j.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[int(x)] for x in lengths], np.int64)
    count = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * lengths)])
    # pad[i, j]: padding when lengths i..j-1 share a bucket
    pad = (count[None, 1:] - count[:-1, None]) * lengths[None, :] - (tokens[None, 1:] - tokens[:-1, None])
    pad = np.where(np.arange(len(n))[:, None] <= np.arange(len(n))[None, :], pad, np.iinfo(np.int64).max // 4)
    cost, back = pad[0].copy(), [np.zeros(len(n), np.int64)]
    for _ in range(min(buckets, len(n)) - 1):
        before = np.concatenate([[0], cost[:-1]])
        total = before[:, None] + pad
        start = total.argmin(axis=0)
        cost = total[start, np.arange(len(n))]
        back.append(start)
    bounds, j = [], len(n) - 1
    for start in reversed(back):
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def token_counts(docs: DataFrame, keep_text: bool = False, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, doc_key, n_tokens``: a hash and the tokens of each text; with
    ``keep_text`` also ``pieces``, its texts of ``max_tokens`` tokens."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices([len(x) for x in texts]):
                part = texts[lo:hi]
                # One text for all; the line break between two ends a token.
                starts = token_starts("\n".join(part))
                ends = np.cumsum([len(x) + 1 for x in part])
                bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64())]
                if keep_text:
                    cols.append(pa.array([pieces_of(x, starts[a:b] - (end - len(x) - 1), max_tokens) for x, a, b, end in
                                          zip(part, bounds, bounds[1:], ends)], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc_key", "n_tokens", "pieces"][:len(cols)])

    return map_arrow(rows, run, "doc_id bigint, doc_key bigint, n_tokens bigint" + ", pieces array<string>" * keep_text)


def pack(lengths: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Pack documents of ``lengths`` (``doc_id, n_tokens``, and as ``token_counts``
    gives them ``doc_key`` and ``pieces`` of ``max_tokens`` tokens).

    Returns one row per piece: ``doc_id, piece, start_token, n_tokens,
    bucket_tokens, batch, slot`` and, if pieces are given, ``doc_key, text``.
    ``batch`` counts from 0 inside a bucket.
    """
    names = [c for c in ("doc_id", "doc_key", "n_tokens", "pieces") if c in lengths.columns]
    whole = shared_table(lengths.select(names), "lengths")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / max_tokens) - 1).cast("bigint")
    keyed = whole.withColumn("last", last)
    if "doc_key" not in names:
        keyed = keyed.withColumn("doc_key", F.lit(0).cast("bigint"))
    start = F.col("piece") * max_tokens
    size = F.least(F.lit(max_tokens), F.col("n_tokens") - start).cast("bigint")
    pieces = (keyed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
              .select("doc_id", "doc_key", "piece", start.alias("start_token"), size.alias("n_tokens")))
    shown = pieces
    if "pieces" in names:           # only what is returned carries texts
        shown = (keyed.select("doc_id", "doc_key", "n_tokens", F.posexplode("pieces").alias("at", "text"))
                 .withColumn("piece", F.col("at").cast("bigint"))
                 .select("doc_id", "doc_key", "piece", start.alias("start_token"), size.alias("n_tokens"), "text"))
    histogram = {r["n_tokens"]: r["count"] for r in
                 pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets)
    columns = ["doc_id", "piece", "start_token", "n_tokens", "bucket_tokens", "batch", "slot",
               *(["doc_key", "text"] if "pieces" in names else [])]
    none = F.lit(None).cast("bigint")
    blank = (shown.where("n_tokens = 0").withColumn("bucket_tokens", none).withColumn("batch", none)
             .withColumn("slot", none).select(columns))
    if not bounds:
        return staged(blank, whole)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("bigint")
    order = F.xxhash64("doc_id", "doc_key", "piece")

    def placed(rows: DataFrame) -> DataFrame:
        return (rows.where("n_tokens > 0").withColumn("bucket_tokens", bucket).withColumn("order", order)
                .withColumn("shard", F.pmod("order", F.lit(SHARDS))))

    sizes = placed(pieces).groupBy("bucket_tokens", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_tokens").orderBy("shard")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("bucket_tokens").alias("b"), F.col("shard").alias("s"), before.alias("offset"))
    inside = Window.partitionBy("bucket_tokens", "shard").orderBy("order", "doc_id", "piece")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    numbered = (placed(shown).withColumn("at", F.row_number().over(inside) - 1)
                .join(F.broadcast(offsets), (F.col("bucket_tokens") == F.col("b")) & (F.col("shard") == F.col("s")))
                .withColumn("at", F.col("at") + F.col("offset"))
                .withColumn("batch", F.floor(F.col("at") / rows).cast("bigint"))
                .withColumn("slot", F.pmod(F.col("at"), rows).cast("bigint")))
    return staged(numbered.select(columns).unionByName(blank), whole)
