"""N-gram Jaccard join with Bayesian candidate pruning (operator 7).

Documents are sets of five-word shingles.  Two documents are linked when the
Jaccard likeness of their sets is 0.8 or more.

1. One pass turns every text into a key of its shingle set and a signature of
   128 MinHash values.  Documents with equal sets are one class (likeness 1).
2. Class signatures are cut into 32 bands of 4 values; classes that share a
   band are a bucket.  Of buckets with the same members one is kept.  A pair at
   likeness 0.8 shares no band with probability 5e-8.
3. Inside a bucket the MinHash values of pairs are compared 16 at a time, and a
   pair is dropped as soon as the posterior probability (uniform prior) that
   its likeness reaches the threshold is below ``TOLERANCE``.  Of the pairs that
   stay a spanning forest is kept, so chance meetings of unlike texts tie
   nothing together.  A bucket of more than ``BUCKET_ROWS`` classes is not
   compared: its classes are tied to the smallest one, which keeps all pairs.
4. The components of these ties hold every candidate pair.  A component is
   dealt into blocks of bounded shingle count, and each pair of blocks is one
   job, so a component of any size is many small jobs.  A job prunes its pairs
   in the same way and verifies the rest exactly on the shingle sets.
5. A job returns one row per class: its number of linked documents and one
   link of a spanning forest.  Pairs are never written out.

Words are runs of bytes without ASCII white space, compared as they are.  A
text of one to four words is one shingle; a text without words has no shingle,
links to nothing and is a class of its own row.

Defined cases: a null text is an empty one; texts of any length are read whole;
the nodes of the links are shingle sets, so rows that repeat or reuse a doc_id
or have none neither merge nor drop other texts: rows with equal sets are one
class and count as links of each other, whatever their doc_ids; a class or
group without any doc_id has a null ``copy_id`` or ``class_id``; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import drop_shared, map_arrow, shared_table, slices, staged
from upkeep.llm.components import connected_components, local_components
from upkeep.llm.words import U64, mix, run_hashes, word_hashes
from upkeep.session import ship_package

WORD = r"[^ \t-\r]"            # any character of a word
SHINGLE = 5
THRESHOLD = 0.8
N_HASHES = 128
BAND = 4
STEP = 16
TOLERANCE = 1e-9
BLOCK_SHINGLES = 60_000
BUCKET_ROWS = 2048              # classes of a bucket that are compared with each other
PAIRS = 1 << 20                 # pairs that are compared at once

_MULTIPLY = mix(np.arange(1, N_HASHES + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1001, 1001 + N_HASHES, dtype=U64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    runs, _, per_text = run_hashes(hashes, counts, SHINGLE)
    ends, word_ends = np.cumsum(per_text), np.cumsum(counts)
    out = []
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            out.append(np.unique(runs[ends[i] - per_text[i]:ends[i]]))
        elif n:
            own = hashes[word_ends[i] - n:word_ends[i]]
            out.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "<u8"))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    sig = np.full(N_HASHES, 0xFFFFFFFF, U64)
    for lo in range(0, len(shingles), 16384):
        part = _MULTIPLY[:, None] * shingles[None, lo:lo + 16384]
        part += _ADD[:, None]
        np.minimum(sig, part.min(axis=1) >> U64(32), out=sig)
    return sig.astype("<u4")


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [x.encode() for x in batch.column(2).to_pylist()]
        for lo, hi in slices([len(x) for x in data]):
            sets = shingle_sets(data[lo:hi])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                ["doc_id", "text_hash", "set_key", "n_shingles", "sig"])


def posterior(matches: int, compared: int, threshold: float = THRESHOLD) -> float:
    """P(likeness >= threshold) after ``matches`` of ``compared`` equal MinHash
    values: the upper tail of Beta(matches + 1, compared - matches + 1), which
    is the probability of at most ``matches`` successes in ``compared + 1``
    trials at the threshold."""
    n = compared + 1
    return sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(matches + 1))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest matches at which a pair stays."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance)
            for n in range(STEP, N_HASHES + 1, STEP)]


def pruned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray,
           least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a[i], b[j] of signature matrices that survive every step."""
    hits = np.zeros(len(i), np.int32)
    for step, need in enumerate(least):
        cols = slice(step * STEP, (step + 1) * STEP)
        for lo in range(0, len(i), 65536):
            part = slice(lo, lo + 65536)
            hits[part] += (a[i[part], cols] == b[j[part], cols]).sum(axis=1, dtype=np.int32)
        stay = hits >= need
        i, j, hits = i[stay], j[stay], hits[stay]
        if not len(i):
            break
    return i, j


def unpruned_pairs(a: np.ndarray, b: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature matrices that survive every step."""
    i, j = np.triu_indices(len(a), 1) if same else np.nonzero(np.ones((len(a), len(b)), bool))
    return pruned(a, b, i, j, least)


def overlaps(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of the sets a[i] and b[j].

    The sets of b are one sorted list of (shingle, owner); each set of a that
    is needed is matched against it once, so a dense block costs its matches
    and not a merge for each pair."""
    out = np.zeros(len(i), np.int64)
    used = np.unique(j)
    owner = np.repeat(np.arange(len(used)), [len(b[k]) for k in used])
    flat = np.concatenate([b[k] for k in used])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rank = np.searchsorted(used, j)
    by = np.argsort(i, kind="stable")
    heads = np.flatnonzero(np.r_[True, i[by][1:] != i[by][:-1]])
    for lo, hi in zip(heads, np.r_[heads[1:], len(by)]):
        rows = by[lo:hi]
        mine = a[i[rows[0]]]
        left, right = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = right - left
        if n.sum():
            at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out[rows] = np.bincount(owner[at], minlength=len(used))[rank[rows]]
    return out


def _job(group: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    """One pair of blocks: (class, documents linked, smaller class of a link)."""
    same = group["bi"].iat[0] == group["bj"].iat[0]
    first = np.flatnonzero(group["block"] == group["bi"])
    second = first if same else np.flatnonzero(group["block"] == group["bj"])
    if not len(first) or not len(second):
        return
    sig = np.stack([np.frombuffer(x, "<u4") for x in group["sig"]])
    i, j = unpruned_pairs(sig[first], sig[second], same, least_matches())
    if not len(i):
        return
    sets = shingle_sets([x.encode() for x in group["text"]])
    size = np.array([len(x) for x in sets])
    common = overlaps(i, j, [sets[k] for k in first], [sets[k] for k in second])
    i, j = first[i], second[j]
    # Exact: common / union >= 4/5.
    ok = 5 * common >= 4 * (size[i] + size[j] - common)
    i, j = i[ok], j[ok]
    docs, cid = group["n_docs"].to_numpy(), group["cid"].to_numpy()
    links = np.zeros(len(group), np.int64)
    np.add.at(links, i, docs[j])
    np.add.at(links, j, docs[i])
    label = local_components(len(group), i, j)
    for x in np.flatnonzero(links):
        yield int(cid[x]), int(links[x]), int(cid[label[x]])


def _jobs(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [r for _, g in pdf.groupby(["comp", "bi", "bj"], sort=False) for r in _job(g)]
    return pd.DataFrame(rows, columns=["cid", "links", "root"]).astype("int64")


def bucket_pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside consecutive buckets of the given sizes, about ``PAIRS`` at once."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for lo, hi in slices((sizes * (sizes - 1) // 2).tolist(), PAIRS):
        n = sizes[lo:hi]
        # The k-th row of a bucket is the first of a pair with each row behind it.
        rows = np.repeat(start[lo:hi], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        behind = np.repeat(start[lo:hi] + n, n) - rows - 1
        i = np.repeat(rows, behind)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
        yield i, j


def _ties(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forests of the pairs that the posterior leaves, bucket by bucket."""
    pdf = pdf.sort_values(["band", "cid"], ignore_index=True)
    cid, sizes = pdf["cid"].to_numpy(), pdf.groupby("band", sort=True).size().to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(-1, N_HASHES)
    least, out = least_matches(), [np.zeros((2, 0), np.int64)]
    for i, j in bucket_pairs(sizes):
        i, j = pruned(sig, sig, i, j, least)
        label = local_components(len(cid), i, j)
        own = np.flatnonzero(label != np.arange(len(cid)))
        out.append(np.stack([cid[own], cid[label[own]]]))
    u, v = np.concatenate(out, axis=1)
    return pd.DataFrame({"u": u, "v": v})


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.coalesce("text", F.lit("")).alias("text"))


def _candidates(classes: DataFrame) -> DataFrame:
    """``node, comp``: the components that hold every candidate pair of classes."""
    width = 4 * BAND
    bands = classes.select("cid", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(N_HASHES // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))))).alias("band"))
    shared = (bands.groupBy("band").agg(F.min("cid").alias("low"), F.max("cid").alias("high"))
              .where("low < high").select("band", "low"))
    met = shared_table(bands.join(shared, "band"), "bands")
    # Two sums of hashes stand for the set of members.
    buckets = (met.groupBy("band", "low").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                              F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
               .groupBy("low", "n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"))
    members = shared_table(met.join(buckets, "band"), "bucket-members")
    drop_shared(met)
    compared = members.where(F.col("n") <= BUCKET_ROWS).select("band", "cid")
    n_groups = max(64, compared.count() // (8 * BUCKET_ROWS))
    ship_package(classes.sparkSession)
    ties = (compared.join(classes.select("cid", "sig"), "cid")
            .groupBy(F.pmod(F.xxhash64("band"), F.lit(n_groups)).alias("g"))
            .applyInPandas(_ties, "u bigint, v bigint"))
    tied = members.where(F.col("n") > BUCKET_ROWS).where("cid > low").select(F.col("cid").alias("u"),
                                                                           F.col("low").alias("v"))
    found = connected_components(ties.unionByName(tied))
    drop_shared(members)
    return found


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and the classes with their group: ``key, cid,
    pick_id, pick_hash`` (a row that has the set), ``copy_id, comp, class_id,
    n_links``."""
    rows = _rows(docs)
    sigs = shared_table(map_arrow(rows, _signatures, "doc_id bigint, text_hash bigint, set_key binary, "
                                                     "n_shingles bigint, sig binary"), "signatures")
    classes = shared_table(
        sigs.where("set_key is not null").groupBy("set_key")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("pick"),
                 F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
            .select("set_key", F.col("pick.doc_id").alias("copy_id"), F.col("pick.text_hash").alias("pick_hash"),
                    "n_docs", "n_shingles", "sig", F.monotonically_increasing_id().alias("cid")), "classes")
    comps = _candidates(classes)
    members = shared_table(classes.join(comps, classes.cid == comps.node).drop("node"), "members")
    blocks = shared_table(
        members.groupBy("comp").agg(F.sum("n_shingles").alias("total"),
                                    F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("n_blocks")), "blocks")
    # One text for each class: rows that repeat doc_id and text are combined where they are read.
    # A merge join at every size: what is joined grows with the input, so it is never broadcast.
    picks = members.select("cid", F.col("copy_id").alias("pick_id"), "pick_hash").hint("merge")
    texts = (rows.join(picks, (F.col("text_hash") == F.col("pick_hash")) & F.col("doc_id").eqNullSafe(F.col("pick_id")))
             .groupBy("cid").agg(F.first("text").alias("text")))
    each = F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)
    dealt = (members.join(blocks.drop("total"), "comp")
             .withColumn("block", F.pmod(F.xxhash64("cid", "set_key"), "n_blocks"))
             .withColumn("with", F.explode(each))
             .select("comp", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"),
                     "cid", "n_docs", "sig"))
    # Several small jobs share a group; one job is two blocks of bounded size.
    verified = shared_table(
        dealt.join(texts, "cid")
             .groupBy(F.pmod(F.xxhash64("comp", "bi", "bj"), F.lit(_groups(blocks))).alias("g"))
             .applyInPandas(_jobs, "cid bigint, links bigint, root bigint"), "verified")
    linked = connected_components(verified.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    grouped = (classes.select("set_key", "cid", "copy_id", "pick_hash", "n_docs")
               .join(counts, "cid", "left").join(linked, F.col("cid") == linked.node, "left").drop("node")
               .withColumn("comp", F.coalesce("comp", "cid")))
    least = grouped.groupBy(F.col("comp").alias("of")).agg(
        F.min("copy_id").alias("class_id"),
        F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "cid")).getField("cid").alias("head"))
    named = shared_table(
        grouped.join(least, F.col("comp") == F.col("of"))
               .select(F.col("set_key").alias("key"), "cid", "head", "copy_id", "pick_hash", "class_id",
                       (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "named")
    drop_shared(classes, comps, members, blocks, verified, linked)
    return sigs, named


def join_classes(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs`` (``doc_id, text``), one row per row.

    Returns ``doc_id, class_id, copy_id, n_links``: ``class_id`` is the
    smallest doc_id of the group that links connect, ``copy_id`` the smallest
    doc_id with the same shingle set, ``n_links`` the number of other
    documents at likeness 0.8 or more.
    """
    sigs, named = _named(docs)
    with_words = (sigs.where("set_key is not null").select("doc_id", "set_key")
                      .join(named, F.col("set_key") == F.col("key"))
                      .select("doc_id", "class_id", "copy_id", "n_links"))
    without = (sigs.where("set_key is null")
                   .select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
                           F.lit(0).cast("bigint").alias("n_links")))
    return staged(with_words.unionByName(without), sigs, named)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, all columns as they
    are: the one with the smallest doc_id (a row without one only where no row
    of the group has any).  Rows without words stay."""
    sigs, named = _named(docs)
    drop_shared(sigs)
    picks = named.where("cid = head").select(F.col("cid").alias("__llm_cid"), F.col("copy_id").alias("__llm_id"),
                                             F.col("pick_hash").alias("__llm_hash"))
    found = docs.join(picks, (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__llm_hash"))
                      & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__llm_id")))
    # Rows that repeat doc_id and text are one and the same pick.
    kept = found.dropDuplicates(["__llm_cid"]).select(docs.columns)
    return staged(kept.unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))), named)


def _groups(blocks: DataFrame) -> int:
    """Number of job groups: one for each two blocks' worth of dealt shingles."""
    dealt = blocks.agg(F.sum(F.col("n_blocks") * F.col("total"))).first()[0] or 0
    return int(max(64, dealt // (2 * BLOCK_SHINGLES)))
