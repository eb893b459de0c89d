"""Embedding near-dedup by randomised-rotation binary codes (operator 12).

Vectors with the same label are linked when their cosine is 0.93 or more.

1. Equal vectors of a label are one class.  Each class vector is made a unit
   vector ``o`` and turned by a pseudo-random rotation (three rounds of random
   signs and a Walsh-Hadamard transform).  Its code is the signs of the turned
   entries, that is, the corner ``c`` of the cube nearest to it; its correction
   factor is ``a = <c, o>``.  Both are stored.
2. For another unit vector ``q``, ``<c, q> / a`` estimates ``<o, q>`` without
   bias over rotations.  Its error is ``<e, q> sqrt(1 - a^2) / a`` for a unit
   vector ``e`` at right angles to ``o``, which is spread like one entry of a
   random vector.  The bound is taken at the full width ``sqrt(1 - t^2)`` that
   ``<e, q>`` can have for a pair at the threshold t, so it holds with
   certainty: a pair whose estimate lies below ``t - sqrt(1 - t^2)
   sqrt(1 - a^2) / a`` has no link, and unrelated pairs nearly all lie there.
3. What the bound leaves open is recomputed exactly, in double precision.

The classes of a label are dealt into blocks of bounded size by hash, and a
pair of blocks is one job; so a hot label is many even jobs, and a pair of
vectors meets in one.  A job returns one row per class: the number of its
linked vectors and one link of a spanning forest.  Pairs are never written.
Every pair of classes with one label is compared as codes, so work grows with
the square of a label's distinct vectors; a class is sent once to each block
of its label.

Defined cases: a vector that is null, empty or zero, or holds null or
non-finite entries, and a vector with a null label, links with nothing and is
a component of its own row; vectors of different lengths do not link; rows
that repeat a vec_id stay rows of their own, linked by their vectors; a
component without any vec_id has a null component_id, and a row is kept when
its vec_id equals that (two nulls included); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import drop_shared, map_arrow, shared_table
from upkeep.llm.components import connected_components, local_components
from upkeep.session import ship_package

THRESHOLD = 0.93
BLOCK_ENTRIES = 1 << 18         # entries (rows x dimensions) of a block
TILE = 512                      # rows of a block that are compared at once
SLACK = 1e-4                    # for single precision in the estimates


def block_rows(d: int) -> int:
    return max(64, BLOCK_ENTRIES // d)


def _signs(d: int, size: int) -> np.ndarray:
    return np.where(np.random.default_rng(12_000 + d).random((3, size)) < 0.5, -1.0, 1.0)


def rotated(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` turned by the rotation of their length (padded with
    zeros to a power of two); the same on every machine."""
    n, d = x.shape
    size = 1 << (d - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :d] = x
    for signs in _signs(d, size):
        out *= signs
        step = 1
        while step < size:
            pair = out.reshape(n, size // (2 * step), 2, step)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        out /= np.sqrt(size)
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; rows are scaled by a power of two first, so that no square
    overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -power[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit rows, and their correction factors."""
    turned = rotated(u)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def corners(packed: np.ndarray, d: int) -> np.ndarray:
    """The cube corners (unit vectors) that packed codes of ``d`` entries stand for."""
    size = 1 << (d - 1).bit_length()
    bits = np.unpackbits(packed, axis=1, count=size).astype(np.float32)
    return (2 * bits - 1) / np.float32(np.sqrt(size))


def open_from(factor: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The least ``<c, q>`` (the estimate times the factor) of a pair that may
    reach the threshold."""
    return threshold * factor - np.sqrt((1 - threshold ** 2) * np.maximum(0.0, 1 - factor ** 2)) - SLACK


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id, label, embedding`` -> ``vec_id, key, label, d, vec``; the key,
    which names label and vector, is null where the row can link with nothing."""
    for batch in batches:
        column = batch.column(2)
        lengths = np.array(column.value_lengths().fill_null(0), np.int64)
        flat = column.flatten()
        flat = (flat if pa.types.is_float32(flat.type) else flat.cast(pa.float64())).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        labels = batch.column(1).to_pylist()
        key, vec = [None] * len(batch), [None] * len(batch)
        for d in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == d)
            matrix = flat[(ends[rows] - d)[:, None] + np.arange(d)]
            fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            for row, data in zip(rows[fine].tolist(), matrix[fine] + matrix.dtype.type(0)):   # -0 becomes 0
                if labels[row] is not None:
                    vec[row] = data.tobytes()
                    key[row] = hashlib.blake2b(f"{d}:{labels[row]}:".encode() + vec[row], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(key, pa.binary()), batch.column(1),
             pa.array(lengths, pa.int32()), pa.array(vec, pa.binary())], ["vec_id", "key", "label", "d", "vec"])


def _matrix(vecs: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f4" if len(vecs[0]) == 4 * d else "<f8").reshape(-1, d).astype(float)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``code`` and ``factor`` to class rows (last columns ``d, vec``)."""
    for batch in batches:
        d, vec = np.array(batch.column(4)), batch.column(5).to_pylist()
        code, factor = [b""] * len(vec), np.zeros(len(vec))
        for length in np.unique(d).tolist():
            rows = np.flatnonzero(d == length)
            for lo in range(0, len(rows), 2048):
                part = rows[lo:lo + 2048]
                packed, factor[part] = codes(units(_matrix([vec[i] for i in part], length)))
                for i, c in zip(part.tolist(), packed):
                    code[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor)],
                                         [*batch.schema.names, "code", "factor"])


def linked_pairs(u: np.ndarray, corner: np.ndarray, least: np.ndarray, v: np.ndarray, turned: np.ndarray,
                 triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= THRESHOLD between unit rows ``u`` (given
    their codes' corners and least products) and ``v`` (given turned).  With
    ``triangle`` both are one block and each pair comes once."""
    for lo in range(0, len(u), TILE):
        start = lo if triangle else 0
        product = corner[lo:lo + TILE] @ turned[start:].T
        i, j = np.nonzero(product >= least[lo:lo + TILE, None])
        i, j = i + lo, j + start
        if triangle:
            i, j = i[i < j], j[i < j]
        if len(i) * 8 > product.size:              # dense: all at once
            near = u[lo:lo + TILE] @ v[start:].T >= THRESHOLD
            stay = near[i - lo, j - start]
        else:
            stay = np.concatenate([np.zeros(0, bool)] + [
                np.einsum("ij,ij->i", u[i[k:k + 8192]], v[j[k:k + 8192]]) >= THRESHOLD
                for k in range(0, len(i), 8192)])
        yield i[stay], j[stay]


def _job(group: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks: ``cid``, vectors linked, a class of its tree."""
    same = group["bi"].iat[0] == group["bj"].iat[0]
    first = np.flatnonzero(group["block"] == group["bi"])
    second = first if same else np.flatnonzero(group["block"] == group["bj"])
    none = pd.DataFrame({"cid": [], "links": [], "root": []}, dtype="int64")
    if not len(first) or not len(second):
        return none
    d, vecs = int(group["d"].iat[0]), group["vec"].tolist()
    u = units(_matrix(vecs, d))
    packed = np.frombuffer(b"".join(group["code"].iat[i] for i in first), np.uint8).reshape(len(first), -1)
    corner = corners(packed, d)
    least = open_from(group["factor"].to_numpy()[first]).astype(np.float32)
    v = u[second]
    weight = group["n_rows"].to_numpy()
    links = np.zeros(len(group), np.int64)
    tree = [np.zeros((2, 0), np.int64)]
    for i, j in linked_pairs(u[first], corner, least, v, rotated(v).astype(np.float32), same):
        i, j = first[i], second[j]
        links += np.bincount(i, weight[j], len(group)).astype(np.int64)
        links += np.bincount(j, weight[i], len(group)).astype(np.int64)
        label = local_components(len(group), i, j)
        own = np.flatnonzero(label != np.arange(len(group)))
        tree.append(np.stack([own, label[own]]))
    i, j = np.concatenate(tree, axis=1)
    label, hit = local_components(len(group), i, j), np.flatnonzero(links)
    cid = group["cid"].to_numpy()
    return pd.DataFrame({"cid": cid[hit], "links": links[hit], "root": cid[label[hit]]})


def near_duplicates(table: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table``
    (``vec_id, embedding, label``)."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        "embedding")
    encoded = shared_table(map_arrow(rows, _encoded, "vec_id bigint, key binary, label string, d int, vec binary"),
                           "vectors")
    usable = encoded.where("key is not null")
    # Copies are combined before the shuffle; a class is one row from here on.
    groups = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n_rows"),
                                       F.first("label").alias("label"), F.first("d").alias("d"),
                                       F.first("vec").alias("vec"))
    classes = shared_table(
        map_arrow(groups, _coded, "key binary, rep bigint, n_rows bigint, label string, d int, vec binary, "
                                  "code binary, factor double")
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    size = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_ENTRIES) / F.col("d")))
    blocks = (classes.groupBy("label", "d").agg(F.count("*").alias("n"))
              .select("label", "d", F.ceil(F.col("n") / size).alias("n_blocks")))
    dealt = (classes.drop("rep", "key").join(blocks, ["label", "d"])
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")))
             .withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
             .withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
             .drop("with", "n_blocks"))
    ship_package(spark)
    verified = shared_table(
        dealt.groupBy("label", "d", "bi", "bj").applyInPandas(_job, "cid bigint, links bigint, root bigint"),
        "vector-links")
    linked = connected_components(verified.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    of = (classes.select("cid", "key", "rep", "n_rows")
          .join(linked, F.col("cid") == linked.node, "left").drop("node")
          .withColumn("comp", F.coalesce("comp", "cid")))
    least = of.groupBy(F.col("comp").alias("tree")).agg(F.min("rep").alias("component_id"))
    named = shared_table(
        of.join(least, of.comp == F.col("tree")).join(counts, "cid", "left")
          .select(F.col("key").alias("named"), "component_id",
                  (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links")), "vector-names")
    drop_shared(classes, verified, linked)
    joined = (encoded.select("vec_id", "key").join(named, F.col("key") == F.col("named"), "left")
              .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(F.col("named").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
                      .alias("component_id")))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
