"""Embedding whitening (operator 11).

Entries become whole numbers ``x = floor(64 c) + 1000000``; the statistics are
taken over the fit list, which holds each distinct vector once, in whole
numbers and so without rounding: the sums first, then the products of entries
centred at the rounded mean (the rest of the mean is taken off the products
exactly).  The leading components of the covariance come from ``feast``.  A
last pass measures the covariance of the whitened fit list, and every row is
projected where it lies; the only shuffle is the one that makes vectors
distinct, on packed bytes (one byte an entry for entries within +-2), and
repeated vectors are combined before it.

Only numbers of the size of the vectors' dimensions meet on the driver: sums,
products (half a square of the dimensions) and components.

Defined cases: rows whose vector is null or holds null or non-finite entries
go, as do empty vectors (no component); vectors of another length are a space
of their own, with its own fit list; entries of magnitude above 2^56 saturate;
components whose eigenvalue is not above rounding level are left out, so a
space with one distinct vector gives no rows; a deviation that no long holds
is null; repeated rows and repeated or null vec_ids are rows like any other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import drop_shared, map_arrow, shared_table
from upkeep.llm.feast import leading_pairs

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
ROWS = 4096                     # rows of one numpy step
_MOST = 1 << 62
_WIDTHS = (1, 2, 4, 8)
OUTPUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double")


@dataclass(frozen=True)
class Fit:
    """What is fitted to the vectors of one length."""
    n: int
    centre: np.ndarray          # the rounded mean of x - OFFSET
    rest: np.ndarray            # S - n * (centre + OFFSET), exact
    axes: np.ndarray            # unit components as columns
    values: np.ndarray          # their eigenvalues
    trace: float


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of the finite vectors, by their length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)      # a null entry becomes nan
    ends = np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        matrix = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield rows[fine], matrix[fine]


def whole(matrix: np.ndarray) -> np.ndarray:
    """x - OFFSET of every entry."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * matrix), -_MOST, _MOST).astype(np.int64)


def pack(y: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it (one way for one row)."""
    out: list[bytes] = [b""] * len(y)
    most = np.maximum(y.max(axis=1), -(y.min(axis=1) + 1))
    width = np.searchsorted([1 << (8 * w - 1) for w in _WIDTHS[:-1]], most, side="right")
    for k in np.unique(width):
        rows = np.flatnonzero(width == k)
        data, step = y[rows].astype(f"<i{_WIDTHS[k]}").tobytes(), _WIDTHS[k] * y.shape[1]
        for i, row in enumerate(rows.tolist()):
            out[row] = data[i * step:(i + 1) * step]
    return out


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, matrix of x - OFFSET) of a batch of ``d, packed``."""
    lengths = np.array(batch.column(0))
    data = batch.column(1).to_pylist()
    width = np.array([len(x) for x in data], np.int64) // np.maximum(lengths, 1)
    for d in np.unique(lengths).tolist():
        for w in np.unique(width[lengths == d]).tolist():
            rows = np.flatnonzero((lengths == d) & (width == w))
            for lo in range(0, len(rows), ROWS):
                part = rows[lo:lo + ROWS].tolist()
                yield d, np.frombuffer(b"".join(data[i] for i in part), f"<i{w}").reshape(-1, d).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, matrix in by_length(batch.column(0)):
            rows = pack(whole(matrix))
            yield pa.RecordBatch.from_arrays(
                [pa.array([matrix.shape[1]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["d", "packed"])


def _moments(d: int, at: list[tuple[int, int]], values: list) -> pa.RecordBatch:
    i, j = (np.array([x[k] for x in at], np.int32) for k in (0, 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), d, np.int32)), pa.array(i), pa.array(j), pa.array([str(v) for v in values])],
        ["d", "i", "j", "value"])


_MOMENTS = "d int, i int, j int, value string"


def exact_sums(y: np.ndarray) -> list[int]:
    most = int(max(abs(int(y.max())), abs(int(y.min()))))
    return (y if most * len(y) < _MOST else y.astype(object)).sum(axis=0).tolist()


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers; doubles hold it exactly up to 2^53."""
    most = int(max(abs(int(y.max())), abs(int(y.min()))))
    if most * most * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    whole_numbers = y.astype(object)
    return whole_numbers.T @ whole_numbers


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length: the number of vectors (at -1) and the sum of each entry."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        for d, y in unpacked(batch):
            part = [len(y), *exact_sums(y)]
            total[d] = [a + b for a, b in zip(total[d], part)] if d in total else part
    for d, values in total.items():
        yield _moments(d, [(i - 1, 0) for i in range(len(values))], values)


def _products(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, y in unpacked(batch):
                part = exact_products(y - centres[d]).astype(object)
                total[d] = total[d] + part if d in total else part
        for d, g in total.items():
            i, j = np.triu_indices(d)
            yield _moments(d, list(zip(i.tolist(), j.tolist())), g[i, j].tolist())
    return run


def projections(y: np.ndarray, fit: Fit) -> np.ndarray:
    """The whitened components of rows ``x - OFFSET``."""
    return ((y - fit.centre) - (fit.rest / fit.n).astype(float)) @ (fit.axes / np.sqrt(fit.values))


def deviations(y: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = max(int(np.abs(y - fit.centre).max()) * fit.n + max(abs(int(r)) for r in fit.rest), 1)
    y = y - fit.centre
    if most * most * y.shape[1] < _MOST:
        return ((y * fit.n - fit.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((y.astype(object) * fit.n - fit.rest) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def _whitened_moments(fits: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, y in unpacked(batch):
                if d in fits:
                    z = projections(y, fits[d])
                    part = np.vstack([z.sum(axis=0), z.T @ z])
                    total[d] = total[d] + part if d in total else part
        for d, g in total.items():
            at = [(i, j) for i in range(g.shape[0]) for j in range(g.shape[1])]
            yield _moments(d, [(i - 1, j) for i, j in at], [repr(float(g[x])) for x in at])
    return run


def _rows(fits: dict[int, Fit], errors: dict[int, float]):
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, matrix in by_length(batch.column(1)):
                d = matrix.shape[1]
                if d not in fits:
                    continue
                fit, y = fits[d], whole(matrix)
                k, n = len(fit.values), len(rows)
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, fit.n, np.int64)),
                    pa.array(deviations(y, fit), pa.int64()).take(pa.array(each)),
                    pa.array(projections(y, fit).ravel()),
                    pa.array(np.tile(fit.values / fit.trace, n)),
                    pa.array(np.full(n * k, errors[d]))], names)
    return run


def _gathered(parts: DataFrame, kind: str) -> dict[int, dict[tuple[int, int], object]]:
    out: dict[int, dict[tuple[int, int], object]] = {}
    total = parts.groupBy("d", "i", "j").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    for d, i, j, value in total.toLocalIterator():
        out.setdefault(d, {})[i, j] = value
    return out


def fit_components(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Fit], dict[int, float]]:
    """Fits of the distinct vectors by their length, and the largest entry of
    the whitened covariance minus the identity, measured on the fit list."""
    fit_list = shared_table(map_arrow(vectors, _packed, "d int, packed binary").distinct(), "whitening-fit")
    sums = _gathered(map_arrow(fit_list, _sums, _MOMENTS), "decimal(38,0)")
    counts = {d: int(s[-1, 0]) for d, s in sums.items()}
    sums = {d: [int(s[i, 0]) for i in range(d)] for d, s in sums.items()}
    centres = {d: np.array([(2 * s + counts[d]) // (2 * counts[d]) for s in sums[d]], np.int64) for d in sums}
    products = _gathered(map_arrow(fit_list, _products(centres), _MOMENTS), "decimal(38,0)")
    fits = {}
    for d, n in counts.items():
        rest = [s - n * int(c) for s, c in zip(sums[d], centres[d])]
        v = np.zeros((d, d))
        for (i, j), g in products[d].items():
            v[i, j] = v[j, i] = (n * int(g) - rest[i] * rest[j]) / (n * n)
        values, axes = leading_pairs(v, components)
        if len(values):
            trace = (sum(n * int(products[d][i, i]) - rest[i] ** 2 for i in range(d))) / (n * n)
            fits[d] = Fit(n, centres[d], np.array(rest, object), axes, values, trace)
    errors = {}
    for d, m in (_gathered(map_arrow(fit_list, _whitened_moments(fits), _MOMENTS), "double") if fits else {}).items():
        k, n = len(fits[d].values), fits[d].n
        mean = np.array([m[-1, j] for j in range(k)]) / n
        spread = np.array([[m[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
        errors[d] = float(np.abs(spread - np.eye(k)).max())
    drop_shared(fit_list)
    return fits, errors


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``
    for every usable row of ``table`` (``vec_id, embedding``) and component."""
    fits, errors = fit_components(table.select("embedding"), components)
    return map_arrow(table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"),
                     _rows(fits, errors), OUTPUT)
