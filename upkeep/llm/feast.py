"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

The matrix is a covariance on the driver: its size is the number of
dimensions, never the number of rows.

1. Inertia counts (signs of the pivots of ``A - s I``, by Sylvester's law) say
   how many eigenvalues lie above any shift ``s``.  Bisection on them finds a
   lower end of the wanted part of the spectrum and cuts it into intervals of
   a few eigenvalues each.
2. For each interval a Gauss-Legendre rule on the half circle above it adds up
   solves with the complex shifted matrix: a filter that projects a random
   block onto the interval's eigenvectors.  Rayleigh-Ritz in the filtered
   block gives eigenpairs; the block is filtered again until the residuals are
   at rounding level.
3. The pairs found in an interval must be as many as its inertia count;
   otherwise the block is enlarged, and what is still missed is an error.
"""

from __future__ import annotations

import numpy as np

NODES = 12
MOST_PER_INTERVAL = 8
ROUNDS = 20
EPS = np.finfo(float).eps


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``a`` above ``shift``: the positive pivots of a
    symmetric factorisation of ``a - shift I`` with 1x1 and 2x2 blocks."""
    m = a - shift * np.eye(len(a))
    grow = (1 + 17 ** 0.5) / 8
    positive, k, n = 0, 0, len(m)
    while k < n:
        rest = np.abs(m[k + 1:, k])
        r = k + 1 + int(rest.argmax()) if len(rest) else k
        top = rest[r - k - 1] if len(rest) else 0.0
        width = 1
        if abs(m[k, k]) < grow * top:
            row = np.abs(m[r, k:])
            row[r - k] = 0.0
            most = row.max()
            if abs(m[k, k]) * most < grow * top * top:
                if abs(m[r, r]) >= grow * most:
                    _swap(m, k, r)
                else:
                    width = 2
                    _swap(m, k + 1, r)
        if width == 1:
            pivot = m[k, k]
            positive += bool(pivot > 0)
            if pivot:
                col = m[k + 1:, k].copy()
                m[k + 1:, k + 1:] -= np.outer(col, col / pivot)
        else:                       # such a block has one eigenvalue of either sign
            positive += 1
            block = m[k:k + 2, k:k + 2].copy()
            col = m[k + 2:, k:k + 2].copy()
            m[k + 2:, k + 2:] -= col @ np.linalg.solve(block, col.T)
        k += width
    return positive


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def projected(a: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The quadrature of the spectral projector of (low, high), applied to ``block``."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    eye = np.eye(len(a))
    for node, weight in zip(x, w):
        turn = radius * np.exp(0.5j * np.pi * (1 + node))
        out += 0.5 * weight * (turn * np.linalg.solve((centre + turn) * eye - a, block.astype(complex))).real
    return out


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    basis, _ = np.linalg.qr(block)
    value, turn = np.linalg.eigh(basis.T @ a @ basis)
    return value, basis @ turn


def interval_pairs(a: np.ndarray, low: float, high: float, count: int,
                   seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` with values in (low, high)."""
    size = min(len(a), 2 * count + 4)
    norm = np.abs(a).sum(axis=1).max()
    while True:
        x = np.random.default_rng(seed).standard_normal((len(a), size))
        best = np.inf
        for _ in range(ROUNDS):
            value, x = ritz(a, projected(a, low, high, x))
            residual = np.linalg.norm(a @ x - x * value, axis=0)
            inside = (value > low) & (value < high) & (residual < 1e-9 * norm)
            worst = residual[inside].max() if inside.sum() == count else np.inf
            if worst <= 4 * EPS * norm or (worst < 1e-13 * norm and worst >= best / 2):
                return value[inside], x[:, inside]
            best = min(best, worst)
        if np.isfinite(best):
            return value[inside], x[:, inside]
        if size == len(a):
            raise ArithmeticError(f"components missed in ({low}, {high}): inertia counts {count}")
        size = min(len(a), 2 * size)


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that exceed rounding, falling, and
    their unit eigenvectors (columns; the largest entry is positive)."""
    d = len(matrix)
    norm = np.abs(matrix).sum(axis=1).max() if d else 0.0
    if not norm > 0:
        return np.zeros(0), np.zeros((d, 0))
    a = matrix / norm
    floor = 8 * d * EPS
    wanted = min(wanted, count_above(a, floor))
    low, high, above = floor, 1.0 + 1e-9, count_above(a, floor)
    top = high
    while above > wanted and high - low > 1e-12:      # raise the lower end towards the wanted count
        middle = (low + high) / 2
        n = count_above(a, middle)
        if n >= wanted:
            low, above = middle, n
        else:
            high = middle
    parts, todo = [], [(low, top, above)]
    while todo:
        lo, hi, n = todo.pop()
        if n > MOST_PER_INTERVAL and hi - lo > 1e-10:
            middle = (lo + hi) / 2
            upper = count_above(a, middle)
            upper -= count_above(a, hi) if hi < top else 0
            todo += [(lo, middle, n - upper), (middle, hi, upper)]
        elif n:
            parts.append(interval_pairs(a, lo, hi, n))
    found = np.concatenate([x for _, x in parts], axis=1)
    value, x = ritz(a, found)
    if len(value) != above:
        raise ArithmeticError(f"{len(value)} components found, inertia counts {above}")
    order = np.argsort(-value, kind="stable")[:wanted]
    value, x = value[order] * norm, x[:, order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(order))])
    return value, x * np.where(sign == 0, 1.0, sign)
