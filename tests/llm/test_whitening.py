import numpy as np
import pytest
from pyspark.sql import functions as F

from upkeep.llm import feast, whitening

from ..conftest import SF_SMALL

SCHEMA = "vec_id bigint, embedding array<double>, label int, component string"


def brute(vectors: dict[int, list[float]], k=whitening.COMPONENTS):
    """Whitened rows in plain numpy, vec_id -> (n, deviation, values, shares)."""
    x = {i: np.floor(64 * np.array(v)).astype(int) + 1_000_000 for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return {i: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(y, s)), (y - s / n) @ q / np.sqrt(e),
                e / (c * c).sum() * n) for i, y in x.items()}


def check(rows, want, tolerance=1e-7):
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert got.keys() == want.keys()
    sign = None
    for i, (n, deviation, z, share) in want.items():
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, len(z) + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, deviation)}
        w = np.array([r["whitened"] for r in mine])
        assert np.allclose(np.abs(w), np.abs(z), atol=tolerance)
        if sign is None:
            sign = np.where(np.sign(w) == np.sign(z), 1, -1)
        clear = np.abs(z) > 1e-6
        assert (np.sign(w)[clear] == (sign * np.sign(z))[clear]).all() or (np.abs(z[~clear]) < 1e-6).any()
        assert np.allclose([r["explained"] for r in mine], share, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine)


def test_whole_table_by_brute_force(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    check(whitening.whiten(table).collect(), brute(vectors))


def test_fit_list_holds_each_vector_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist(), 0, "x") for i in range(40)]
    copies = [(100 + i, rows[0][1], 1, "y") for i in range(300)]
    table = spark.createDataFrame(rows + copies, SCHEMA)
    check(whitening.whiten(table).collect(), brute({r[0]: r[1] for r in rows + copies}))


def test_wide_entries_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3) * [1e-1, 1e6, 1e11]).tolist(), 0, "x") for i in range(30)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute({r[0]: r[1] for r in rows})
    for r in out:
        deviation = want[r["vec_id"]][1]
        assert r["deviation"] == (deviation if deviation < 1 << 63 else None)


def test_defined_cases(spark):
    one = [0.5, -1.0, 0.25]
    rows = [(1, one, 0, ""), (2, [0.1, 0.2, 0.3], 0, ""), (2, [1.0, 0.0, 0.0], 0, ""), (None, [0.0, 1.0, 2.0], 0, ""),
            (3, None, 0, ""), (4, [1.0, None, 0.0], 0, ""), (5, [float("nan"), 0.0, 0.0], 0, ""), (6, [], 0, ""),
            (7, [float("inf"), 0.0, 1.0], 0, ""), (8, [1.0, 2.0], None, ""), (9, [1.0, 2.0], None, ""), (1, one, 0, "")]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # Lengths 3 (four distinct vectors: three components) and 2 (one distinct vector: none).
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == sorted(
        [(False, 1)] * 6 + [(False, 2)] * 6 + [(True, 0)] * 3)
    assert {r["n"] for r in out} == {4}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_contour_integration(d):
    rng = np.random.default_rng(d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for values in (rng.random(d), np.r_[np.ones(d // 2) * 3, rng.random(d - d // 2)], 10.0 ** -np.arange(d),
                   np.zeros(d)):
        a = (turn * values) @ turn.T
        a = (a + a.T) / 2
        w, x = feast.leading_pairs(a, 16)
        exact = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(w, exact[:len(w)], atol=1e-14)
        assert len(w) == min(16, (exact > 8 * d * feast.EPS * max(np.abs(a).sum(axis=1).max(), 1e-300)).sum())
        assert np.allclose(x.T @ x, np.eye(len(w)), atol=1e-13) and np.allclose(a @ x, x * w, atol=1e-14 * d)


def test_inertia_counts():
    rng = np.random.default_rng(9)
    for _ in range(30):
        a = rng.standard_normal((12, 12))
        a = a + a.T
        w = np.linalg.eigvalsh(a)
        for shift in (*((w[1:] + w[:-1]) / 2), w[0] - 1, w[-1] + 1):
            assert feast.count_above(a, shift) == (w > shift).sum()


def test_packing_keeps_every_value():
    y = np.array([[0, 1], [127, -128], [128, 0], [-129, 3], [1 << 20, 0], [-(1 << 31), (1 << 31) - 1],
                  [1 << 40, -5], [(1 << 62), -(1 << 62)]])
    for row, data in zip(y, whitening.pack(y)):
        assert np.array_equal(np.frombuffer(data, f"<i{len(data) // 2}"), row)
    assert [len(x) // 2 for x in whitening.pack(y)] == [1, 1, 2, 2, 4, 4, 8, 8]
