import numpy as np
import pytest

from upkeep.llm import rotation_codes as rc
from upkeep.llm.components import connected_components, local_components

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string"


def brute(rows):
    """(vec_id, n_links, component_id, kept) by all pairs of rows."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            (_, a, la, *_), (_, b, lb, *_) = rows[i], rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= rc.THRESHOLD:
                    near[i].add(j), near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


def compared(spark, rows):
    got = [tuple(r) for r in rc.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_links_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rc, "BLOCK_ENTRIES", 64 * 24)       # several blocks a label (64 rows each)
    rng = np.random.default_rng(5)
    rows, vec_id = [], 0
    for label, groups in ((1, 30), (2, 3), (3, 1)):
        for _ in range(groups):
            base = rng.standard_normal(24)
            for _ in range(rng.integers(1, 12)):
                rows.append((vec_id, (base + rng.standard_normal(24) * rng.choice([0.0, 0.2, 0.3, 0.4])).tolist(), label, "x"))
                vec_id += 1
    base = rng.standard_normal(24)
    rows += [(1000 + i, (base + 0.22 * rng.standard_normal(24)).tolist(), 1, "y") for i in range(120)]      # a hot group
    got = compared(spark, rows)
    assert max(r[1] for r in got) > 60


def test_defined_cases(spark):
    a, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(5, a, 1, ""), (3, [2.0, 4.0, 6.0], 1, ""), (9, a, 2, ""), (4, a, None, ""), (1, None, 1, ""),
            (2, [0.0, 0.0, 0.0], 1, ""), (6, [1.0, None, 3.0], 1, ""), (7, [1.0, nan, 3.0], 1, ""), (8, [], 1, ""),
            (10, [1.0, 2.0], 1, ""), (5, a, 1, ""), (5, [-1.0, 0.0, 0.0], 1, ""), (None, a, 1, ""), (None, a, 7, ""),
            (11, [1e30, 2e30, 3e30], 1, ""), (12, [1e-30, 2e-30, 3e-30], 1, ""), (13, [-0.0, 1.0, 0.0], 3, ""),
            (14, [0.0, 1.0, 0.0], 3, "")]
    compared(spark, rows)
    assert rc.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("d", [1, 2, 3, 64, 100])
def test_bound_never_loses_a_pair(d):
    """Whatever the pair, the code's bound leaves every link open."""
    rng = np.random.default_rng(d)
    u = rc.units(rng.standard_normal((400, d)))
    v = rc.units(u + rng.random((400, 1)) * 0.5 * rc.units(rng.standard_normal((400, d))))
    packed, factor = rc.codes(u)
    corner = rc.corners(packed, d)
    product = (corner * rc.rotated(v)).sum(axis=1)
    cosine = (u * v).sum(axis=1)
    assert (product[cosine >= rc.THRESHOLD] >= rc.open_from(factor)[cosine >= rc.THRESHOLD]).all()
    assert np.allclose((corner * rc.rotated(u)).sum(axis=1), factor, atol=1e-6)


def test_estimates_are_unbiased_and_rule_out_strangers():
    rng = np.random.default_rng(0)
    u, v = rc.units(rng.standard_normal((3000, 64))), rc.units(rng.standard_normal((3000, 64)))
    packed, factor = rc.codes(u)
    product = (rc.corners(packed, 64) * rc.rotated(v)).sum(axis=1)
    error = product / factor - (u * v).sum(axis=1)
    assert abs(error.mean()) < 0.01 and 0.05 < error.std() < 0.15
    assert (product >= rc.open_from(factor)).mean() < 0.001
    assert np.allclose(rc.rotated(u) @ rc.rotated(v).T, u @ v.T, atol=1e-12)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(100, 180)] + [(7, 7), (500, 500)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (150, 2))]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges * 2, "u bigint, v bigint")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    label = local_components(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    lonely = {500} | {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {x: nodes[label[at[x]]] for x in nodes if x not in lonely}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
