"""Clustering and whitening of vectors against plain definitions."""

import hashlib
import math

import numpy as np
import pytest

from tillwatch.llm import centroids, whitening
from tillwatch.llm.common import table
from tests.conftest import TINY

SCHEMA = "vec_id long, embedding array<float>, label int, chunk long, block int, x string, size long, w double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4, 5.0) for i, v in rows], SCHEMA).repartition(3)


def awkward(d=64, n=200, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * np.linspace(2.0, 0.2, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    third = rows[7][1]
    rows += [(1000 + i, third) for i in range(n // 2)]  # a vector that a third of the rows hold
    rows += [rows[3], (None, rows[5][1]), (None, None), (2000, None), (2001, []), (2002, rows[0][1][:-1] + [None])]
    rows += [(2003, rows[0][1][:-1] + [math.nan]), (2004, rows[0][1][:-1] + [-math.inf]), (2005, rows[0][1][:5]), (2006, [-0.0] * d)]
    return rows


def usable(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def plain_clusters(rows):
    kept = [(i, [math.floor(64 * c) for c in v], v) for i, v in usable(rows, 64)]
    named = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2])
    middles = [list(r[1]) for r in sorted(kept, key=named)[:16]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min((far(x, m), k) for k, m in enumerate(middles))
    for _ in range(3):
        groups = {}
        for _, x, _ in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for k, members in groups.items():
            middles[k] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(x)[::-1]) for i, x, _ in kept]
    sums = {}
    for _, k, far_off in found:
        sums[k] = sums.get(k, 0) + far_off
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted([(i, k, far_off, sums[k], sum(sums.values()), digest[k]) for i, k, far_off in found], key=repr)


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 16)  # several chunks of a task
    rows = awkward()
    got = sorted(map(tuple, centroids.cluster_digest(frame(spark, rows)).collect()), key=repr)
    assert got == plain_clusters(rows)


def test_clusters_of_few_large_or_no_vectors(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1e30] * 64), (4, [-1e30] * 64)]
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.cluster_digest(frame(spark, few)).collect()}
    assert got[1] == got[2] and len({c for c, _ in got.values()}) == 3 and all(d == 0 for _, d in got.values())
    assert centroids.cluster_digest(frame(spark, [])).collect() == []


def plain_whitening(rows, d):
    kept = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in usable(rows, d)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    values, vectors = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def compared(spark, rows, d, components):
    kept, n, sums, values, vectors = plain_whitening(rows, d)
    got = whitening.whitening_digest(frame(spark, rows)).collect()
    assert len(got) == components * len(kept) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    wanted = sorted((repr(i), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept)
    for k in range(components):
        mine = [r for r in got if r["component"] == k + 1]
        assert sorted((repr(r["vec_id"]), r["deviation"]) for r in mine) == wanted
        assert mine[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        w = [(repr(i), float((np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k]))) for i, x in kept]
        ours = sorted((repr(r["vec_id"]), r["whitened"]) for r in mine)
        signs = [sorted((i, sign * v) for i, v in w) for sign in (1, -1)]
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 for a, b in zip(ours, s)) for s in signs)


def test_whitening(spark):
    compared(spark, awkward(), 64, 4)
    compared(spark, awkward(d=7, n=40), 7, 4)


def test_whitening_of_large_entries(spark):
    compared(spark, [(i, [float(np.float32(c * 5000.0)) for c in v]) for i, v in usable(awkward(d=6, n=50), 6)], 6, 4)


def test_whitening_with_equal_and_missing_variances(spark):
    corners = [(i, [float(i >> b & 1) for b in range(3)] + [0.0]) for i in range(8)]  # three equal variances, one of none
    got = whitening.whitening_digest(frame(spark, corners)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and all(r["identity_error"] < 1e-12 for r in got)
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 for r in got)
    assert all(abs(sum(r["whitened"] ** 2 for r in got if r["vec_id"] == i) - 3) < 1e-9 for i in range(8))
    assert whitening.whitening_digest(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitening_digest(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitening_digest(frame(spark, [])).collect() == []


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 9):
        a = rng.integers(-50, 50, (d, d + 2)).astype(object)
        a[: d // 3] = 0  # rows of zeros make the reduction look for pivots
        matrix = a @ a.T
        polynomial = whitening.characteristic_polynomial(spark, matrix)
        assert polynomial[0] == 1 and polynomial[1] == -int(np.trace(matrix))
        values = sorted(np.linalg.eigvalsh(matrix.astype(float)), reverse=True)
        roots, shift = whitening.largest_roots(polynomial, int(np.trace(matrix)), d)
        assert len(roots) == d - d // 3
        assert np.allclose([r / 2**shift for r in roots], values[: len(roots)])
    # det(x - matrix) by cofactors
    m = [[2, 1, 0], [1, 3, 1], [0, 1, 4]]
    assert whitening.characteristic_polynomial(spark, np.array(m, dtype=object)) == [1, -9, 24, -18]
    for p in whitening.primes_for(10**40):
        assert all(p % q for q in range(2, 1000))


def test_sums_of_products_are_exact():
    x = np.array([[2**40, -(2**40), 3], [2**39 + 1, 7, -(2**21)], [-5, 2**20, 1]])
    plain = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert whitening.products(x).tolist() == plain


def test_whitening_of_the_table(spark):
    compared_rows = [tuple(r) for r in table(spark, TINY, "embeddings").select("vec_id", "embedding").collect()]
    compared(spark, compared_rows, 64, 4)
