"""Whitening against dense linear algebra, and the bidiagonal solver on hard spectra."""

import math

import numpy as np
import pytest

from lumenfold.llm import bidiagonal, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, v int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, None, "x", 1) for i, v in vectors], SCHEMA)


def brute(vectors):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of the usable vectors."""
    whole = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in {tuple(x) for _, x in whole}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    rows = np.array([centre(x) for x in fit])
    e, v = np.linalg.eigh(rows.T @ rows / n)
    order = np.argsort(-e)[:16]
    out = []
    for i, x in whole:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out += [(i, k + 1, n, deviation, abs(centre(x) @ v[:, j]) / math.sqrt(e[j]), e[j] / e.sum()) for k, j in enumerate(order)]
    return sorted(out, key=repr)


def close(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("d, n", [(20, 400), (3, 50), (64, 200)])
def test_equals_dense_algebra(spark, d, n):
    rng = np.random.default_rng(d)
    values = (rng.normal(size=(n, d)) * np.linspace(3, 0.3, d)).astype(np.float32).tolist()
    vectors = [(i, v) for i, v in enumerate(values)] + [(0, values[0])] * 40 + [(7, values[3]), (None, values[1])]
    bad = [(900, None), (901, []), (902, [None] * d), (903, [float("nan")] * d), (904, [float("inf")] * d), (905, [1.0] * (d - 1))]
    found = whitening.whiten(table(spark, vectors + bad), fan=2).collect()
    assert max(r["identity_error"] for r in found) < 1e-9
    close(sorted(((r[0], r[1], r[2], r[3], abs(r[4]), r[5]) for r in found), key=lambda r: repr(r[:4])), sorted(brute(vectors), key=lambda r: repr(r[:4])))
    assert len({np.sign(r["whitened"]) for r in found if r["vec_id"] == 0 and r["component"] == 1}) == 1


def test_no_rows_and_no_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [float("nan")])])).collect() == []
    found = whitening.whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert sorted(map(tuple, found)) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0} and {r["explained"] for r in line if r["component"] == 1} == {1.0}


def test_large_entries_stay_exact(spark):
    vectors = [(i, [float(2**40 * i), 1.0, float(-i)]) for i in range(30)]
    found = whitening.whiten(table(spark, [*vectors, (99, [1e30, 0.0, 0.0])])).collect()
    by = {r["vec_id"]: r["deviation"] for r in found}
    assert 99 not in by
    assert by[0] is None  # (30 * 2**46 * 14.5)**2 is beyond 64 bits


@pytest.mark.parametrize("name", ["random", "multiple", "cluster", "graded", "low rank", "identity", "zero", "glued"])
def test_solver(name):
    rng = np.random.default_rng(4)
    d = 48
    left, right = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
    glued = np.kron(np.eye(d // 3), np.array([[2.0, 1, 0], [0, 2, 1], [0, 0, 2]])) + np.diag(np.full(d - 1, 1e-9), 1)
    spectrum = {"multiple": np.repeat([5.0, 2, 1], d // 3), "cluster": 1 + 1e-10 * np.arange(d), "graded": np.logspace(0, -7, d), "low rank": np.where(np.arange(d) < 5, 3.0, 0)}
    a = {"random": rng.normal(size=(d, d)), "identity": np.eye(d), "zero": np.zeros((d, d)), "glued": glued}.get(name)
    a = left * spectrum[name] @ right if a is None else a
    squares, vectors = bidiagonal.right_singular(a)
    wanted = np.linalg.svd(a, compute_uv=False) ** 2
    assert squares == pytest.approx(wanted, rel=1e-9, abs=1e-14 * max(wanted[0], 1e-300))
    assert np.abs(vectors @ vectors.T - np.eye(d)).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors.T) - vectors.T * squares).max() <= 1e-13 * max(wanted[0], 1e-300)
