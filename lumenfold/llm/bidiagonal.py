"""Singular values and right singular vectors of a small square matrix, accurately, by its bidiagonal form.

Householder reflections take the matrix to upper bidiagonal form B; the differential quotient-difference algorithm with
shifts (dqds) finds the squares of its singular values from sums, products and quotients of positive numbers; a
twisted factorisation of B^T B - e I gives the vector of each e in one sweep, from the place where it is largest.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Values nearer to each other than this share get vectors that are made orthogonal.
CLUSTER = 0.03
#: So do values that differ by less than this share of the largest.
FLOOR = 1e-8


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector of the reflection that takes x to a multiple of the first axis; None if x is one already."""
    if len(x) < 2 or not np.any(x[1:]):
        return None
    v = x.copy()
    v[0] += math.copysign(float(np.linalg.norm(x)), x[0])
    return v / np.linalg.norm(v)


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, superdiagonal and right reflections (first index, unit vector) of a square matrix."""
    a, d, right = a.copy(), len(a), []
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = _reflector(a[k, k + 1 :])
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One shifted step: the new q and e, the last difference, and whether a difference before it is negative."""
    n = len(q)
    out_q, out_e = np.empty(n), np.empty(n - 1)
    d, early = float(q[0]) - shift, False
    for i in range(n - 1):
        early |= d < 0
        out_q[i] = d + e[i]
        ratio = q[i + 1] / out_q[i] if out_q[i] else 0.0
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    out_q[-1] = d
    return out_q, out_e, d, early


def _smaller(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the last two rows and columns."""
    a = float(q[-2] + (e[-2] if len(e) > 1 else 0.0))
    b, c = float(q[-1] + e[-1]), float(q[-2] * e[-1])  # c: the square of what is beside the diagonal
    larger = (a + b) / 2 + math.hypot((a - b) / 2, math.sqrt(c))
    return max((a * b - c) / larger, 0.0) if larger else 0.0


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The eigenvalues of B^T B, largest first, from the squares of B's diagonal and superdiagonal."""
    found: list[float] = []
    parts = [(np.asarray(q, float).copy(), np.asarray(e, float).copy(), 0.0)]
    small = (10 * EPS) ** 2
    while parts:
        q, e, moved = parts.pop()
        if len(q) == 1:
            found.append(max(float(q[0]), 0.0) + moved)
            continue
        cut = np.flatnonzero(e <= small * (moved + np.minimum(q[:-1], q[1:])))
        if len(cut):
            at = int(cut[-1]) + 1
            parts += [(q[:at], e[: at - 1], moved), (q[at:], e[at:], moved)]
            continue
        if q[0] * 1.5 < q[-1]:  # the small end goes last
            q, e = q[::-1].copy(), e[::-1].copy()
        shift = _smaller(q, e)
        step = _transform(q, e, shift)
        if step[2] < 0 and not step[3]:  # only the last difference is negative: it says by how much the shift is too large
            shift = max(shift + step[2], 0.0)
            step = _transform(q, e, shift)
        while step[2] < 0 or step[3]:
            shift = shift / 4 if shift > EPS * float(q.max()) else 0.0
            step = _transform(q, e, shift)
            if not shift:
                break
        parts.append((np.maximum(step[0], 0.0), np.maximum(step[1], 0.0), moved + shift))
    return np.sort(np.array(found))[::-1]


def _safe(x: float, tiny: float) -> float:
    return x if abs(x) > tiny else math.copysign(tiny, x)


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, list[int]]:
    """Both factorisations of B^T B - value I, as (lower, upper, gamma) rows, and the twists from the best on."""
    n = len(diagonal)
    tiny = EPS * EPS * float(max(np.max(diagonal**2), np.max(above**2, initial=0.0), 1e-290))
    d = np.array([_safe(float(x * x), tiny) for x in diagonal])
    low = above * diagonal[:-1] / d[:-1]
    lower, upper = np.zeros(n), np.zeros(n)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = _safe(s[i] + d[i], tiny)
        lower[i] = d[i] * low[i] / pivot
        s[i + 1] = lower[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = _safe(d[i] * low[i] * low[i] + p[i + 1], tiny)
        upper[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * d[i] / pivot - value
    gamma = s + p + value
    return np.stack([lower, upper, gamma]), np.argsort(np.abs(gamma), kind="stable").tolist()


def _from_twist(factors: np.ndarray, k: int) -> np.ndarray:
    z = np.zeros(factors.shape[1])
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -factors[0, i] * z[i + 1]
        if not abs(z[i]) < 1e150:
            z[i:] /= 1e150
    for i in range(k, len(z) - 1):
        z[i + 1] = -factors[1, i] * z[i]
        if not abs(z[i + 1]) < 1e150:
            z[: i + 2] /= 1e150
    return z / np.linalg.norm(z)


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The unit vector of z without its parts along ``others``, and the share of z that it is."""
    share = 1.0
    for _ in range(3):
        for other in others:
            z = z - (z @ other) * other
        norm = float(np.linalg.norm(z))
        if not norm:
            return z, 0.0
        z, share = z / norm, share * norm
    return z, share


def _vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of an unreduced B^T B, as rows, in the order of its values.

    In a cluster the twists are tried from the best on until one gives a direction of its own with a small residual. Where
    none does (a cluster that is numerically one value, or a pivot of no size), inverse iteration finds one.
    """
    b = np.diag(diagonal) + np.diag(above, 1)
    square = b.T @ b
    limit = 16 * len(values) * EPS * float(values[0])
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [out[j] for j in range(i) if values[j] - value <= max(CLUSTER * values[j], FLOOR * values[0])]
        factors, twists = twisted(diagonal, above, float(value))
        found = None
        for k in twists:
            z, share = _orthogonal(_from_twist(factors, k), near)
            if share > 0.1 and np.linalg.norm(square @ z - value * z) <= limit:
                found = z
                break
        if found is None:
            shifted = square - (value + 4 * EPS * values[0]) * np.eye(len(values))
            found = np.random.default_rng(i).normal(size=len(values))
            for _ in range(3):
                found, _ = _orthogonal(np.linalg.solve(shifted, _orthogonal(found, near)[0]), near)
        out.append(found)
    return np.array(out)


def right_singular(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of ``a``, largest first, and the right singular vectors as rows."""
    d = len(a)
    scale = float(np.max(np.abs(a), initial=0.0))
    if not scale:
        return np.zeros(d), np.eye(d)
    diagonal, above, reflections = bidiagonalise(a / scale)
    above[np.abs(above) <= 8 * EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))] = 0.0
    edges = [0, *(np.flatnonzero(above == 0) + 1).tolist(), d]
    values, vectors = np.zeros(d), np.zeros((d, d))
    for lo, hi in zip(edges, edges[1:]):
        own, beside = diagonal[lo:hi], above[lo : hi - 1]
        values[lo:hi] = dqds(own**2, beside**2)
        vectors[lo:hi, lo:hi] = _vectors(own, beside, values[lo:hi])
    for at, v in reversed(reflections):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ v, v)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, vectors[order]
