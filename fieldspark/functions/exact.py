"""Exact sums of products of doubles, and error bounds that follow from them.

A double is a whole number of at most 53 bits times a power of two, so a product is the sum of three partial products of
27-bit halves, each below 2^55. They are added, as 32-bit digits, to an accumulator that spans every exponent that a
product of two doubles can have. Nothing is rounded until the one rounding at the end, whatever the sizes of the terms.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: Above the exponent of the least product of two doubles, whatever the half.
_OFFSET = 2304
_DIGITS = 2 * _OFFSET // 32 + 4
_LOW = (1 << 32) - 1


def _whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves (27 bits) of each double's whole number, and its exponent."""
    part, exponent = np.frexp(x)
    whole = np.ldexp(part, 53).astype(np.int64)
    return whole >> 27, whole & (1 << 27) - 1, exponent.astype(np.int64) - 53


def _add(digits: np.ndarray, rows: np.ndarray, values: np.ndarray, places: np.ndarray) -> None:
    at, shift = places >> 5, places & 31
    low, high = (values & _LOW) << shift, (values >> 32) << shift
    for k, part in enumerate((low & _LOW, (low >> 32) + (high & _LOW), high >> 32)):
        np.add.at(digits, (rows, at + k), part)


def sums_of_products(rows: np.ndarray, a: np.ndarray, b: np.ndarray, count: int) -> list[Fraction]:
    """For each of ``count`` rows the exact sum of a * b over the terms with that row; terms must be finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("only finite terms have a sum")
    (ah, al, ae), (bh, bl, be) = _whole(np.asarray(a, float)), _whole(np.asarray(b, float))
    digits = np.zeros((count, _DIGITS), np.int64)
    place = ae + be + _OFFSET
    _add(digits, rows, al * bl, place)
    _add(digits, rows, ah * bl + al * bh, place + 27)
    _add(digits, rows, ah * bh, place + 54)
    return [Fraction(sum(int(d) << 32 * k for k, d in enumerate(own) if d), 1) / (1 << _OFFSET) for own in digits]


def residuals(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b - A x for the entries (rows, columns, values) of A, each rounded once from its exact value."""
    n = len(b)
    own = np.arange(n)
    sums = sums_of_products(np.concatenate([own, rows]), np.concatenate([b, -np.asarray(values, float)]), np.concatenate([np.ones(n), x[columns]]), n)
    return np.array([float(s) for s in sums])


def dense_residuals(a: np.ndarray, x: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The same for a matrix, some rows at a time."""
    step = max(1, most // max(1, a.shape[1]))
    made = []
    for at in range(0, len(a), step):
        rows, columns = np.nonzero(a[at : at + step])
        made.append(residuals(rows, columns, a[at : at + step][rows, columns], x, b[at : at + step]))
    return np.concatenate(made) if made else np.empty(0)


def gram_defect(q: np.ndarray, z: np.ndarray) -> float:
    """The largest entry of q' z - I (where q is z) or of q' z, from exact sums."""
    worst = 0.0
    for j in range(z.shape[1]):
        rows = np.repeat(np.arange(q.shape[1]), len(q))
        sums = sums_of_products(rows, q.T.ravel(), np.tile(z[:, j], q.shape[1]), q.shape[1])
        worst = max([worst, *(abs(float(s - (1 if q is z and i == j else 0))) for i, s in enumerate(sums))])
    return worst


def backward_error(residual: np.ndarray, row_sums: np.ndarray, x: np.ndarray, b: np.ndarray) -> float:
    """The residual's largest entry over |A| |x| + |b|, in maximum norms."""
    size = float(row_sums.max(initial=0) * np.abs(x).max(initial=0) + np.abs(b).max(initial=0))
    worst = float(np.abs(residual).max(initial=0))
    return worst if worst == 0 else worst / max(size, np.finfo(float).tiny)


# -- small symmetric matrices


def _whole_entries(matrix: np.ndarray) -> list[list[int]]:
    """The entries times one power of two that makes all of them whole."""
    parts = [[Fraction(float(v)) for v in row] for row in matrix]
    common = max(f.denominator for row in parts for f in row)  # powers of two
    return [[int(f * common) for f in row] for row in parts]


def leading_signs(matrix: np.ndarray) -> list[int]:
    """The signs of a square matrix's leading minors, exactly: elimination without fractions, whose every quotient is whole."""
    a, signs, before = _whole_entries(matrix), [], 1
    for k in range(len(a)):
        signs.append((a[k][k] > 0) - (a[k][k] < 0))
        if not a[k][k]:
            return signs + [0] * (len(a) - len(signs)) if len(signs) < len(a) else signs
        for i in range(k + 1, len(a)):
            for j in range(k + 1, len(a)):
                a[i][j] = (a[i][j] * a[k][k] - a[i][k] * a[k][j]) // before
        before = a[k][k]
    return signs


def definite(matrices: np.ndarray) -> np.ndarray:
    """Whether each symmetric matrix (n, d, d) is positive definite. Minors in doubles decide where they are beyond their
    rounding error; the others are decided exactly, a matrix at a time."""
    n, d = matrices.shape[:2]
    finite = np.isfinite(matrices).all((1, 2))
    good, sure = finite.copy(), np.ones(n, bool)
    scaled = np.where(finite[:, None, None], matrices, 0.0)
    top = np.abs(scaled).max((1, 2), initial=0.0)
    scaled = scaled / np.where(top > 0, top, 1.0)[:, None, None]
    for k in range(1, d + 1):
        minor = np.linalg.det(scaled[:, :k, :k])
        sure &= (np.abs(minor) > 64 * k * np.finfo(float).eps) & ((top > 1e-250) & (top < 1e250))
        good &= minor > 0
    for i in np.flatnonzero(finite & ~sure):
        good[i] = all(s > 0 for s in leading_signs(matrices[i]))
    return good


def singular_values(matrices: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Singular values of each small matrix (n, d, d), descending, by one-sided Jacobi rotations: pairs of columns are turned
    until they are at right angles, which keeps small values accurate beside large ones."""
    a = np.array(matrices, float)
    d = a.shape[2]
    for _ in range(sweeps):
        turned = False
        for i in range(d):
            for j in range(i + 1, d):
                u, v = a[:, :, i], a[:, :, j]
                size, top = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
                safe = np.where((size > 0) & (top > 0), size * top, 1.0)
                angle = ((u / np.sqrt(safe)[:, None]) * (v / np.sqrt(safe)[:, None])).sum(1)
                turn = np.abs(angle) > 4 * np.finfo(float).eps
                if not turn.any():
                    continue
                turned = True
                ratio = np.where(turn, (top / np.where(size > 0, size, 1.0) - size / np.where(top > 0, top, 1.0)) / np.where(turn, 2 * angle, 1.0), 0.0)
                t = np.where(turn, np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio)), 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, :, i], a[:, :, j] = c[:, None] * u - s[:, None] * v, s[:, None] * u + c[:, None] * v
        if not turned:
            break
    return -np.sort(-np.linalg.norm(a, axis=1), axis=1)
