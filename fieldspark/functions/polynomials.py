"""Complete polynomial spaces: all monomials below an order, by degree, larger exponents of earlier axes first."""

from __future__ import annotations

from itertools import product
from typing import Any


def exponents(dimension: int, order: int) -> list[tuple[int, ...]]:
    found = [e for e in product(range(order), repeat=dimension) if sum(e) < order]
    return sorted(found, key=lambda e: (sum(e), [-x for x in e]))


def monomial(x: list[Any], e: tuple[int, ...], factor: float = 1.0) -> Any:
    made = x[0] * 0.0 + factor
    for axis, n in zip(x, e):
        for _ in range(n):
            made = made * axis
    return made


def values(x: list[Any], order: int) -> list[Any]:
    return [monomial(x, e) for e in exponents(len(x), order)]


def derivative(x: list[Any], e: tuple[int, ...], *axes: int) -> Any:
    """The partial derivative of a monomial by the axes, one after another."""
    factor, left = 1.0, list(e)
    for k in axes:
        factor *= left[k]
        left[k] -= 1
    return monomial(x, tuple(max(n, 0) for n in left), factor) if factor else x[0] * 0.0


def gradients(x: list[Any], order: int) -> list[list[Any]]:
    return [[derivative(x, e, k) for k in range(len(x))] for e in exponents(len(x), order)]


def hessians(x: list[Any], order: int) -> list[list[list[Any]]]:
    n = range(len(x))
    return [[[derivative(x, e, i, j) for j in n] for i in n] for e in exponents(len(x), order)]
