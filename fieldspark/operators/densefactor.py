"""Dense symmetric systems of one field: factors, ranks that two methods agree on, null spaces, and their options.

A task solves one field, whose size ``fields.MAX_CENTERS`` bounds. Nothing is repaired in silence: a regularisation is added
only where it is asked for and named, and what the checks find is an error or part of the review.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from fieldspark.errors import ConditioningError, InputError, MemoryLimitError, RankError
from fieldspark.functions import exact

EPS = float(np.finfo(float).eps)
#: Fixed value: the pivoting threshold that balances the growth of one-by-one and two-by-two pivots, (1 + sqrt 17) / 8.
ALPHA = (1 + 17**0.5) / 8
#: Columns that are factored before the rest of the matrix is brought up to date by one product.
PANEL = 64
#: Systems beyond this size are reviewed by bounds first, and by all singular values and exact sums only where those don't decide.
LARGE = 1000


@dataclass(frozen=True)
class SolveOptions:
    """factorization: cholesky, ldlt (for indefinite systems) or auto, which takes cholesky without a polynomial and ldlt
    with one. route: augmented, or null_space, which solves for weights in the polynomial's null space. regularization is
    added to the kernel matrix's diagonal. A condition beyond condition_limit, or more bytes than memory_limit, is an error."""

    factorization: str = "auto"
    route: str = "augmented"
    regularization: float | None = None
    condition_limit: float | None = None
    memory_limit: int | None = None
    refinements: int = 8

    def __post_init__(self):
        if self.factorization not in ("auto", "cholesky", "ldlt") or self.route not in ("augmented", "null_space"):
            raise InputError("no such factorization or route", factorization=self.factorization, route=self.route)
        if self.regularization is not None and not 0 < self.regularization < float("inf"):
            raise InputError("a regularisation must be positive", amount=self.regularization)
        if self.condition_limit is not None and not self.condition_limit >= 1 or self.refinements < 0:
            raise InputError("a condition is 1 or more, refinements 0 or more")

    def require_memory(self, size: int) -> None:
        """Five square arrays of doubles are alive at most: the system, scaled, its factor, and two for the reviews."""
        needed = 5 * 8 * size * size
        if self.memory_limit is not None and needed > self.memory_limit:
            raise MemoryLimitError("the system needs more memory than allowed", bytes=needed, limit=self.memory_limit)

    def regularized(self, k: np.ndarray) -> np.ndarray:
        if self.regularization is None:
            return k
        made = k.copy()
        diagonal = np.diag(k) + self.regularization
        if (diagonal == np.diag(k)).any():
            raise InputError("the regularisation is lost in rounding", amount=self.regularization)
        np.fill_diagonal(made, diagonal)
        return made


# -- factors


@dataclass
class Ldlt:
    """P A P' = L D L' with unit lower L and blocks of one or two rows in D."""

    order: np.ndarray
    lower: np.ndarray
    blocks: list[np.ndarray]

    def inertia(self) -> tuple[int, int, int]:
        """Numbers of positive, negative and zero eigenvalues, those of D's blocks."""
        signs = np.sign(np.concatenate([np.linalg.eigvalsh(b) for b in self.blocks]))
        return int((signs > 0).sum()), int((signs < 0).sum()), int((signs == 0).sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = _forward(self.lower, b[self.order].astype(float))
        at = 0
        for block in self.blocks:
            size = len(block)
            if not (block[0, 0] if size == 1 else np.linalg.det(block)):
                raise RankError("the system is singular", size=len(b))
            x[at : at + size] = x[at] / block[0, 0] if size == 1 else np.linalg.solve(block, x[at : at + size])
            at += size
        made = np.empty(len(b))
        made[self.order] = _backward(self.lower, x)
        return made


def _forward(lower: np.ndarray, x: np.ndarray) -> np.ndarray:
    """lower^-1 x, by panels."""
    for k in range(0, len(x), PANEL):
        x[k : k + PANEL] = np.linalg.solve(lower[k : k + PANEL, k : k + PANEL], x[k : k + PANEL])
        x[k + PANEL :] -= lower[k + PANEL :, k : k + PANEL] @ x[k : k + PANEL]
    return x


def _backward(lower: np.ndarray, x: np.ndarray) -> np.ndarray:
    """lower'^-1 x, by panels."""
    for k in reversed(range(0, len(x), PANEL)):
        x[k : k + PANEL] -= lower[k + PANEL :, k : k + PANEL].T @ x[k + PANEL :]
        x[k : k + PANEL] = np.linalg.solve(lower[k : k + PANEL, k : k + PANEL].T, x[k : k + PANEL])
    return x


def ldlt(matrix: np.ndarray) -> Ldlt:
    """The factor of a symmetric matrix, definite or not, by Bunch and Kaufman's partial pivoting: a pivot of one row, or of
    two where the diagonal is too small beside its column. Columns are brought up to date when they are looked at, and the
    rest of the matrix a panel at a time."""
    a = np.array(matrix, float)
    n = len(a)
    order, lower, blocks, k = np.arange(n), np.eye(n), [], 0
    while k < n:
        first, whole = k, np.zeros((n, PANEL + 1))  # the panel's columns of L D
        now = lambda j: a[k:, j] - lower[k:, first:k] @ whole[j, : k - first]
        while k < n and k - first < PANEL:
            size, other = 1, k
            column = now(k)
            here, below = abs(column[0]), np.abs(column[1:])
            if len(below) and here < ALPHA * below.max():
                worst = k + 1 + int(below.argmax())
                row = np.abs(now(worst))
                own, row[worst - k] = row[worst - k], 0.0
                if here * row.max() < ALPHA * below.max() ** 2:
                    other = worst
                    size = 1 if own >= ALPHA * row.max() else 2
            last = k + size - 1
            if other != last:
                for x in (a, a.T):
                    x[[last, other], k:] = x[[other, last], k:]
                lower[[last, other], :k] = lower[[other, last], :k]
                whole[[last, other]] = whole[[other, last]]
                order[[last, other]] = order[[other, last]]
            columns = np.stack([now(k + j) for j in range(size)], 1)
            pivot, column = columns[:size].copy(), columns[size:]
            if size == 2:
                pivot[0, 1] = pivot[1, 0]
            if pivot.any():
                lower[k + size :, k : k + size] = column / pivot[0, 0] if size == 1 else np.linalg.solve(pivot, column.T).T
                whole[k + size :, k - first : k - first + size] = column
            blocks.append(pivot)
            k += size
        a[k:, k:] -= lower[k:, first:k] @ whole[k:, : k - first].T
    return Ldlt(order, lower, blocks)


@dataclass
class Cholesky:
    lower: np.ndarray

    def solve(self, b: np.ndarray) -> np.ndarray:
        return _backward(self.lower, _forward(self.lower, b.astype(float)))


def factor_of(scaled: np.ndarray, factorization: str) -> Cholesky | Ldlt:
    if factorization == "ldlt":
        return ldlt(scaled)
    try:
        return Cholesky(np.linalg.cholesky(scaled))
    except np.linalg.LinAlgError as error:
        raise ConditioningError("the matrix is not positive definite") from error


# -- ranks


@dataclass(frozen=True)
class RankReview:
    """decision: full, deficient or ambiguous; the ranks by singular values and by pivoted QR (null if not asked for); the
    quotient of the extreme singular values."""

    decision: str
    svd_rank: int
    qr_rank: int | None
    condition: float
    smallest: float
    threshold: float


def equilibrated(matrix: np.ndarray) -> np.ndarray:
    a = np.array(matrix, float)
    for _ in range(8):
        for axis in (1, 0):
            size = np.abs(a).max(axis=axis, keepdims=True)
            if not size.all():
                return a
            a /= size
    return a


def pivoted_diagonal(matrix: np.ndarray) -> np.ndarray:
    """Magnitudes on the diagonal of R, by Householder reflections that take the longest remaining column first."""
    a = np.array(matrix, float)
    found = []
    for k in range(min(a.shape)):
        lengths = np.linalg.norm(a[k:, k:], axis=0)
        best = k + int(lengths.argmax())
        a[:, [k, best]] = a[:, [best, k]]
        v = a[k:, k].copy()
        length = np.linalg.norm(v)
        found.append(length)
        if length:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
    return np.array(found)


def decide_rank(matrix: np.ndarray, agree: bool = True) -> RankReview:
    """The rank after equilibration. It is ambiguous if a singular value is within a factor of 16 of the threshold, the larger
    side times eps times the largest one, or (with ``agree``) if a pivoted QR by the same threshold finds another."""
    a = equilibrated(matrix)
    s = np.linalg.svd(a, compute_uv=False)
    top = float(s[0]) if len(s) else 0.0
    tau = max(a.shape) * EPS * top
    svd_rank = int((s > tau).sum())
    qr_rank = int((pivoted_diagonal(a) > tau).sum()) if agree else None
    near = bool(((s > tau / 16) & (s < tau * 16)).any())
    decision = "ambiguous" if near or agree and qr_rank != svd_rank else "full" if svd_rank == min(a.shape) else "deficient"
    smallest = float(s[-1]) if len(s) else 0.0
    return RankReview(decision, svd_rank, qr_rank, top / smallest if smallest else float("inf"), smallest, float(tau))


def require_rank(matrix: np.ndarray, agree: bool = True) -> RankReview:
    review = decide_rank(matrix, agree)
    if review.decision == "ambiguous":
        raise RankError("the rank is ambiguous", smallest=review.smallest, threshold=review.threshold)
    return review


def require_regular(scaled: np.ndarray, factor: Cholesky | Ldlt | None, options: SolveOptions) -> float:
    """The condition of a symmetric scaled system; an error if its rank is ambiguous or deficient. In a large one the factor
    tells the size of the inverse by repeated solving, which finds it but for a small factor: where even 16 times as much
    would be no cause to doubt the rank, the singular values are not computed and the condition is as found."""
    n = len(scaled)
    if n > LARGE and factor is not None and options.condition_limit is None:
        x = np.random.default_rng(n).standard_normal(n)
        size = 0.0
        for _ in range(12):
            x = x / np.linalg.norm(x)
            y = factor.solve(x)
            size, x = max(size, float(np.linalg.norm(y))), y
        top = float(np.abs(scaled).sum(axis=1).max())  # at least the largest singular value
        if np.isfinite(size) and 1 / size > 256 * n * EPS * top:
            return top * size
    review = require_rank(scaled, agree=False)
    if review.decision == "deficient":
        raise RankError("the system is singular", size=n)
    return review.condition


# -- null spaces


@dataclass
class Complement:
    """The null space of Q' for a matrix Q of full column rank: Z, the last columns of I - V T V', a product of reflections
    that takes Q's columns to the first axes."""

    v: np.ndarray
    t: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Z x."""
        whole = np.concatenate([np.zeros((len(self.t), *x.shape[1:])), x])
        return whole - self.v @ (self.t @ (self.v.T @ whole))

    def reduce(self, y: np.ndarray) -> np.ndarray:
        """Z' y."""
        return (y - self.v @ (self.t.T @ (self.v.T @ y)))[len(self.t) :]

    def project(self, k: np.ndarray) -> np.ndarray:
        """Z' K Z for a symmetric K."""
        half = (k @ self.v) @ self.t
        made = k - half @ self.v.T
        made -= self.v @ (self.t.T @ (self.v.T @ made))
        made = made[len(self.t) :, len(self.t) :]
        return (made + made.T) / 2


def complement(matrix: np.ndarray) -> tuple[Complement, np.ndarray]:
    """The null space of a matrix' transpose, and an orthonormal basis of the matrix; an error if its rank is in doubt."""
    review = require_rank(matrix)
    if review.svd_rank < matrix.shape[1]:
        raise RankError("the centers do not determine the polynomial", rank=review.svd_rank, terms=matrix.shape[1])
    n, m = matrix.shape
    a = matrix / np.abs(matrix).max(axis=0)  # scaled columns span the same
    basis = np.linalg.qr(a)[0]
    v, t = np.zeros((n, m)), np.zeros((m, m))
    for k in range(m):
        own = a[k:, k].copy()
        own[0] += np.copysign(np.linalg.norm(own), own[0])
        v[k:, k] = own / np.linalg.norm(own)
        a -= 2 * np.outer(v[:, k], v[:, k] @ a)
        t[:k, k] = -2 * t[:k, :k] @ (v[:, :k].T @ v[:, k])
        t[k, k] = 2.0
    return Complement(v, t), basis


def null_space(matrix: np.ndarray) -> np.ndarray:
    """Orthonormal columns Z with Q'Z = 0 for a matrix Q of full column rank, both verified within 64 n eps, the first by
    exact sums of products; in a large matrix by plain ones with n eps, which bounds their rounding, added to them."""
    made, basis = complement(matrix)
    n = len(matrix)
    z = made.expand(np.eye(n - matrix.shape[1]))
    apart = float(np.abs(basis.T @ z).max(initial=0)) + n * EPS
    if z.shape[1] and (n <= LARGE or apart > 64 * n * EPS):
        apart = exact.gram_defect(basis, z)
    unit = float(np.abs(z.T @ z - np.eye(z.shape[1])).max(initial=0))
    if max(apart, unit) > 64 * n * EPS:
        raise ConditioningError("the null space is not orthonormal", apart=apart, unit=unit)
    return z


def _checked(k: np.ndarray, p: np.ndarray) -> tuple[Complement, np.ndarray]:
    """The null space of a polynomial's columns and the kernel matrix within it, without Z itself where it is large. What
    verifies Z then is that its reflections are orthonormal, and that they take the polynomial's basis to the first axes."""
    made, basis = complement(p)
    n, m = p.shape
    if n <= LARGE:
        null_space(p)
    else:
        apart = float(np.abs(made.reduce(basis)).max(initial=0)) + (4 * m + 1) * n * EPS
        unit = float(np.abs(made.t + made.t.T - made.t.T @ (made.v.T @ made.v) @ made.t).max(initial=0)) + n * EPS
        if max(apart, unit) > 64 * n * EPS:
            raise ConditioningError("the null space is not orthonormal", apart=apart, unit=unit)
    require_symmetric(k)
    return made, made.project(k)


def require_symmetric(k: np.ndarray) -> None:
    if np.abs(k - k.T).max(initial=0) > 64 * EPS * np.abs(k).max(initial=0):
        raise InputError("the kernel matrix is not symmetric")


def energies(k: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Eigenvalues of Z'KZ, ascending; K must be symmetric beyond doubt."""
    require_symmetric(k)
    projected = z.T @ k @ z
    return np.linalg.eigvalsh((projected + projected.T) / 2) if z.shape[1] else np.empty(0)


def polynomial_energies(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same within the null space of polynomial columns p."""
    if not p.shape[1]:
        return energies(k, np.eye(len(k)))
    return np.linalg.eigvalsh(_checked(k, p)[1]) if len(k) > p.shape[1] else np.empty(0)


def require_definite(projected: np.ndarray, n: int) -> None:
    """A matrix that has a Cholesky factor is definite; where there is none its eigenvalues tell."""
    try:
        np.linalg.cholesky(projected)
        return
    except np.linalg.LinAlgError:
        values = np.linalg.eigvalsh(projected)
    if len(values) and values.min() <= -64 * n * EPS * max(1.0, np.abs(values).max()):
        raise ConditioningError("the kernel is not definite on the null space", smallest=float(values.min()))


# -- solving


@dataclass(frozen=True)
class Solved:
    found: np.ndarray
    backward_error: float
    condition: float
    inertia: tuple[int, int, int] | None
    refinements: int


def long_residuals(system: np.ndarray, x: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """rhs - system x, summed in long doubles, some rows at a time."""
    long, step = np.longdouble, max(1, (1 << 20) // max(1, len(x)))
    made = [rhs[at : at + step] - system[at : at + step].astype(long) @ x.astype(long) for at in range(0, len(rhs), step)]
    return np.concatenate(made).astype(float) if made else np.empty(0)


def backward_error(system: np.ndarray, x: np.ndarray, rhs: np.ndarray) -> float:
    """The backward error from exact residuals; of a large system from those in long doubles, with a bound of their rounding
    added, unless it is too large for a verdict."""
    n, sums = len(rhs), np.abs(system).sum(axis=1)
    if n > LARGE:
        found = exact.backward_error(long_residuals(system, x, rhs), sums, x, rhs) + (n + 2) * float(np.finfo(np.longdouble).eps)
        if found <= 128 * n * EPS:
            return found
    return exact.backward_error(exact.dense_residuals(system, x, rhs), sums, x, rhs)


@dataclass(frozen=True)
class Regular:
    """A square symmetric system whose rank is beyond doubt: the factor of the system scaled from both sides."""

    factor: Cholesky | Ldlt
    scale: np.ndarray
    condition: float

    @property
    def inertia(self) -> tuple[int, int, int] | None:
        return self.factor.inertia() if isinstance(self.factor, Ldlt) else None

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.scale * self.factor.solve(self.scale * b)


def regular(system: np.ndarray, factorization: str, options: SolveOptions) -> Regular:
    """Rank and condition first, then the factor; of a large system the factor tells of them."""
    n = len(system)
    options.require_memory(n)
    scale = 1 / np.sqrt(np.maximum(np.abs(system).max(axis=1, initial=0), 1e-300))
    scaled = system * scale * scale[:, None]
    factor = factor_of(scaled, factorization) if factorization == "cholesky" or n > LARGE else None
    condition = require_regular(scaled, factor, options)
    if options.condition_limit is not None and condition > options.condition_limit:
        raise ConditioningError("the condition is beyond its limit", condition=condition, limit=options.condition_limit)
    return Regular(factor or factor_of(scaled, factorization), scale, condition)


def refined(x: np.ndarray, change: Callable[[np.ndarray], np.ndarray], most: int) -> tuple[np.ndarray, int]:
    """x after steps of refinement, as long as each is less than half of the one before, and how many there were."""
    before = np.inf
    for steps in range(most):
        move = change(x)
        size = np.abs(move).max(initial=0)
        if not size < before / 2:
            return x, steps
        x, before = x + move, size
        if size <= EPS * np.abs(x).max(initial=0):
            return x, steps + 1
    return x, most


def solve_system(system: np.ndarray, rhs: np.ndarray, factorization: str, options: SolveOptions) -> Solved:
    """One square symmetric system: rank and condition first, then a factor, steps of refinement with residuals in long
    doubles, and the residual, by sums that are exact or whose rounding is bounded, within 128 n eps."""
    made = regular(system, factorization, options)
    x, steps = refined(made.solve(rhs), lambda v: made.solve(long_residuals(system, v, rhs)), options.refinements)
    backward = backward_error(system, x, rhs)
    if not backward <= 128 * len(rhs) * EPS:
        raise ConditioningError("the residual is too large", backward_error=backward)
    return Solved(x, backward, made.condition, made.inertia, steps)


def solve(k: np.ndarray, p: np.ndarray, y: np.ndarray, options: SolveOptions = SolveOptions()) -> Solved:
    """Weights and polynomial coefficients of a kernel matrix with polynomial columns p."""
    n, m = p.shape
    k = options.regularized(k)
    if not m:
        return solve_system(k, y, "cholesky" if options.factorization == "auto" else options.factorization, options)
    z, projected = _checked(k, p)
    require_definite(projected, n)
    if options.route == "augmented":
        if options.factorization == "cholesky":
            raise InputError("a system with a polynomial is not definite")
        system = np.block([[k, p], [p.T, np.zeros((m, m))]])
        return solve_system(system, np.concatenate([y, np.zeros(m)]), "ldlt", options)
    inner = regular(projected, "cholesky" if options.factorization == "auto" else options.factorization, options)
    basis = np.linalg.qr(p)[0]

    def change(w: np.ndarray) -> np.ndarray:
        left = long_residuals(k, w, y)
        return z.expand(inner.solve(z.reduce(left - basis @ (basis.T @ left))))

    w, steps = refined(z.expand(inner.solve(z.reduce(y))), change, options.refinements)
    rows = np.repeat(np.arange(m), n)
    moments = np.array([float(s) for s in exact.sums_of_products(rows, p.T.ravel(), np.tile(w, m), m)])
    if (np.abs(moments) > 64 * n * EPS * (np.abs(p).T @ np.abs(w) + 1e-300)).any():
        raise ConditioningError("the weights are not across the polynomial", moment=float(np.abs(moments).max()))
    c = np.linalg.lstsq(p, long_residuals(k, w, y), rcond=None)[0]
    backward = backward_error(np.hstack([k, p]), np.concatenate([w, c]), y)
    if not backward <= 128 * (n + m) * EPS:
        raise ConditioningError("the residual is too large", backward_error=backward)
    return Solved(np.concatenate([w, c]), backward, inner.condition, inner.inertia, steps)
