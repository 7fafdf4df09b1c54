"""Exact sums, sparse and indefinite factors, ranks and null spaces."""

import time
from fractions import Fraction

import numpy as np
import pytest

from fieldspark.errors import ConditioningError, InputError, MemoryLimitError, RankError
from fieldspark.functions import exact
from fieldspark.functions.kernels import Kernel
from fieldspark.operators import densefactor, fields, sparsefactor
from fieldspark.operators.densefactor import SolveOptions
from fieldspark.plans import catalog


def test_sums_of_products_are_exact_whatever_the_scale():
    rng = np.random.default_rng(0)
    for powers in ((-3, 3), (-300, 300), (-1070, -1000), (900, 1020)):
        a, b = (rng.standard_normal(400) * 2.0 ** rng.integers(*powers, 400) for _ in range(2))
        rows = rng.integers(0, 7, 400)
        wanted = [sum((Fraction(x) * Fraction(y) for x, y, r in zip(a, b, rows) if r == k), Fraction(0)) for k in range(7)]
        assert exact.sums_of_products(rows, a, b, 7) == wanted
    assert exact.sums_of_products(np.array([0, 0, 1]), np.array([5e-324, -0.0, 1e308]), np.array([5e-324, 1.0, 1e308]), 3) == [Fraction(5e-324) ** 2, Fraction(1e308) ** 2, 0]


def test_residuals_of_ill_scaled_systems_are_those_of_fractions():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((12, 12)) * 10.0 ** rng.integers(-80, 80, (12, 12))
    x = rng.standard_normal(12) * 10.0 ** rng.integers(-60, 60, 12)
    b = a @ x
    wanted = [float(Fraction(t) - sum(Fraction(p) * Fraction(q) for p, q in zip(row, x))) for row, t in zip(a, b)]
    assert exact.dense_residuals(a, x, b, most=30).tolist() == wanted and any(wanted)


def test_sparse_factors_equal_dense_ones():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 120):
        a = rng.standard_normal((n, n)) * (rng.random((n, n)) < 3 / n)
        a = a @ a.T + np.eye(n)
        rows, columns = np.nonzero(a)
        factor = sparsefactor.factorize(n, rows, columns, a[rows, columns])
        lower = np.zeros((n, n))
        for k, (below, values) in enumerate(zip(factor.symbolic.columns, factor.values)):
            lower[k, k] = factor.diagonal[k]
            lower[below, k] = values
            assert factor.symbolic.parent[k] == (below[0] if len(below) else -1)
        order = factor.symbolic.order
        assert np.allclose(lower, np.linalg.cholesky(a[np.ix_(order, order)]))
        b = rng.standard_normal(n)
        assert np.allclose(factor.solve(b), np.linalg.solve(a, b))


def test_least_degree_has_no_fill_on_trees_and_little_on_grids():
    n = 200
    tree = np.array([(k, (k - 1) // 3) for k in range(1, n)])
    rows, columns = np.concatenate([tree, tree[:, ::-1]]).T
    assert sparsefactor.least_degree(n, rows, columns).entries == 2 * n - 1
    side = 20
    grid = np.arange(side * side).reshape(side, side)
    pairs = np.concatenate([np.stack([grid[1:].ravel(), grid[:-1].ravel()], 1), np.stack([grid[:, 1:].ravel(), grid[:, :-1].ravel()], 1)])
    rows, columns = np.concatenate([pairs, pairs[:, ::-1]]).T
    assert sparsefactor.least_degree(side * side, rows, columns).entries < 0.6 * side**3  # row by row it is side^3
    with pytest.raises(MemoryLimitError):
        sparsefactor.least_degree(side * side, rows, columns, most=1000)


def test_components_are_solved_side_by_side(spark):
    points = spark.createDataFrame([(0, 0.0, 11 / 8), (1, 1.0, 11 / 4), (2, 2.0, 27 / 8), (7, 50.0, 4.0), (9, 90.0, 1.0), (8, 91.0, 2.0)], "idx long, x0 double, y double")
    found = {r["idx"]: r for r in sparsefactor.fit_factored(points, Kernel("wendland_c2", 2.0), 1).collect()}
    assert [found[k]["w"] for k in (0, 1, 2)] == pytest.approx([1.0, 2.0, 3.0], abs=1e-14)
    assert {k: r["component"] for k, r in found.items()} == {0: 0, 1: 0, 2: 0, 7: 7, 8: 8, 9: 8}
    assert found[0]["entries"] == 5 and found[7]["w"] == 4.0
    empty = spark.createDataFrame([], "idx long, x0 double, y double")
    assert sparsefactor.fit_factored(empty, Kernel("wendland_c2", 2.0), 1).count() == 0


def test_indefinite_and_singular_systems_are_refused(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "i long, j long, v double")
    rhs = spark.createDataFrame([(0, 1.0), (1, 1.0)], "idx long, y double")
    for matrix in (rows((0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0)), rows((0, 0, 1.0)), rows((0, 0, 1.0), (1, 1, -1.0))):
        with pytest.raises(Exception, match=ConditioningError.__name__):
            sparsefactor.solve_factored(matrix, rhs).collect()


def test_indefinite_factors():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 40):
        for empty_diagonal in (False, True):
            a = rng.standard_normal((n, n))
            a = a + a.T
            if empty_diagonal and n > 1:
                np.fill_diagonal(a, 0.0)
            factor = densefactor.ldlt(a)
            d, at = np.zeros((n, n)), 0
            for block in factor.blocks:
                d[at : at + len(block), at : at + len(block)] = block
                at += len(block)
            assert np.allclose(factor.lower @ d @ factor.lower.T, a[np.ix_(factor.order, factor.order)])
            values = np.linalg.eigvalsh(a)
            assert factor.inertia() == ((values > 0).sum(), (values < 0).sum(), 0)
            b = rng.standard_normal(n)
            assert np.allclose(factor.solve(b), np.linalg.solve(a, b))
    assert any(len(b) == 2 for b in densefactor.ldlt(np.array([[0.0, 1.0], [1.0, 0.0]])).blocks)
    assert densefactor.ldlt(np.zeros((2, 2))).inertia() == (0, 0, 2)


def test_ranks_by_two_methods():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 4))
    assert densefactor.decide_rank(a).decision == "full"
    assert np.allclose(densefactor.pivoted_diagonal(a).prod(), np.prod(np.linalg.svd(a)[1]))
    a[:, 3] = a[:, 0]
    review = densefactor.decide_rank(a)
    assert (review.decision, review.svd_rank, review.qr_rank) == ("deficient", 3, 3)
    a[:, 3] += rng.standard_normal(30) * review.threshold / 4
    assert densefactor.decide_rank(a).decision == "ambiguous"
    with pytest.raises(RankError):
        densefactor.null_space(a)


@pytest.mark.parametrize("n", [60, 3600])
def test_places_off_a_line_by_the_threshold_are_ambiguous_at_any_number(spark, tmp_path, n):
    rows = spark.range(1, 3 * n + 1).selectExpr("id * 25 as c_custkey", "cast(id % 3 as int) as c_nationkey", "pmod(id * 7919, 10007) / 1.0D as c_acctbal")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    found = sorted(map(tuple, catalog.cpd_rank(spark, str(tmp_path)).collect()))
    assert found == [(0, "full", 3), (1, "deficient", 2), (2, "ambiguous", None)]


def test_null_space_and_augmented_routes_agree():
    rng = np.random.default_rng(5)
    x = rng.random((40, 2))
    r = np.linalg.norm(x[:, None] - x[None], axis=2)
    k, p, y = r**3, np.column_stack([np.ones(40), x]), rng.standard_normal(40)
    one, other = (densefactor.solve(k, p, y, SolveOptions(route=route)) for route in ("augmented", "null_space"))
    assert one.inertia == (40, 3, 0) and other.inertia is None
    assert one.found == pytest.approx(other.found, rel=1e-8)
    z = densefactor.null_space(p)
    assert exact.gram_defect(p, z) < 1e-14 and exact.gram_defect(z, z) < 1e-14
    assert (densefactor.energies(k, z) > 0).all()
    with pytest.raises(ConditioningError):
        densefactor.solve(-k, p, y)
    with pytest.raises(InputError):
        densefactor.energies(k + np.triu(np.ones((40, 40)), 1), z)
    with pytest.raises(InputError):
        densefactor.solve(k, p, y, SolveOptions(factorization="cholesky"))


def test_large_systems_are_solved_to_the_last_digits_and_soon():
    rng = np.random.default_rng(9)
    n = 2 * densefactor.LARGE
    x = np.sort(rng.choice(25 * n, n, replace=False)).astype(float)
    y, p = rng.standard_normal(n) * 5, np.ones((n, 1))
    k = -np.abs(x[:, None] - x)
    slope = np.diff(y) / np.diff(x)
    wanted = (np.insert(slope, 0, 0.0) - np.append(slope, 0.0)) / 2
    began = time.perf_counter()
    for options in (SolveOptions(), SolveOptions(route="null_space")):
        made = densefactor.solve(k, p, y, options)
        assert np.abs(made.found[:n] - wanted).max() < 1e-13 * np.abs(wanted).max()
        assert made.inertia in ((n, 1, 0), None) and made.backward_error <= 128 * n * densefactor.EPS
    values = densefactor.polynomial_energies(k, p)
    assert len(values) == n - 1 and values.min() > 0 and values.sum() == pytest.approx(-k.sum() / n)
    assert time.perf_counter() - began < 60
    with pytest.raises(ConditioningError):
        densefactor.solve(-k, p, y)
    k[1], k[:, 1] = k[0], k[:, 0]
    with pytest.raises((RankError, ConditioningError)):
        densefactor.solve(k, p, y)


def test_reflections_are_the_null_space():
    rng = np.random.default_rng(10)
    p, k = np.column_stack([np.ones(50), rng.random((50, 2))]), rng.standard_normal((50, 50))
    k += k.T
    z, own = densefactor.null_space(p), densefactor.complement(p)[0]
    v = rng.standard_normal(47)
    assert own.expand(v) == pytest.approx(z @ v) and own.reduce(k[0]) == pytest.approx(z.T @ k[0]) and own.project(k) == pytest.approx(z.T @ k @ z)


def test_panels_of_indefinite_factors():
    rng = np.random.default_rng(11)
    for n in (63, 64, 65, 200):
        a = rng.standard_normal((n, n))
        a += a.T
        np.fill_diagonal(a, np.where(rng.random(n) < 0.5, 0.0, np.diag(a)))
        factor, b = densefactor.ldlt(a), rng.standard_normal(n)
        values = np.linalg.eigvalsh(a)
        assert factor.inertia() == ((values > 0).sum(), (values < 0).sum(), 0)
        assert np.allclose(a @ factor.solve(b), b) and np.abs(factor.lower).max() < 1e3


def test_options():
    k, y, none = np.array([[2.0, 1.0], [1.0, 2.0]]), np.array([3.0, 4.0]), np.zeros((2, 0))
    assert densefactor.solve(k, none, y, SolveOptions(regularization=1.0)).found == pytest.approx(np.linalg.solve(k + np.eye(2), y))
    assert densefactor.solve(k, none, y, SolveOptions(factorization="ldlt")).inertia == (2, 0, 0)
    for options, error in ((SolveOptions(condition_limit=2.9), ConditioningError), (SolveOptions(memory_limit=100), MemoryLimitError), (SolveOptions(regularization=1e-30), InputError)):
        with pytest.raises(error):
            densefactor.solve(k, none, y, options)
    with pytest.raises(InputError):
        SolveOptions(factorization="lu")


def test_few_centers_are_expressions(spark):
    field = fields.FittedField(Kernel("gaussian", 1.5), np.array([[0.0, 1.0], [2.0, 0.5]]), np.array([1.0, -2.0]), np.empty(0))
    assert field.by_expressions(2) and not field.by_expressions(2) == fields.FittedField(Kernel("gaussian", 1.5), np.zeros((5, 2)), np.zeros(5), np.empty(0)).by_expressions(2)
    points = spark.createDataFrame([(0.3, 0.4)], "x0 double, x1 double")
    found = field.evaluate(points, order=2).first()
    assert [found[n] for n in field.names(2)] == pytest.approx(field.numbers(np.array([[0.3, 0.4]]), 2)[0].tolist())


def test_signs_of_minors_are_exact():
    rng = np.random.default_rng(6)
    assert exact.leading_signs(np.array([[2.0, 1.0], [1.0, 0.5]])) == [1, 0]
    assert exact.leading_signs(np.array([[0.0, 1.0], [1.0, 0.0]])) == [0, 0]
    for _ in range(40):
        a = rng.integers(-5, 6, (3, 3)).astype(float)
        a = (a + a.T) * 2.0 ** rng.integers(-400, 400)
        f = [[Fraction(x) for x in row] for row in a]
        minors = [f[0][0], f[0][0] * f[1][1] - f[0][1] * f[1][0]]
        minors.append(sum(f[0][i] * (f[1][(i + 1) % 3] * f[2][(i + 2) % 3] - f[1][(i + 2) % 3] * f[2][(i + 1) % 3]) for i in range(3)))
        wanted = [(v > 0) - (v < 0) for v in minors]
        end = wanted.index(0) + 1 if 0 in wanted else 3  # elimination stops at a minor of 0
        assert exact.leading_signs(a)[:end] == wanted[:end]
        assert exact.definite(a[None])[0] == all(w > 0 for w in wanted)
    near = np.array([[[9e7**2, 9e7 * 9.1e7], [9e7 * 9.1e7, 9.1e7**2 + s]] for s in (-1.0, 0.0, 1.0)])
    assert exact.definite(near).tolist() == [False, False, True]
    assert not exact.definite(np.array([[[np.nan, 0.0], [0.0, 1.0]]]))[0]


def test_jacobi_singular_values():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((50, 3, 3))
    assert exact.singular_values(a) == pytest.approx(np.linalg.svd(a, compute_uv=False))
    graded = np.array([np.diag([1e100, 1.0, 1e-100]) @ np.linalg.qr(rng.standard_normal((3, 3)))[0].T])
    assert exact.singular_values(graded.transpose(0, 2, 1))[0] == pytest.approx([1e100, 1.0, 1e-100])
    assert exact.singular_values(np.zeros((1, 2, 2))).tolist() == [[0.0, 0.0]]


def test_neighbours_with_far_outliers_and_points_at_one_place(spark):
    from fieldspark.operators import selection

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((400, 2)) * 1e-3, [[1e6, 1e6], [-1e6, 0.0], [5.0, 5.0], [5.0, 5.0]]])
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "idx int, x0 double, x1 double")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    found = {r.idx: r.nearest for r in selection.nearest_distances(rows, 2).collect()}
    assert [found[k] for k in range(len(x))] == pytest.approx(d.min(1).tolist())
    width = selection._cell_width(rows.where("idx < 403"), ["x0", "x1"], 2e6)
    fullest = rows.groupBy(*[(rows[c] / width).cast("long") for c in ("x0", "x1")]).count().agg({"count": "max"}).first()[0]
    assert width < 1e-3 and fullest <= 4 * selection.CELL_POINTS


def test_pairs_of_small_tables_are_dealt_over_tasks(spark):
    from fieldspark.operators import neighbors

    rng = np.random.default_rng(12)
    x, y = rng.random((300, 2)) * 6, rng.random((40, 2)) * 6
    left, right = (spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rows)], "idx long, x0 double, x1 double").coalesce(1) for rows in (x, y))
    made = neighbors.within(left, right, 1.5, 2)
    d = np.linalg.norm(x[:, None] - y[None], axis=2)
    assert {(r.i, r.j): r.r for r in made.collect()} == {(i, j): pytest.approx(d[i, j]) for i, j in zip(*np.nonzero(d < 1.5))}
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
