"""Convex problems: solutions, multipliers, certificates and refusals."""

import numpy as np
import pandas as pd
import pytest

from fieldspark.errors import ConditioningError, InfeasibleError, InputError
from fieldspark.operators import conic, convex


def solved(p, q, a, b, zeros=0, lines=0, sizes=(), **options):
    shape = conic.Cones(zeros, lines, list(sizes))
    p, q, a, b = (np.array(v, float) for v in (p, q, a, b))
    found = conic.solve(p, q, a, b, shape, conic.Options(**options))
    assert convex.optimality(p, q, a, b, shape, found) < 1e-6
    return found.x


@pytest.mark.parametrize("bound", [1e3, 1e6, 1e9, 1e12])
@pytest.mark.parametrize("target", [0.005, 3.0, 700.0])
def test_bounds_far_away_do_not_blur_the_solution(bound, target):
    assert solved([[2]], [-2 * target], [[1], [-1]], [bound, 0], lines=2) == pytest.approx([target], rel=1e-7)


def test_three_four_five():
    assert solved(np.zeros((3, 3)), [0, 0, 1], [[1, 0, 0], [0, 1, 0], [0, 0, -1], [-1, 0, 0], [0, -1, 0]], [3, 4, 0, 0, 0], zeros=2, sizes=[3]) == pytest.approx([3, 4, 5])


def test_a_problem_without_inner_point_is_not_infeasible():
    assert solved([[2, 0], [0, 0]], [-10, 0], [[0, 1], [0, -1], [-1, 0]], [0, 0, 0], zeros=1, sizes=[2]) == pytest.approx([0, 0], abs=1e-9)


@pytest.mark.parametrize("far", [10.0, 4525 / 7, 4475 / 7, 51_428.0])
def test_a_cone_without_inner_point_beside_a_large_free_variable(far):
    for m in (9.97095, 4.54675, -0.15624, 0.0001):
        x = solved(np.diag([2.0, 2.0, 0.0]), [-2 * m, -2 * far, 0], [[0, 0, 1], [0, 0, -1], [-1, 0, 0]], [0, 0, 0], zeros=1, sizes=[2])
        assert x == pytest.approx([0, far, 0], abs=1e-9, rel=1e-12)


def test_certificates():
    square = np.array([[2.0, 0.0], [0.0, 0.0]])
    excluded = [
        (square, [0, 0], [[0, 1], [-1, 0], [0, -1], [-1, 0]], [1, -2, 0, 0], 0, 2, [2]),  # |x| <= t <= 1, x >= 2
        ([[2]], [0], [[1], [-1]], [1e9, -1e9 - 10], 0, 2, []),
        ([[2]], [0], [[1], [1], [1]], [5, 6, 100], 2, 1, []),
        (square, [0, 0], [[0, 1], [0, -1], [-1, 0]], [-1, 0, 0], 1, 0, [2]),  # |x| <= t = -1
    ]
    for case in excluded:
        with pytest.raises(InfeasibleError):
            solved(*case)
    with pytest.raises(ConditioningError):
        solved([[0]], [1], [[1]], [1], lines=1)
    with pytest.raises(InputError):
        conic.Options(tolerance=0.0)


def test_a_certificate_excludes_a_radius_and_nothing_without_a_dual_point():
    a, b, shape = np.array([[1.0], [-1.0]]), np.array([1.0, -2.0]), conic.Cones(0, 2, [])
    assert conic.excluded_radius(a, b, shape, np.array([1.0, 1.0])) > 1e200
    assert conic.excluded_radius(a, b, shape, np.array([1.0, 1.0 + 1e-3])) == pytest.approx(1.002e3)
    assert conic.excluded_radius(a, b, shape, np.array([1.0, -1.0])) == 0.0
    assert conic.excluded_radius(a, b, shape, np.zeros(2)) == 0.0


def test_random_boxes_meet_their_conditions():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        m = rng.standard_normal((n, n))
        p, q = m @ m.T * 10.0 ** rng.integers(-3, 3), rng.standard_normal(n) * 10.0 ** rng.integers(-3, 3)
        low, high = (rng.random(n) * 10.0 ** rng.integers(-2, 7, n) for _ in range(2))
        x = solved(p, q, np.vstack([np.eye(n), -np.eye(n)]), np.concatenate([high, low]), lines=2 * n)
        moved = np.clip(x - (p @ x + q) / np.abs(p).max(), -low, high) - x
        assert np.abs(moved).max() <= 1e-6 * max(1e-3, np.abs(x).max())


def test_scalings_and_products_of_cones():
    rng = np.random.default_rng(1)
    shape = conic.Cones(2, 3, [4, 2])
    s, z = (np.concatenate([np.zeros(2), rng.random(3) + 0.1, [3.0], rng.standard_normal(3) / 2, [1.0, 0.5]]) for _ in range(2))
    w = conic.Scaling(shape, s, z)
    assert w.apply(z) == pytest.approx(w.inverse(s))
    assert w.inverse(w.apply(z))[2:] == pytest.approx(z[2:])
    u = w.apply(z)
    assert shape.product(u, shape.divided(u, s))[2:] == pytest.approx(s[2:])
    d = rng.standard_normal(shape.size) * 5
    most = shape.length(s, d)
    assert shape.margin(s + 0.999 * most * d) > 0 and (most == 1.0 or shape.margin(s + 1.001 * most * d) < 0)


def test_options_reach_the_solver(spark):
    rows = pd.DataFrame([dict(problem_id=1, row=0, cls="soft", var=0, coef=1.0, target=2.0, lower=None, upper=None, scale=1.0, loss="l2", delta=0.75), dict(problem_id=1, row=1, cls="bound", var=0, coef=1.0, target=None, lower=None, upper=1.0, scale=1.0, loss="l2", delta=0.75)])
    rows = spark.createDataFrame(rows, "problem_id long, row long, cls string, var long, coef double, target double, lower double, upper double, scale double, loss string, delta double")
    assert convex.solve_problems(rows).first()["value"] == pytest.approx(1.0)
    assert convex.problem_status(rows, conic.Options(most=1)).first()["status"] == "unsolved"
