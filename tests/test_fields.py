"""Fields, kernels and geometry against literal truths, finite differences and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark import errors
from fieldspark.functions import polynomials
from fieldspark.functions.kernels import FAMILIES, Anisotropy, Kernel, jet
from fieldspark.functions.mixing import plain, splitmix64, times
from fieldspark.operators import convex, fields, levels, levelsets, neighbors, selection

PARAMETER = {"phs": 4.0, "wendland_c2": 2.5, "wendland_c4": 2.5, "wendland_c6": 2.5}


@pytest.mark.parametrize("family", FAMILIES)
def test_radial_derivatives(family):
    for parameter in (2, 3, 4, 5) if family == "phs" else (PARAMETER.get(family, 1.7),):
        kernel, r, h = Kernel(family, parameter), np.linspace(0.2, 2.3, 9), 1e-5
        parts = kernel.radial(r)
        for low, high in (("phi", "d1"), ("d1", "d2"), ("d2", "d3")):
            assert (kernel.radial(r + h)[low] - kernel.radial(r - h)[low]) / (2 * h) == pytest.approx(parts[high], rel=2e-6, abs=2e-7)
        assert parts["a"] == pytest.approx(parts["d1"] / r) and parts["b"] == pytest.approx((parts["d2"] - parts["a"]) / r)


def test_literal_values():
    assert Kernel("gaussian", 1.7).radial(np.array([0.73]))["phi"][0] == pytest.approx(0.91192527111318645, rel=1e-15)
    for family, value in (("wendland_c2", 0.33696), ("wendland_c4", 0.2457216), ("wendland_c6", 0.17212704768)):
        assert Kernel(family, 2.5).radial(np.array([1.0]))["phi"][0] == pytest.approx(value, rel=5e-15)
        assert Kernel(family, 2.5).radial(np.array([2.5, 9.0]))["phi"].tolist() == [0, 0]


def test_columns_and_arrays_agree(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.3, -1.2), (2.0, 0.5)], "x0 double, x1 double")
    a = Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (5.0, 2.0))
    for family in FAMILIES:
        if family == "matern12":
            continue
        kernel = Kernel(family, PARAMETER.get(family, 1.7))
        made = jet(kernel, [F.col("x0"), F.col("x1")], 2, a)
        got = rows.select(made["value"], *made["g"], *[h for row in made["h"] for h in row]).toPandas().to_numpy()
        x = rows.toPandas().to_numpy()
        same = jet(kernel, [x[:, 0], x[:, 1]], 2, a)
        wanted = np.stack([same["value"], *same["g"], *[h for row in same["h"] for h in row]], 1)
        assert got == pytest.approx(wanted, abs=1e-14)


def test_wrong_parameters():
    for bad in (lambda: Kernel("none"), lambda: Kernel("gaussian", 0), lambda: Kernel("phs", 1.5), lambda: Kernel.surface_spline(3, 1)):
        with pytest.raises(errors.InputError):
            bad()
    with pytest.raises(errors.CapabilityError):
        Kernel("matern12").require(1)
    with pytest.raises(errors.InputError):
        Anisotropy(((1.0, 1.0), (1.0, 1.0)))


def test_polynomial_order():
    assert polynomials.exponents(2, 3) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    assert len(polynomials.exponents(3, 8)) == 120


def centers(spark, rows, dimension):
    names = ", ".join(f"x{k} double" for k in range(dimension))
    return spark.createDataFrame([(f, i, *x, y) for f, i, x, y in rows], f"field_id long, idx int, {names}, y double")


def test_fit_two_fields_at_once(spark):
    rows = [(f, i, (x,), 1 + 2 * x + 3 * x * x + f) for f in (1, 2) for i, x in enumerate((-1.0, 0.0, 2.0, 3.0))]
    made = fields.fit(centers(spark, rows, 1), Kernel("phs", 4), 1).toPandas().sort_values(["field_id", "role", "idx"])
    for f in (1, 2):
        own = made[made.field_id == f]
        assert own[own.role == "center"].value.abs().max() < 1e-10
        assert own[own.role == "poly"].value.tolist() == pytest.approx([1 + f, 2, 3])


def test_expressions_and_blocks_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (20, 2))
    field = fields.FittedField(Kernel("phs", 5), x, rng.normal(size=20), rng.normal(size=6), Anisotropy.isotropic(2, 0.7))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(-1, 1, (30, 2))] + [(None, 1.0)], "x0 double, x1 double")
    by_spark = field.evaluate(points, order=2).toPandas()
    fields.EXPRESSION_CENTERS, before = 0, fields.EXPRESSION_CENTERS
    try:
        by_numpy = field.evaluate(points, order=2).toPandas()
    finally:
        fields.EXPRESSION_CENTERS = before
    assert by_numpy[:-1].to_numpy() == pytest.approx(by_spark[:-1].to_numpy(), rel=1e-9, abs=1e-9)
    assert by_spark.f.isna().sum() == by_numpy.f.isna().sum() == 1


def test_refusals():
    with pytest.raises(errors.ConditioningError):
        fields.solve_dense(np.array([[1.0, 2.0], [2.0, 1.0]]), np.zeros((2, 0)), np.zeros(2))
    with pytest.raises(errors.RankError):
        fields.null_space(np.array([[1.0, 2.0], [1.0, 2.0], [1.0, 2.0]]))
    found, _ = fields.solve_dense(np.array([[4.0, 1.0], [1.0, 3.0]]), np.zeros((2, 0)), np.array([6.0, 7.0]))
    assert found == pytest.approx([1, 2], rel=1e-14)


def test_sparse_truth(spark):
    rows = spark.createDataFrame([(0, 0.0, 11 / 8), (1, 1.0, 11 / 4), (2, 2.0, 27 / 8)], "idx long, x0 double, y double")
    kernel = Kernel("wendland_c2", 2.0)
    assert neighbors.sparse_matrix(rows, kernel, 1).count() == 7
    assert [r.w for r in neighbors.fit_sparse(rows, kernel, 1).orderBy("idx").collect()] == pytest.approx([1, 2, 3])


def test_selection_truths(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate((0.0, 1.0, 3.0, 10.0))], "idx long, x0 double")
    assert [r.idx for r in selection.select_farthest(rows, 1, 3).orderBy("nth").collect()] == [0, 3, 2]
    ties = np.arange(3, dtype=np.uint64)
    assert [i for i, _ in selection.greedy(np.eye(3), np.array([0.25, -5.0, 2.0]), 2, "residual", ties)] == [1, 2]
    assert selection.greedy(np.diag([1.0, 4.0, 9.0]), np.zeros(3), 3, "power", ties) == [(2, 9.0), (1, 4.0), (0, 1.0)]
    assert selection.nearest_distances(rows, 1).agg(F.sum("nearest")).first()[0] == pytest.approx(1 + 1 + 2 + 7)


def test_splitmix(spark):
    numbers = [0, 1, -1, 2**62, -(2**63), 0x5EED, 123456789123456789]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", splitmix64(F.col("n")).alias("z"), times(F.col("n"), 0x94D049BB133111EB).alias("t")).collect()
    for r in got:
        assert r.z % 2**64 == plain(r.n % 2**64)
        assert r.t % 2**64 == (r.n * 0x94D049BB133111EB) % 2**64


def problem(spark, rows):
    return spark.createDataFrame(rows, "problem_id long, row int, cls string, var long, coef double, target double, lower double, upper double, scale double, loss string, delta double")


def test_quadratic_programme(spark):
    """x + y = 2, x at most 1.2, x near 1 and y near 2: (0.5, 1.5); and an absolute and a Huber term."""
    rows = [(1, 0, "eq", 0, 1.0, 2.0, None, None, None, None, None), (1, 0, "eq", 1, 1.0, 2.0, None, None, None, None, None)]
    rows += [(1, 1 + v, "bound", v, 1.0, None, 0.0, (1.2, 2.0)[v], None, None, None) for v in (0, 1)]
    rows += [(1, 3 + v, "soft", v, 1.0, (1.0, 2.0)[v], None, None, 1.0, "l2", None) for v in (0, 1)]
    rows += [(2, k, "soft", 0, 1.0, t, None, None, 1.0, "l1", None) for k, t in enumerate((1.0, 2.0, 9.0))]
    rows += [(3, 0, "soft", 0, 1.0, 4.0, None, None, 1.0, "huber", 1.0), (3, 1, "soft", 0, 1.0, 0.0, None, None, 1.0, "huber", 1.0), (3, 2, "soft", 0, 1.0, 0.5, None, None, 1.0, "huber", 1.0)]
    got = {(r.problem_id, r["var"]): r.value for r in convex.solve_problems(problem(spark, rows)).collect()}
    assert [got[1, 0], got[1, 1], got[2, 0]] == pytest.approx([0.5, 1.5, 2.0], abs=1e-5)
    assert got[3, 0] == pytest.approx(0.75, abs=1e-5)
    with pytest.raises(Exception, match="1001"):
        convex.solve_problems(problem(spark, [(1, 0, "nonsense", 0, 1.0, 3.0, None, None, None, None, None)])).collect()
    with pytest.raises(Exception, match="6001"):
        convex.solve_problems(problem(spark, [(1, 0, "eq", 0, 1.0, 3.0, None, None, None, None, None), (1, 1, "bound", 0, 1.0, None, 0.0, 1.0, None, None, None)])).collect()


def test_cones_and_certificates(spark):
    """x = 3 and y = 4 within |(x, y)| <= z, z near 0: 3-4-5; a cone that a bound excludes; repeated rows."""
    soft = (1, 9, "soft", 2, 1.0, 0.0, None, None, 1.0, "l1", None, None)
    rows = [(1, v, "eq", v, 1.0, (3.0, 4.0)[v], None, None, None, None, None, None) for v in (0, 1)] + [soft]
    rows += [(1, 3 + k, "cone", v, 1.0, None, None, None, None, None, None, 7) for k, v in enumerate((2, 0, 1))]
    frame = lambda rows: spark.createDataFrame(rows, problem(spark, []).schema.simpleString()[7:-1].replace(":", " ") + ", cone long")
    got = {r["var"]: r.value for r in convex.solve_problems(frame(rows)).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([3, 4, 5], abs=1e-5)
    out = [*rows, (1, 20, "bound", 2, 1.0, None, None, 4.5, None, None, None, None)]
    status = {r.problem_id: r for r in convex.problem_status(frame(rows).union(frame(out).withColumn("problem_id", F.lit(2).cast("long")))).collect()}
    assert status[1].status == "solved" and status[1].objective == pytest.approx(5, abs=1e-5) and status[2].status == "infeasible" and status[2].objective is None
    twice = [(3, k, "eq", 0, 1.0, 2.0, None, None, None, None, None, None) for k in (0, 1)]
    assert convex.solve_problems(frame(twice)).first().value == pytest.approx(2)


def test_levels(spark):
    given = spark.createDataFrame([(10, 0, "fixed", 0.0, None), (20, 1, "unknown", None, None), (30, 2, "prior", None, 2.0)], "level_id long, ord int, kind string, value double, mean double")
    orders = spark.createDataFrame([(10, 20, 0.5), (20, 30, 0.75)], "lower_id long, upper_id long, min_gap double")
    members = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "level_id long, obs_id long")
    levels.validate(given, members, orders)
    assert {r.level_id: r.height for r in levels.topological_depth(given, orders).collect()} == {10: 0.0, 20: 0.5, 30: 1.25}
    with pytest.raises(errors.InfeasibleError):
        levels.validate(given, members, orders.union(spark.createDataFrame([(30, 10, 0.0)], orders.schema)))
    with pytest.raises(errors.GaugeError):
        levels.validate(given.union(spark.createDataFrame([(40, 3, "unknown", None, None)], given.schema)), members, orders)


def test_level_points(spark):
    found = levelsets.level_points(spark, lambda x: x[0] * x[0] + x[0] - 2.0, 0.0, -4.0, 4.0, 8).orderBy("x").collect()
    assert [r.x for r in found] == pytest.approx([-2, 1]) and {r.kind for r in found} == {"crossing"}


def drawn(spark, f, low, high, cells, method="squares", level=0.0):
    nodes = levelsets.grid_nodes(spark, f, level, low, high, cells)
    return levelsets.segments(nodes, levelsets.edge_crossings(nodes, f, level, diagonals=method == "simplices"), method)


def test_saddle_cells(spark):
    """The corners that share the decider's sign are connected, the positive ones where saddle and center are 0."""
    for f in (lambda x: x[0] * x[1] + 0.2, lambda x: x[0] * x[1]):
        got = drawn(spark, f, (-1.0, -1.0), (1.0, 1.0), (1, 1)).collect()
        sides = lambda x, y: "bottom" if y == -1 else "top" if y == 1 else "left" if x == -1 else "right"
        assert {frozenset((sides(r.ax, r.ay), sides(r.bx, r.by))) for r in got} == {frozenset(("bottom", "right")), frozenset(("top", "left"))}


@pytest.mark.parametrize("method", ["squares", "simplices"])
def test_lines_in_order(spark, method):
    """An open line from side to side, a circle, and two circles at once; a line through nodes."""
    made = levelsets.polylines(drawn(spark, lambda x: x[0] - 0.23, (-1.0, -1.0), (1.0, 1.0), (8, 8), method)).orderBy("seq").collect()
    assert [r.seq for r in made] == list(range(len(made))) and not any(r.closed for r in made)
    assert [r.y for r in made] == sorted((r.y for r in made), reverse=made[0].y > 0) and {round(r.x, 9) for r in made} == {0.23}
    rings = lambda x: ((x[0] - 2) ** 2 + x[1] ** 2 - 0.81) * ((x[0] + 2) ** 2 + x[1] ** 2 - 0.5)
    lines = levelsets.polylines(drawn(spark, rings, (-3.5, -1.5), (3.5, 1.5), (56, 24), method)).toPandas()
    assert lines.line.nunique() == 2 and lines.closed.all()
    for _, own in lines.sort_values("seq").groupby("line"):
        assert own.seq.tolist() == list(range(len(own))) and own.vid.iloc[0] == own.vid.min() == own.line.iloc[0]
        assert own.vid.iloc[1] < own.vid.iloc[-1]
        step = np.hypot(np.diff(own.x, append=own.x.iloc[0]), np.diff(own.y, append=own.y.iloc[0]))
        assert step.max() < 0.2
    with pytest.raises(errors.InputError):
        drawn(spark, lambda x: x[0], (-1.0, -1.0), (1.0, 1.0), (2, 2), method)
    corner = levelsets.polylines(drawn(spark, lambda x: x[0] + x[1], (-1.0, -1.0), (1.0, 1.0), (2, 2))).orderBy("seq").collect()
    assert [(r.x, r.y) for r in corner] in ([(-1, 1), (0, 0), (1, -1)], [(1, -1), (0, 0), (-1, 1)])
    crossing = levelsets.line_summary(levelsets.polylines(drawn(spark, lambda x: x[0] - 0.23, (-1.0, -1.0), (1.0, 1.0), (8, 8), method))).first()
    assert crossing.segments == crossing.vertices - 1


def test_touching_points(spark):
    f, slope = (lambda x: (x[0] - 0.3) ** 2 * (x[0] + 1.1)), (lambda x: 2 * (x[0] - 0.3) * (x[0] + 1.1) + (x[0] - 0.3) ** 2)
    found = levelsets.level_points(spark, f, 0.0, -2.0, 2.0, 16, tolerance=1e-9, slope=slope, width=1e-4).orderBy("x").collect()
    assert [(round(r.x, 4), r.kind) for r in found] == [(-1.1, "crossing"), (0.3, "stationary")]
    ends = levelsets.level_points(spark, lambda x: x[0] ** 2 - 4.0, 0.0, -2.0, 2.0, 3).collect()
    assert {r.kind for r in ends} == {"boundary"} and len(ends) == 2
    with pytest.raises(errors.InputError):
        levelsets.level_points(spark, f, 0.0, 1.0, 1.0, 4)


def test_thickness_failures(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, None), (3, 50.0)], "idx int, x double")
    got = {r.idx: (r.thickness, r.failure) for r in levelsets.thickness(rows, ["x"], lambda x: x[0] ** 2, lambda x: [2 * x[0]], (0.25, 4.0), 5.0, 20).collect()}
    assert got[0] == (None, "gradient") and got[2] == (None, None) and got[3] == (None, "not_found") and got[1][0] == pytest.approx(1.5)
    rough = levelsets.thickness(rows.where("idx = 1"), ["x"], lambda x: x[0] ** 2, lambda x: [2 * x[0]], (0.26, 4.1), 5.0, 20, halvings=3).first()
    assert rough.failure == "refinement_limit"
    assert levelsets.thickness_report(rows.select(F.lit(None).cast("double").alias("thickness"), F.lit("gradient").alias("failure")), 1.0, [0.5]).first().q0 is None
