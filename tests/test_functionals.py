"""Functionals, fits to derivatives, third derivatives, frames, projects, trends and tuning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark import errors
from fieldspark.functions import geometry
from fieldspark.functions.kernels import FAMILIES, Anisotropy, Kernel, jet
from fieldspark.operators import fields, functionals, projects, selection, tensors, trends

PARAMETER = {"phs": 5.0, "wendland_c2": 3.0, "wendland_c4": 3.0, "wendland_c6": 3.0}


@pytest.mark.parametrize("family", [f for f in FAMILIES if f != "matern12"])
def test_third_derivatives(family):
    rng = np.random.default_rng(1)
    kernel, a = Kernel(family, PARAMETER.get(family, 1.7)), Anisotropy(((0.7, 0.2, 0.0), (-0.1, 0.5, 0.3), (0.2, 0.0, 0.9)))
    d, h = list(rng.uniform(0.2, 0.8, (3, 5))), 1e-5
    t = jet(kernel, d, 3, a)["t"]
    for l in range(3):  # noqa: E741
        moved = [[c + (s * h if k == l else 0) for k, c in enumerate(d)] for s in (1, -1)]
        up, down = (jet(kernel, m, 2, a)["h"] for m in moved)
        for i in range(3):
            for j in range(3):
                assert (up[i][j] - down[i][j]) / (2 * h) == pytest.approx(t[i][j][l], rel=1e-5, abs=1e-7)
    if kernel.center_order >= 3:
        assert all(abs(float(np.max(x))) == 0 for p in jet(kernel, [np.zeros(1)] * 3, 3)["t"] for q in p for x in q)


def terms_of(spark, rows, dimension=2):
    names = ", ".join([f"x{k} double" for k in range(dimension)] + [f"u{k} double" for k in range(dimension)])
    return spark.createDataFrame(rows, f"field_id long, expr_id long, coef double, kind string, {names}")


@pytest.mark.parametrize("anisotropy", [None, Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (2.0, 1.0))])
def test_a_fit_takes_its_functionals(spark, anisotropy):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(9):
        x, u = rng.uniform(-1, 1, 2), rng.normal(size=2)
        rows.append((0, e, 1.0, "dderiv" if e % 3 else "value", *map(float, x), *(map(float, u) if e % 3 else (None, None))))
        if e % 4 == 1:
            rows.append((0, e, -0.5, "value", *map(float, rng.uniform(-1, 1, 2)), None, None))
    terms, y = terms_of(spark, rows), rng.normal(size=9)
    centers = spark.createDataFrame([(0, e, float(v)) for e, v in enumerate(y)], "field_id long, expr_id long, y double")
    field = functionals.fit_functional_field(centers, terms, Kernel("gaussian", 1.1), 2, anisotropy)
    found = np.zeros(9)
    for _, e, coef, kind, a, b, u, v in rows:
        value = field.numbers(np.array([[a, b]]), 1)[0]
        found[e] += coef * (value[0] if kind == "value" else value[1] * u + value[2] * v)
    assert found == pytest.approx(y, abs=1e-8)
    at, h = np.array([[0.3, -0.2]]), 1e-5
    whole = field.numbers(at, 2)[0]
    for k in range(2):
        step = np.eye(2)[k] * h
        assert (field.numbers(at + step, 1) - field.numbers(at - step, 1))[0] / (2 * h) == pytest.approx([whole[1 + k], whole[3 + k], whole[5 + k]], rel=1e-5, abs=1e-5)
    points = spark.createDataFrame([(0.3, -0.2), (None, 1.0)], "x0 double, x1 double")
    made = field.evaluate(points, order=2).collect()
    assert list(made[0])[2:] == pytest.approx(whole.tolist()) and made[1].f is None
    gram = functionals.apply_to_kernel(terms, terms, Kernel("gaussian", 1.1), 2, anisotropy).toPandas()
    k = np.zeros((9, 9))
    k[gram.i, gram.j] = gram.v
    assert np.abs(k - k.T).max() < 1e-12 and np.linalg.eigvalsh(k).min() > 0


def test_functionals_that_cannot_be(spark):
    rows = [(0, 0, 1.0, "dderiv", 0.0, 0.0, 1.0, 0.0), (0, 1, 1.0, "value", 1.0, 0.0, None, None)]
    centers = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "field_id long, expr_id long, y double")
    with pytest.raises(errors.CapabilityError):
        functionals.fit_functionals(centers, terms_of(spark, rows), Kernel("matern12"), 2)
    for bad in ((0, 0, 1.0, "dderiv", 0.0, 0.0, 0.0, 0.0), (0, 0, 1.0, "slope", 0.0, 0.0, 1.0, 0.0), (0, 0, float("nan"), "value", 0.0, 0.0, None, None)):
        with pytest.raises(errors.InputError):
            functionals.fit_functionals(centers, terms_of(spark, [bad, rows[1]]), Kernel("gaussian"), 2)
    with pytest.raises(errors.InputError, match="without"):
        functionals.fit_functionals(centers, terms_of(spark, rows[:1]), Kernel("gaussian"), 2)


def test_derivatives_off_the_centers(spark):
    field = fields.FittedField(Kernel("matern12", 2.0), np.array([[0.0], [1.0]]), np.array([1.0, -1.0]), np.empty(0))
    made = field.evaluate(spark.createDataFrame([(0.5,), (None,), (2.0,)], "x0 double"), order=1).collect()
    assert made[2].f_0 == pytest.approx((-np.exp(-1) + np.exp(-0.5)) / 2) and made[1].f_0 is None
    with pytest.raises(Exception, match="2001"):
        field.evaluate(spark.createDataFrame([(1.0,)], "x0 double"), order=1).collect()
    with pytest.raises(errors.CapabilityError):
        Kernel("matern12").require(4, away=True)


def test_frames_and_angles(spark):
    frame = geometry.Frame("metre", epsg=4326, axis_order=(1, 0))
    with pytest.raises(errors.InputError, match="epsg"):
        frame.require_same(geometry.Frame("metre", epsg=4327, axis_order=(1, 0)))
    for bad in (dict(length_unit=" ", epsg=1), dict(length_unit="m"), dict(length_unit="m", epsg=0), dict(length_unit="m", epsg=1, axis_order=(0, 0)), dict(length_unit="m", epsg=1, angle_unit="turns")):
        with pytest.raises(errors.InputError):
            geometry.Frame(**bad)
    rows = spark.createDataFrame([(1, 360.0, 90.0), (2, 0.0, float("nan")), (3, None, -0.0)], "id int, a double, b double")
    assert sorted((r.id, r.field) for r in geometry.angle_violations(rows, {"a": "full", "b": "dip"}, "id").collect()) == [(1, "a"), (2, "b"), (3, "a")]
    assert str(rows.where("id = 3").select(geometry.plus_zero(F.col("b"))).first()[0]) == "0.0"
    assert spark.range(1).select(geometry.axial(F.lit("unknown")), geometry.axial(F.lit("positive"))).first()[:] == (True, False)


def test_projects():
    field = fields.FittedField(Kernel("gaussian"), np.zeros((1, 1)), np.ones(1), np.empty(0))
    assert projects.Project((("a", field), ("b", field))).field("b") is field
    for bad in ((), (("", field),), (("a", field), ("a", field))):
        with pytest.raises(errors.InputError):
            projects.Project(bad)
    with pytest.raises(errors.InputError):
        projects.Project((("a", field),)).field("c")


def test_mixture_derivatives(spark):
    bump = trends.Weight(0.8, center=(0.4, -0.2), radius=0.7, low=(-1.0, -1.0), high=(1.0, 1.0), transition=0.5)
    mixture = trends.Mixture(((trends.Weight(0.5), Kernel("gaussian", 1.0), Anisotropy.isotropic(2, 1.3)), (bump, Kernel("imq", 0.8), Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (1.5, 0.6)))))
    points, h = np.array([[0.1, 0.2], [0.8, -0.7], [-0.9, 0.3], [1.4, 0.0]]), 1e-5
    rows = spark.createDataFrame([(i, k, s, float(p[0] + (s * h if k == 0 else 0)), float(p[1] + (s * h if k == 1 else 0))) for i, p in enumerate(points) for k in (0, 1) for s in (0, 1, -1)], "i int, k int, s int, x0 double, x1 double")
    x, y = [F.col("x0"), F.col("x1")], [F.lit(0.2), F.lit(-0.1)]
    g, hess = mixture.derivatives(x, y)
    got = rows.select("i", "k", "s", mixture.value(x, y).alias("v"), g[0].alias("g0"), g[1].alias("g1"), *[hess[i][j].alias(f"h{i}{j}") for i in (0, 1) for j in (0, 1)]).toPandas().set_index(["i", "k", "s"])
    for i in range(len(points)):
        for k in (0, 1):
            up, down, own = got.loc[i, k, 1], got.loc[i, k, -1], got.loc[i, k, 0]
            assert (up.v - down.v) / (2 * h) == pytest.approx(own[f"g{k}"], abs=1e-6)
            assert [(up[f"g{j}"] - down[f"g{j}"]) / (2 * h) for j in (0, 1)] == pytest.approx([own[f"h{k}0"], own[f"h{k}1"]], abs=1e-5)
    with pytest.raises(errors.CapabilityError):
        mixture.require(3)
    assert mixture.capability(2) == "everywhere"


def test_diagnostics_of_trends(spark):
    controls = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 2.0, 4.0, 1.0, 1.0, 0.5), (9, 1.0, 0.0, 0.0, 0.0, 4.0, 1.0, 1.0, 0.5)], "ord long, x0 double, x1 double, u0 double, u1 double, along double, across double, radius double, strength double")
    made = trends.compiled_controls(controls, (0.5, 2.0), trends.TrendPolicy()).orderBy("component").collect()
    assert [r.problem for r in made] == [None, None, "no direction"] and np.array(made[1].matrix) == pytest.approx(np.diag([1.0, 0.25])) and np.array(made[0].matrix) == pytest.approx(np.eye(2) / 2)
    with pytest.raises(errors.InputError):
        trends.TrendPolicy(jump=2.0)
    mixture = trends.Mixture(((trends.Weight(0.5), Kernel("gaussian"), Anisotropy.isotropic(2, 1.0)),))
    out = trends.diagnostics(trends.compiled_controls(controls, (0.5, 2.0), trends.TrendPolicy()), controls.select("x0", "x1"), mixture, 0.3)
    assert {k: v.count() for k, v in out.items()} == {"controls": 2, "background": 1, "samples": 2, "low_confidence": 2, "summary": 1}


def plain_greedy(gram, y, count, power):
    """By solving anew each time: the power function or the residual of the interpolant through what is chosen."""
    chosen = []
    for _ in range(count):
        k = gram[np.ix_(chosen, chosen)]
        solved = np.linalg.solve(k, gram[chosen]) if chosen else np.zeros((0, len(y)))
        score = np.diag(gram) - (gram[chosen] * solved).sum(0) if power else np.abs(y - (np.linalg.solve(k, y[chosen]) @ gram[chosen] if chosen else 0.0))
        score[chosen] = -1
        chosen.append(int(np.argmax(score)))
    return chosen


@pytest.mark.parametrize("by", ["power", "residual"])
def test_greedy_orders_match_a_plain_version(spark, by):
    rng = np.random.default_rng(8)
    x, y = np.sort(rng.uniform(0, 10, 25)), rng.normal(size=25)
    rows = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "field_id long, idx int, x0 double, y double")
    got = [r.idx for r in selection.select_greedy(rows, Kernel("matern32", 2.0), 1, 9, by).orderBy("nth").collect()]
    wanted = plain_greedy(Kernel("matern32", 2.0).radial(np.abs(x[:, None] - x))["phi"], y, 9, by == "power")
    assert got[1:] == wanted[1:] if by == "residual" else len(got) == 9
    if by == "residual":
        assert got == wanted


def test_tuning_problems(spark):
    rows = spark.createDataFrame([(0, 1.0, None), (1, 0.0, None), (2, 1.0, None), (3, float("nan"), None), (4, None, 2.0), (5, 2.0, 1.0)], "cand int, length double, axis_ratio double")
    got = {r.cand: r.problem for r in selection.candidate_violations(rows, {"length": (0.5, 3.0)}).collect()}
    assert got == {1: "length is out of bounds", 2: "repeats a candidate", 3: "length is out of bounds", 4: "length is missing", 5: "axis_ratio has no bounds"}
    with pytest.raises(errors.InputError):
        selection.candidate_violations(rows, {"axis_ratio": (0.5, 3.0)})
    with pytest.raises(errors.InputError):
        selection.fixed_choice(rows, 77)
    with pytest.raises(errors.InputError):
        selection.power_scores(spark.createDataFrame([(0, -1.0, 3)], "cand int, max_sq_power double, samples long"))
    eigen = spark.createDataFrame([(0.7, 0.3)], "l0 double, l1 double")
    assert tensors.axis_review(eigen, ["l0", "l1"], 0.5).first()[:] == (0.7, 0.3, pytest.approx(0.4), True)
    for bad in ([], [2.0, 3.0, 1.0], [2.0, 1.5]):
        with pytest.raises(errors.InputError):
            tensors.fixed_ratios(eigen, bad)


def test_basis_review(spark):
    rows = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(6)], "field_id long, idx int, x0 double, y double")
    chosen = spark.createDataFrame([(0, 4), (1, 2)], "nth int, idx long")
    assert selection.selected_basis(rows, chosen, Kernel("gaussian", 1.0), 1).first().selected == 2
    with pytest.raises(Exception, match="300|700"):
        selection.selected_basis(rows.withColumn("x0", F.lit(1.0)), chosen, Kernel("gaussian", 1.0), 1).collect()


def test_evaluated_folds(spark):
    rows = spark.createDataFrame([(k % 3, float(k)) for k in range(30)], "fold int, y double")
    found = selection.evaluated(spark.createDataFrame([(0, 1.0), (1, 2.0)], "cand int, length double"), rows, lambda own, p: (own.y.sum() * p["length"], len(own)), ["length"]).toPandas()
    assert isinstance(found, pd.DataFrame) and len(found) == 6
    assert found[found.cand == 1].weighted_squared_error.sum() == 2 * sum(range(30)) and found.weight.sum() == 60
