"""Flat stretches, cells that the level enters at three places, open lines, stored fields, quantiles and fitted tuning."""

import time

import numpy as np
import pytest

from fieldspark import errors
from fieldspark.functions.kernels import Anisotropy, Kernel
from fieldspark.operators import functionals, levelsets, ranking, selection
from fieldspark.sources import points


def test_flat_stretches_and_points_beside_them(spark):
    def f(x):
        return np.interp(x[0], [0, 1, 2, 4, 5, 6, 7], [1, 0, 0, 0, 1, 0, 1])

    found = sorted(map(tuple, levelsets.level_set(spark, f, 0.0, 0.0, 7.0, 14, tolerance=1e-9, width=1e-9).collect()))
    assert [(round(a, 6), b and round(b, 6), kind) for a, b, kind in found] == [(1.0, 4.0, "interval"), (6.0, None, "crossing")]
    off = sorted(map(tuple, levelsets.level_stretches(spark, f, 0.0, 0.0, 7.0, 10, tolerance=1e-9, width=1e-9).collect()))  # no node at 1 or 4
    assert off == [pytest.approx((1.0, 4.0), abs=1e-7)]
    whole = levelsets.level_set(spark, lambda x: x[0] * 0.0, 0.0, -1.0, 1.0, 3).collect()
    assert [(r.x, r.until) for r in whole] == [(-1.0, 1.0)]
    assert levelsets.level_stretches(spark, lambda x: x[0], 0.5, 0.0, 1.0, 4).count() == 0


def test_three_vertices_in_a_cell_and_lines_that_end_within(spark):
    corners = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 1.0, 0.0, 1.0), (0, 1, 0.0, 1.0, 1.0), (1, 1, 1.0, 1.0, -1.0)], "i long, j long, x double, y double, g double")
    f = lambda x: np.where((x[0] == 1) | (x[1] == 1), 1 - 2 * np.minimum(x[0], x[1]), np.maximum(x[0], x[1]))
    vertices = levelsets.edge_crossings(corners, f, 0.0)
    with pytest.raises(errors.InputError, match="three"):
        levelsets.segments(corners, vertices)
    nodes = levelsets.grid_nodes(spark, lambda x: x[0] - 0.3, 0.0, (-1.0, -1.0), (1.0, 1.0), (4, 4))
    vertices = levelsets.edge_crossings(nodes, lambda x: x[0] - 0.3, 0.0)
    assert levelsets.line_summary(levelsets.isolines(nodes, vertices)).select("vertices", "closed").first() == (5, False)
    with pytest.raises(errors.InputError, match="within"):
        levelsets.isolines(nodes, vertices.where("j < 3"))


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_long_lines_in_order_by_one_task_and_by_doubling(spark, monkeypatch, one_task):
    monkeypatch.setattr(levelsets, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    ids = rng.permutation(2000) + (1 << 40)
    parts, at = {}, 0
    for n, closed in ((1100, True), (700, False), (3, True), (2, False), (195, False)):
        part, at = ids[at : at + n].tolist(), at + n
        k = part.index(min(part))
        part = part[k:] + part[:k] if closed else part if part[0] < part[-1] else part[::-1]
        parts[min(part)] = (part if not closed or part[1] < part[-1] else [part[0], *part[:0:-1]], closed)
    arcs = [(a, b) if rng.random() < 0.5 else (b, a) for part, closed in parts.values() for a, b in zip(part, part[1:] + part[:1] if closed else part[1:])]
    drawn = spark.createDataFrame([(a, b, float(a), 0.5, float(b), 0.5) for a, b in arcs], "a long, b long, ax double, ay double, bx double, by double")
    began = time.perf_counter()
    found = levelsets.polylines(drawn).toPandas().sort_values(["line", "seq"])
    assert time.perf_counter() - began < 120  # where the guess of a join's size grew in each round, this did not end
    assert found["seq"].dtype == np.int64 and (found["x"] == found["vid"]).all()
    assert {line: (own["vid"].tolist(), own["closed"].all()) for line, own in found.groupby("line")} == parts
    assert all(own["seq"].tolist() == list(range(len(own))) for _, own in found.groupby("line"))


@pytest.mark.parametrize("anisotropy", [None, Anisotropy.isotropic(2, 0.7)])
def test_stored_fields_of_functionals_read_back_the_same(spark, tmp_path, anisotropy):
    rng = np.random.default_rng(0)
    slopes = np.array([False, True, True, False, True])
    field = functionals.FunctionalField(Kernel("gaussian", 1.5), rng.random((5, 2)), rng.standard_normal(5), np.empty(0), anisotropy, directions=np.where(slopes[:, None], rng.standard_normal((5, 2)), 0.0), derivative=slopes)
    points.write_field(spark, field, str(tmp_path / "field"))
    read = points.read_field(spark, str(tmp_path / "field"))
    x = rng.random((7, 2))
    assert isinstance(read, functionals.FunctionalField)
    assert (read.numbers(x, 1) == field.numbers(x, 1)).all()


def test_quantiles_of_values_that_repeat(spark):
    values = [2.0] * 500 + [float(v) for v in range(10)] + [None] * 7
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.003, 0.25, 0.5, 0.99, 0.995, 1.0]
    assert ranking.quantiles(frame, "v", shares) == pytest.approx(np.quantile([v for v in values if v is not None], shares).tolist())
    assert ranking.quantiles(frame.where("v is null"), "v", [0.5]) == [None]


def test_fitted_tuning_prefers_the_kernel_that_fits(spark, monkeypatch):
    x = np.linspace(0, 6, 31)
    rows = spark.createDataFrame([(k, float(v), float(np.sin(v)), k % 5, 1.0 + k % 2) for k, v in enumerate(x)], "idx int, x0 double, y double, fold int, weight double")
    candidates = spark.createDataFrame([(0, 0.05), (1, 1.5)], "cand int, length double")
    made = selection.cross_validated(candidates, rows, 1, lambda c: Kernel("matern52", c["length"]), ["length"])
    assert made.groupBy("cand").sum("weight").first()[1] == sum(1.0 + k % 2 for k in range(31))
    best = selection.select_minimum(selection.cv_scores(made)).first()
    assert best["cand"] == 1 and best["score"] < 1e-3
    monkeypatch.setattr(selection, "MAX_CENTERS", 30)
    with pytest.raises(errors.MemoryLimitError):
        selection.cross_validated(candidates, rows, 1, lambda c: Kernel("matern52", c["length"]), ["length"])
