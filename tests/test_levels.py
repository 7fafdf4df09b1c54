"""Levels: paths of many orders, equality through members, gauge and contrast through the field."""

import numpy as np
import pytest

from fieldspark import errors
from fieldspark.operators import graphs, levels

LEVEL, ORDER, MEMBER = "level_id long, ord int, kind string, value double, mean double", "lower_id long, upper_id long, min_gap double", "level_id long, obs_id long, x0 double"


def frames(spark, known, orders, members):
    return spark.createDataFrame([(i, n, kind, value, None) for n, (i, kind, value) in enumerate(known)], LEVEL), spark.createDataFrame(members, MEMBER), spark.createDataFrame(orders, ORDER)


@pytest.mark.parametrize("one_task", [10**6, 1500])
def test_chains_of_a_thousand_orders(spark, monkeypatch, one_task):
    monkeypatch.setattr(levels, "ONE_TASK", one_task)
    n = 1001
    known = [(k, "fixed" if k in (0, n - 1) else "unknown", 10.0 if k == n - 1 else 0.0 if k == 0 else None) for k in range(n)] + [(k, "unknown", None) for k in range(5000, 6000)]
    orders = [(k, k + 1, 0.25) for k in range(n - 1)] + [(0, 500, 1.0), (5000, 5999, 0.0)]
    given, members, ordered = frames(spark, known, orders, [(0, 1, 0.0), (n - 1, 2, 0.0)])
    found = {r.level_id: (r.depth, r.height) for r in levels.topological_depth(given, ordered).collect()}
    assert found[n - 1] == (n - 1, 250.0) and found[5999] == (1, 0.0) and found[5500] == (0, 0.0)
    assert [tuple(r) for r in levels.fixed_conflicts(given, ordered).collect()] == [(0, n - 1, 250.0, 10.0)]
    assert sorted(map(tuple, levels.closure_conflicts(given, members, ordered, ["x0"]).collect())) == [(0, "fixed", 0.0, 10.0), (0, "order", 0.0, 250.0)]


def test_a_component_above_the_bound_is_refused_and_cycles_are_named(spark, monkeypatch):
    given, members, ordered = frames(spark, [(k, "unknown", None) for k in range(6)], [(0, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0), (3, 1, 0.0), (3, 4, 0.0)], [(0, 1, 0.0)])
    with pytest.raises(Exception, match="level=1"):
        levels.topological_depth(given, ordered).collect()
    monkeypatch.setattr(levels, "ONE_TASK", 4)
    with pytest.raises(errors.MemoryLimitError):
        levels.topological_depth(given, ordered)


def test_equal_levels_apart_through_another(spark):
    known = [(1, "fixed", 0.0), (2, "unknown", None), (3, "unknown", None)]
    given, members, ordered = frames(spark, known, [(1, 2, 0.0), (2, 3, 0.5)], [(1, 11, 4.0), (3, 12, 4.0), (2, 13, 5.0)])
    assert [tuple(r) for r in levels.closure_conflicts(given, members, ordered, ["x0"]).collect()] == [(1, "order", 0.0, 0.5)]
    with pytest.raises(errors.InfeasibleError):
        levels.validate(given, members, ordered)
    levels.validate(given, frames(spark, known, [], [(1, 11, 4.0), (3, 12, 4.5), (2, 13, 5.0)])[1], ordered)
    flat = frames(spark, known, [(1, 2, 0.0), (2, 3, 0.0)], [])[2]
    assert levels.closure_conflicts(given, members, flat, ["x0"]).count() == 0


def test_the_field_holds_levels_that_no_order_joins(spark):
    known = [(1, "fixed", 0.0), (2, "fixed", 1.0), (3, "unknown", None), (4, "unknown", None)]
    given, members, ordered = frames(spark, known, [(1, 2, 0.5)], [(1, 11, 0.0), (2, 12, 1.0), (3, 13, 2.0), (4, 14, 3.0)])
    assert levels.loose_components(given, ordered).count() == 2
    assert levels.loose_components(given, ordered, members).count() == 0
    levels.validate(given, members, ordered)
    with pytest.raises(errors.GaugeError):
        levels.validate(given, members.where("level_id < 4"), ordered)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_components_of_chunks_and_of_rounds_are_the_same(spark, monkeypatch, chunk):
    rng = np.random.default_rng(5)
    pairs = [*rng.integers(0, 900, (500, 2)).tolist(), *[[2000 + k, 2001 + k] for k in range(60)], *[[3000, 3000 + k] for k in range(1, 90)], [5, 5]]
    edges = spark.createDataFrame([*pairs, [None, 3]], "a long, b long")
    monkeypatch.setattr(graphs, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = {r.node: r.root for r in graphs.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = {k: k for pair in pairs for k in pair}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert found == {k: r for k, r in root.items() if k != r}
    named = edges.selectExpr("cast(a as string) as a", "cast(b as string) as b")
    assert graphs.components(named).groupBy("root").count().count() == len(set(found.values()))


def test_members_make_one_of_components_without_edges_between_them(spark, monkeypatch):
    known = [(k, "fixed" if k == 41 else "unknown", 1.0 if k == 41 else None) for k in range(60)]
    orders = [(k, k + 1, 0.0) for k in range(0, 60, 3)]
    given, members, ordered = frames(spark, known, orders, [(k, 100 + k, float(k)) for k in (4, 9, 20, 20)])
    edges = []
    monkeypatch.setattr(levels.graphs, "components", lambda e, real=graphs.components: edges.append(e.count()) or real(e))
    found = {tuple(r) for r in levels.loose_components(given, ordered, members).collect()}
    alone = {(k, 2) for k in range(0, 60, 3)} - {(3, 2), (9, 2)} | {(k, 1) for k in range(2, 60, 3)} - {(20, 1), (41, 1)}
    assert found == alone | {(3, 5)} and edges == [20]  # {3, 4}, {9, 10} and 20 through the field
    assert (3, 5) not in {tuple(r) for r in levels.loose_components(given, ordered, members.union(spark.createDataFrame([(41, 7, 0.0)], MEMBER))).collect()}


def test_contrast_is_between_levels_with_members(spark):
    known = [(1, "fixed", 0.0), (2, "fixed", 1.0), (3, "unknown", None)]
    given, members, ordered = frames(spark, known, [(1, 3, 0.5)], [(1, 11, 0.0), (2, 12, 1.0), (3, 13, 2.0)])
    assert levels.has_contrast(given, members, ordered, ["x0"])
    assert levels.has_contrast(given, members.where("level_id <> 2"), ordered)  # the gap
    assert not levels.has_contrast(given, members.where("level_id = 1"), ordered)  # the gap leads to a level without members
    assert not levels.has_contrast(given, members.where("level_id in (1, 3)"), ordered.where("min_gap < 0"))
    same = spark.createDataFrame([(1, 11, 0.0), (2, 12, 0.0)], MEMBER)
    assert not levels.has_contrast(given, same, ordered, ["x0"])  # different values, but the two must be equal


def test_observations_and_memberships_are_checked(spark):
    given, members, ordered = frames(spark, [(1, "fixed", 0.0), (2, "fixed", 1.0)], [(1, 2, 0.5)], [(1, 11, 0.0), (2, 11, 1.0)])
    with pytest.raises(errors.InputError, match="observation"):
        levels.validate(given, members, ordered)
    slopes = spark.createDataFrame([(1, 11, 0.0, 1.0, "value"), (2, 12, 1.0, 2.0, "value")], MEMBER + ", coef double, kind string")
    with pytest.raises(errors.InputError, match="membership"):
        levels.validate(given, slopes, ordered)


@pytest.mark.parametrize("one_task", [10**6, 4])
def test_a_cycle_is_an_error_of_its_class(spark, monkeypatch, one_task):
    monkeypatch.setattr(levels, "ONE_TASK", one_task)
    known = [(k, "fixed" if k % 3 == 0 else "unknown", float(k) if k % 3 == 0 else None) for k in range(9)]
    orders = [(0, 1, 0.0), (1, 2, 0.0), (4, 5, 0.0), (5, 4, 0.0), (7, 6, 0.0), (8, 7, 0.0), (6, 8, 0.0)]
    given, members, ordered = frames(spark, known, orders, [(k, k + 20, float(k)) for k in range(9)])
    with pytest.raises(errors.InfeasibleError, match="cycle; level=4"):
        levels.validate(given, members, ordered)
    levels.validate(given, members, ordered.where("lower_id < upper_id"))
