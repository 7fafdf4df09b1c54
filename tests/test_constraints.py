"""Review of proportional rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldspark import errors
from fieldspark.operators import constraints, levels, ranking

def test_near_duplicates_go_by_classes(spark):
    eps = 2.0**-52
    rows = {k: (2.0 * k, -6.0 * k) for k in range(1, 301)}  # one class
    rows |= {400: (1.0, -3.0 * (1 + 40 * eps)), 401: (-2.0, 6.0 * (1 + 40 * eps)), 500: (1.0, 3.0), 501: (1.0, -3.0 * (1 + 4000 * eps))}
    made = [(row, var, c) for row, both in rows.items() for var, c in enumerate(both)] + [(600, 0, 2.0), (600, 2, -6.0)]
    got = constraints.near_duplicates(spark.createDataFrame(made, "row long, var long, coef double"))
    assert Counter(map(tuple, got.collect())) == Counter([(1, k, "duplicate") for k in range(2, 301)] + [(400, 401, "duplicate"), (1, 400, "near_duplicate")])


def test_conflicts_are_exact(spark):
    rows = [(1, 0, 1.0, 0.3, 0.3), (2, 0, 3.0, 0.9, 0.9), (3, 1, 1.0, 0.25, 0.25), (4, 1, -4.0, -1.0, -1.0), (5, 2, 0.0, 1.0, 2.0), (6, 3, 2.0, None, 5.0), (7, 3, -1.0, None, -3.0), (8, 4, 0.0, -1.0, 1.0)]
    got = constraints.hard_conflicts(spark.createDataFrame(rows, "row long, var long, coef double, lower double, upper double"))
    assert sorted(r.row for r in got.collect()) == [1, 5, 6]
    near = [(1, 0, 1.0, 0.0, 0.0), (1, 1, 3.0, 0.0, 0.0), (2, 0, 1.0, 1.0, 1.0), (2, 1, 3.0 + 2.0**-51, 1.0, 1.0)]
    assert constraints.hard_conflicts(spark.createDataFrame(near, "row long, var long, coef double, lower double, upper double")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 400])
def test_numbers_follow_the_order(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 101).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("c")).repartition(5)
    got = ranking.numbered(rows, ["k", "i"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.k, r.i))] == list(range(n))
    for c in (None, 1, 2):
        own = sorted((r.k, r.i, r.n) for r in ranking.numbered(rows, ["k", "i"], "n", within="c").collect() if r.c == c)
        assert [x[2] for x in own] == list(range(len(own)))
    values = sorted(r.k for r in got)
    if n:
        place = (n - 1) * 0.3
        low = int(place)
        assert ranking.quantiles(rows, "k", [0.0, 0.3, 1.0]) == pytest.approx([values[0], values[low] + (values[min(low + 1, n - 1)] - values[low]) * (place - low), values[-1]])
    else:
        assert ranking.quantiles(rows, "k", [0.5]) == [None]


def test_wrong_constraints(spark):
    with pytest.raises(errors.GaugeError):
        constraints.tangent_rows(spark.createDataFrame([(1, 0, 1.0, 1.0)], "obs_id long, ord int, x double, t double"), ["x"], ["t"], None)
    rows = spark.createDataFrame([(1, 0, "increasing", 1.0, None, "hard", None, None, None)], "obs_id long, ord int, kind string, value double, upper double, enforcement string, scale double, loss string, delta double")
    terms = spark.createDataFrame([(1, 2.0, "dderiv")], "expr_id long, coef double, kind string")
    with pytest.raises(errors.InputError, match="single derivative"):
        constraints.lower_linear(rows, terms)
    with pytest.raises(errors.InputError, match="gap or rate"):
        constraints.lower_linear(rows.withColumn("value", F.lit(-1.0)), terms)
    assert constraints.lower_linear(rows, terms.withColumn("coef", F.lit(1.0))).first().lower == 1.0
    with pytest.raises(errors.InputError, match="both"):
        constraints.compose(rows.select("obs_id", "ord"), rows.select("obs_id", "ord"))
    with pytest.raises(errors.InputError):
        constraints.labelled_thickness(rows, "none")
    blocks = spark.createDataFrame([("a", 0, 3), ("b", 1, 2), ("a", 2, 1)], "block string, ord int, length long")
    with pytest.raises(errors.InputError):
        constraints.variable_blocks(blocks)
    assert {r.block: r.first for r in constraints.variable_blocks(blocks.where("ord < 2")).collect()} == {"a": 0, "b": 3}


def test_closure_chains(spark):
    known = spark.createDataFrame([(k, "fixed" if k in (1, 4) else "unknown", {1: 0.0, 4: 1.0}.get(k)) for k in range(1, 7)], "level_id long, kind string, value double")
    members = spark.createDataFrame([(1, 0.0), (2, 0.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 9.0), (5, 9.0)], "level_id long, x0 double")
    assert {r.level_id: r.closure for r in levels.membership_closure(known, members, ["x0"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    orders = spark.createDataFrame([(2, 3, 0.5), (5, 6, 1.0), (3, 4, 0.0)], "lower_id long, upper_id long, min_gap double")
    assert sorted(map(tuple, levels.closure_conflicts(known, members, orders, ["x0"]).collect())) == [(1, "fixed", 0.0, 1.0), (1, "order", 0.0, 0.5)]
