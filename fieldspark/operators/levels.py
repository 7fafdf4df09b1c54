"""Levels: unknown or fixed values of a field on named surfaces, ordered by least gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.errors import ContrastError, GaugeError, InfeasibleError, InputError, MemoryLimitError
from fieldspark.operators import graphs, ranking
from fieldspark.sessions import checkpointed

#: Levels that one task takes: its arrays of levels and orders stay small.
ONE_TASK = 1_000_000


def components(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """level_id, component: the smallest level that orders (lower_id, upper_id) connect it with."""
    roots = graphs.components(orders.select(F.col("lower_id").alias("a"), F.col("upper_id").alias("b")))
    joined = levels.select("level_id").join(roots, F.col("level_id") == F.col("node"), "left")
    return joined.select("level_id", F.coalesce("root", "level_id").alias("component"))


def membership_closure(levels: DataFrame, memberships: DataFrame, place: Sequence[str]) -> DataFrame:
    """level_id, closure: the smallest level that must have the same value, because chains of levels share members: two
    memberships (level_id and the coordinates of one value) at the same place."""
    at = memberships.groupBy(*place).agg(F.min("level_id").alias("a"), F.collect_set("level_id").alias("all"))
    edges = at.select("a", F.explode("all").alias("b")).where("a <> b")
    joined = levels.select("level_id").join(graphs.components(edges), F.col("level_id") == F.col("node"), "left")
    return joined.select("level_id", F.coalesce("root", "level_id").alias("closure"))


# -- paths over orders


def _bucketed(levels: DataFrame, orders: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """bucket, level_id, upper_id, gap and columns of ``more`` (level_id, ...): a row for each level (upper_id null) and each
    order, dealt so that no order joins two buckets. Up to ONE_TASK levels are one bucket; beyond, whole components are dealt
    by their root, and a component above that size is refused."""
    n = levels.count()
    named = levels.select("level_id") if more is None else levels.select("level_id").join(more, "level_id", "left")
    extra = [c for c in named.columns if c != "level_id"]
    order = orders.groupBy("lower_id", "upper_id").agg(F.max("min_gap").cast("double").alias("gap"))
    if n <= ONE_TASK:
        nodes, edges = named.withColumn("bucket", F.lit(0).cast("long")), order.withColumn("bucket", F.lit(0).cast("long"))
    else:
        of = checkpointed(components(levels, orders))
        largest = of.groupBy("component").count().agg(F.max("count")).first()[0]
        if largest > ONE_TASK:
            raise MemoryLimitError("the orders connect too many levels for one task", levels=largest, limit=ONE_TASK)
        of = of.select("level_id", F.pmod(F.xxhash64("component"), F.lit(-(-4 * n // ONE_TASK))).alias("bucket"))
        nodes = named.join(of, "level_id")
        edges = order.join(of.withColumnRenamed("level_id", "lower_id"), "lower_id")
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(named.dtypes)
    rows = nodes.select("bucket", F.col("level_id").cast("long").alias("level_id"), null("long").alias("upper_id"), null("double").alias("gap"), *extra)
    return rows.union(edges.select("bucket", F.col("lower_id").cast("long").alias("level_id"), F.col("upper_id").cast("long").alias("upper_id"), "gap", *[null(kinds[c]).alias(c) for c in extra]))


class Graph:
    """The levels and orders of one bucket in arrays, and the levels in an order in which every order leads onwards."""

    def __init__(self, rows: pd.DataFrame):
        node = rows["upper_id"].isna()
        self.nodes = rows[node].drop_duplicates("level_id").sort_values("level_id").reset_index(drop=True)
        self.ids = self.nodes["level_id"].to_numpy(np.int64)
        edges = rows[~node]
        self.lower, self.upper = (np.searchsorted(self.ids, edges[c].to_numpy(np.int64)) for c in ("level_id", "upper_id"))
        by = np.argsort(self.lower, kind="stable")
        self.lower, self.upper, self.gap = self.lower[by], self.upper[by], edges["gap"].to_numpy(float)[by]
        n = len(self.ids)
        begin = np.searchsorted(self.lower, np.arange(n + 1))
        waiting = np.bincount(self.upper, minlength=n)
        self.depth, self.height = np.zeros(n, np.int64), np.zeros(n)
        frontier, order = np.flatnonzero(waiting == 0), []
        while len(frontier):
            order.append(frontier)
            count = begin[frontier + 1] - begin[frontier]
            out = np.repeat(begin[frontier] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ahead = self.upper[out]
            np.maximum.at(self.depth, ahead, self.depth[self.lower[out]] + 1)
            np.maximum.at(self.height, ahead, self.height[self.lower[out]] + self.gap[out])
            np.subtract.at(waiting, ahead, 1)
            frontier = np.unique(ahead[waiting[ahead] == 0])
        self.order = np.concatenate(order) if order else np.empty(0, np.int64)
        if len(self.order) < n:
            self._refuse(waiting > 0)

    def _refuse(self, left: np.ndarray) -> None:
        """Of the levels that wait for each other, those that lead nowhere are not on a cycle."""
        while True:
            leads = np.zeros(len(left), bool)
            leads[self.lower[left[self.upper]]] = True
            if not (left & ~leads).any():
                raise InfeasibleError("the orders have a cycle", level=int(self.ids[left].min()))
            left &= leads

    def longest(self, starts: np.ndarray) -> Iterator[tuple[int, dict[int, float]]]:
        """Each level, and the largest sum of gaps on a path to it from each of the starts that lead to it."""
        by = np.argsort(self.upper, kind="stable")
        begin = np.searchsorted(self.upper[by], np.arange(len(self.ids) + 1))
        came, lower, gap = [None] * len(self.ids), self.lower[by].tolist(), self.gap[by].tolist()
        for k in self.order.tolist():
            own: dict[int, float] = {}
            for e in range(begin[k], begin[k + 1]):
                for start, total in came[lower[e]].items():
                    if own.get(start, -1.0) < total + gap[e]:
                        own[start] = total + gap[e]
            yield k, own
            came[k] = {**own, k: 0.0} if starts[k] else own


def topological_depth(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """level_id, depth, height: the most orders and the largest sum of gaps on a path that ends at the level. A cycle is an
    error that names a level on it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(rows)
        return pd.DataFrame({"level_id": graph.ids, "depth": graph.depth, "height": graph.height})

    return _bucketed(levels, orders).groupBy("bucket").applyInPandas(run, "level_id long, depth int, height double")


def cycles(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """level_id: the smallest level on a cycle of orders, of each bucket of levels that has one. An error of a task would
    reach the driver as one of Python's, without its class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            Graph(rows)
        except InfeasibleError as error:
            return pd.DataFrame({"level_id": [error.where["level"]]})
        return pd.DataFrame({"level_id": np.empty(0, np.int64)})

    return _bucketed(levels, orders).groupBy("bucket").applyInPandas(run, "level_id long")


def fixed_conflicts(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """lower_id, upper_id, least, values of fixed levels whose values are closer than the largest sum of gaps on a path."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(rows)
        value = graph.nodes["fixed"].to_numpy(float)
        made = [(graph.ids[a], graph.ids[k], least, value[k] - value[a]) for k, came in graph.longest(~np.isnan(value)) if not np.isnan(value[k]) for a, least in came.items() if value[k] - value[a] < least]
        return pd.DataFrame(made, columns=["lower_id", "upper_id", "least", "difference"])

    fixed = levels.where("kind = 'fixed'").select("level_id", F.col("value").cast("double").alias("fixed"))
    return _bucketed(levels, orders, fixed).groupBy("bucket").applyInPandas(run, "lower_id long, upper_id long, least double, difference double")


def closure_conflicts(levels: DataFrame, memberships: DataFrame, orders: DataFrame, place: Sequence[str]) -> DataFrame:
    """closure, problem, lower, upper: levels that must be equal but have different fixed values, the least and the largest
    of them, or that a path of orders, through any levels, keeps apart by more than 0, and the most that one does."""
    closures = checkpointed(membership_closure(levels, memberships, place))
    fixed = levels.where("kind = 'fixed'").join(closures, "level_id").groupBy("closure").agg(F.min("value").alias("lower"), F.max("value").alias("upper")).where("lower < upper")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(rows)
        closure = graph.nodes["closure"].to_numpy(float)  # null: no other level is equal
        names = graph.nodes["closure"].to_numpy()
        made = [(int(names[k]), gap) for k, came in graph.longest(~np.isnan(closure)) if not np.isnan(closure[k]) for a, gap in came.items() if gap > 0 and names[a] == names[k]]
        return pd.DataFrame(made, columns=["closure", "gap"])

    shared = closures.join(closures.groupBy("closure").count().where("count > 1"), "closure").select("level_id", F.col("closure").cast("long").alias("closure"))
    apart = _bucketed(levels, orders, shared).groupBy("bucket").applyInPandas(run, "closure long, gap double").groupBy("closure").agg(F.lit(0.0).alias("lower"), F.max("gap").alias("upper"))
    return fixed.select("closure", F.lit("fixed").alias("problem"), "lower", "upper").union(apart.select("closure", F.lit("order").alias("problem"), "lower", "upper"))


# -- what levels must have


def loose_components(levels: DataFrame, orders: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """component, levels of components without a fixed or prior value. Orders connect levels, and so does the field all
    levels that have members, where memberships are given: components of orders with a member anywhere are one."""
    roots = graphs.components(orders.select(F.col("lower_id").alias("a"), F.col("upper_id").alias("b")))
    named = levels.select("level_id", (F.col("kind") != "unknown").alias("held")).join(roots, F.col("level_id") == F.col("node"), "left")
    named = named.select("level_id", F.coalesce("root", "level_id").alias("component"), "held")
    both = [F.bool_or("held").alias("held"), F.sum("levels").alias("levels")]
    if memberships is None:
        found = named.withColumn("levels", F.lit(1)).groupBy("component").agg(*both)
    else:
        # A level and its memberships meet by their ids in one sum instead of a join.
        rows = named.select("level_id", "component", "held", F.lit(1).alias("levels"), F.lit(False).alias("member"))
        none = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        rows = rows.union(memberships.select("level_id", none("component"), none("held"), F.lit(0).alias("levels"), F.lit(True).alias("member")))
        each = rows.groupBy("level_id").agg(F.min("component").alias("component"), *both, F.bool_or("member").alias("member")).where("levels > 0")
        parts = each.groupBy("component").agg(F.bool_or("held").alias("held"), F.sum("levels").alias("levels"), F.bool_or("member").alias("member"))
        found = parts.groupBy(F.when(~F.col("member"), F.col("component")).alias("apart")).agg(F.min("component").alias("component"), *both)
    return found.where("not held").select("component", "levels")


def has_contrast(levels: DataFrame, memberships: DataFrame, orders: DataFrame, place: Sequence[str] = ()) -> bool:
    """Whether levels with members differ: a path of orders with a gap leads from one to another, or two that need not be
    equal have different fixed values or means of priors."""
    members = memberships.select("level_id").distinct().withColumn("member", F.lit(True))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(rows)
        member = graph.nodes["member"].notna().to_numpy()
        # A start's own rank does not matter here: the largest sum from any member is enough.
        best, reach = np.zeros(len(graph.ids)), np.zeros(len(graph.ids), bool)
        by = np.argsort(graph.upper, kind="stable")
        begin = np.searchsorted(graph.upper[by], np.arange(len(graph.ids) + 1))
        found = False
        for k in graph.order.tolist():
            e = by[begin[k] : begin[k + 1]]
            e = e[reach[graph.lower[e]] | member[graph.lower[e]]]
            if len(e):
                reach[k], best[k] = True, (best[graph.lower[e]] + graph.gap[e]).max()
                found |= bool(member[k] and best[k] > 0)
        return pd.DataFrame({"found": [found]})

    if _bucketed(levels, orders, members).groupBy("bucket").applyInPandas(run, "found boolean").where("found").first():
        return True
    anchors = levels.join(members, "level_id").select("level_id", F.coalesce("value", "mean").alias("v")).where("v is not null")
    if place:
        anchors = anchors.join(membership_closure(levels, memberships, place), "level_id").select(F.col("closure").alias("level_id"), "v")
    ends = anchors.agg(F.count_distinct("v").alias("values"), F.count_distinct("level_id").alias("classes")).first()
    return ends["values"] > 1 and ends["classes"] > 1


def validate(levels: DataFrame, memberships: DataFrame, orders: DataFrame) -> None:
    """Checks in a fixed order, the first failure is raised: counts, unique ids and observations, references, memberships of
    plain values, cycles, equal levels that values or paths of orders keep apart (where memberships have coordinates x0
    ...), fixed values against the gaps between them, a fixed or prior value for each component that orders and the field
    connect, and contrast between levels with members."""
    place = [c for c in ("x0", "x1", "x2") if c in memberships.columns]
    if levels.limit(2).count() < 2 or memberships.isEmpty():
        raise InputError("two levels and a membership at least are needed")
    twice = levels.groupBy("level_id").count().where("count > 1").first()
    if twice:
        raise InputError("a level repeats", level=twice["level_id"])
    observed = [t.select("obs_id") for t in (levels, memberships, orders) if "obs_id" in t.columns]
    if observed:
        again = reduce(DataFrame.union, observed).groupBy("obs_id").count().where("count > 1").first()
        if again:
            raise InputError("an observation repeats", observation=again["obs_id"])
    named = orders.select(F.col("lower_id").alias("level_id")).union(orders.select(F.col("upper_id").alias("level_id"))).union(memberships.select("level_id"))
    lost = named.join(levels, "level_id", "left_anti").first()
    if lost:
        raise InputError("no such level", level=lost["level_id"])
    if {"coef", "kind"} <= set(memberships.columns) and not memberships.where("coef <> 1 or kind <> 'value'").isEmpty():
        raise InputError("a membership is a value with coefficient 1")
    if orders.where("lower_id = upper_id or not min_gap >= 0").first():
        raise InputError("an order needs two levels and a gap of 0 or more")
    cycle = cycles(levels, orders).agg(F.min("level_id")).first()[0]
    if cycle is not None:
        raise InfeasibleError("the orders have a cycle", level=cycle)
    if place:
        equal = closure_conflicts(levels, memberships, orders, place).first()
        if equal:
            raise InfeasibleError("levels with members at one place are kept apart", closure=equal["closure"], problem=equal["problem"])
    conflict = fixed_conflicts(levels, orders).first()
    if conflict:
        raise InfeasibleError("fixed values are closer than the gaps between them", lower=conflict["lower_id"], upper=conflict["upper_id"])
    loose = loose_components(levels, orders, memberships).first()
    if loose:
        raise GaugeError("no fixed or prior value", component=loose["component"])
    if not has_contrast(levels, memberships, orders, place):
        raise ContrastError("nothing keeps the levels apart")


def compile_levels(levels: DataFrame, memberships: DataFrame, orders: DataFrame, field_terms: DataFrame, first_variable: int) -> DataFrame:
    """cls, obs_id, var, coef, rhs: memberships f(x) - h = 0, fixed values h = v, orders h_upper - h_lower >= gap and priors
    as soft equalities. Variables of levels come after the field's, in the order of ord. field_terms are (obs_id, var,
    coef, constant) of f at each membership."""
    numbered = checkpointed(ranking.numbered(levels, ["ord", "level_id"], "var").withColumn("var", F.col("var") + first_variable))
    at = numbered.select("level_id", "var")
    member = field_terms.select(F.lit("membership").alias("cls"), "obs_id", "var", "coef", (-F.col("constant")).alias("rhs"))
    rhs = field_terms.select("obs_id", F.col("constant")).distinct()
    own = memberships.join(at, "level_id").join(rhs, "obs_id").select(F.lit("membership").alias("cls"), "obs_id", "var", F.lit(-1.0).alias("coef"), (-F.col("constant")).alias("rhs"))
    fixed = numbered.where("kind = 'fixed'").select(F.lit("fixed").alias("cls"), F.col("level_id").alias("obs_id"), "var", F.lit(1.0).alias("coef"), F.col("value").alias("rhs"))
    prior = numbered.where("kind = 'prior'").select(F.lit("prior").alias("cls"), F.col("level_id").alias("obs_id"), "var", F.lit(1.0).alias("coef"), F.col("mean").alias("rhs"))
    ends = orders.select(F.monotonically_increasing_id().alias("obs_id"), "*") if "obs_id" not in orders.columns else orders
    sides = [ends.join(at.withColumnRenamed("level_id", side), side).select(F.lit("order").alias("cls"), "obs_id", "var", F.lit(sign).alias("coef"), F.col("min_gap").alias("rhs")) for side, sign in (("upper_id", 1.0), ("lower_id", -1.0))]
    made = member.union(own).union(fixed).union(prior)
    for side in sides:
        made = made.union(side)
    return made
