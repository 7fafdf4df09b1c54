"""Where a field takes a value: points in one dimension, lines in two, and thickness sampled between two levels.

Fields come as functions of arrays of coordinates (``FittedField.function``), which are computed for a batch of rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldspark.errors import ConditioningError, InputError
from fieldspark.operators import ranking
from fieldspark.sessions import checkpointed

Numbers = Callable[[list[np.ndarray]], np.ndarray]

#: Segments of lines that one task puts in order.
ONE_TASK = 1 << 20


def bisect(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: float, width: float, steps: int) -> np.ndarray:
    """Roots of f between low and high, where it changes sign, to the tolerance of its value or of the width; an error if
    ``steps`` halvings do not get there."""
    a, b, fa = low.copy(), high.copy(), f(low)
    found, good = np.where(np.abs(fa) <= tolerance, low, high), (np.abs(fa) <= tolerance) | (np.abs(f(high)) <= tolerance)
    for _ in range(steps):
        if good.all():
            return found
        m = (a + b) / 2
        fm = f(m)
        stop = ~good & ((np.abs(fm) <= tolerance) | (b - a <= width))
        found, good = np.where(stop, m, found), good | stop
        same = (fm < 0) == (fa < 0)
        a, fa, b = np.where(same, m, a), np.where(same, fm, fa), np.where(same, b, m)
    if not good.all():
        raise ConditioningError("a root was not refined within the steps", steps=steps)
    return found


def _mapped(rows: DataFrame, columns: Sequence[str], f: Callable[[list[np.ndarray]], list[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """rows with columns of numbers made from columns of numbers, by batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.asarray(m, float)) for m in made]], [*batch.schema.names, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]]))


def level_points(spark: SparkSession, f: Numbers, level: float, low: float, high: float, intervals: int, tolerance: float = 1e-10, steps: int = 100, slope: Numbers | None = None, width: float = 1e-12) -> DataFrame:
    """x, value, kind (and slope, where its function is given) of each place on a line where f takes the level: nodes within
    the tolerance, roots between nodes of different sign and, by the slope's sign changes, places where f touches the level.
    Places nearer than ``width`` to the one before are one, the one with the least residual, then the least slope. kind is
    boundary at the ends, stationary where f touches the level, else crossing."""
    if not low < high or intervals < 1 or not tolerance > 0 or not width > 0 or steps < 1:
        raise InputError("need low < high, an interval, a step and positive tolerances")
    nodes = spark.range(2 * intervals + 1).select("id", F.when(F.col("id") == 2 * intervals, high).otherwise(F.lit(low) + F.col("id") * ((high - low) / (2 * intervals))).alias("x"))
    flat = slope or (lambda x: np.ones(len(x[0])))
    valued = checkpointed(_mapped(nodes, ["x"], lambda x: [f(x) - level, flat(x)], ["g", "s"]))
    w = Window.orderBy("id")  # as many rows as nodes were asked for
    marked = valued.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("x", "g", "s")])
    place = lambda rows, of, stationary: _mapped(rows.select("x", "next_x"), ["x", "next_x"], lambda x: [bisect(of, x[0], x[1], tolerance, width * 1e-3, steps)], ["root"]).select(F.col("root").alias("x"), F.lit(stationary).alias("stationary"))
    hit, strict = F.abs("g") <= tolerance, lambda c: (F.abs(c) > tolerance) & (F.abs(f"next_{c}") > tolerance) & ((F.col(c) < 0) != (F.col(f"next_{c}") < 0))
    found = place(marked.where(strict("g")), lambda x: f([x]) - level, False).union(valued.where(hit).select("x", (F.abs("s") <= tolerance).alias("stationary")))
    if slope is not None:
        found = found.union(place(marked.where(strict("s")), lambda x: slope([x]), True))
    rated = checkpointed(_mapped(found, ["x"], lambda x: [f(x), flat(x)], ["value", "slope"]).where(F.abs(F.col("value") - level) <= tolerance * F.when(F.col("stationary"), 1.0).otherwise(float("inf"))))
    chained = rated.withColumn("new", F.coalesce(F.col("x") - F.lag("x").over(Window.orderBy("x")) > width, F.lit(True)).cast("int"))
    grouped = chained.withColumn("root", F.sum("new").over(Window.orderBy("x")))
    one = grouped.groupBy("root").agg(F.min_by(F.struct("x", "value", "slope"), F.struct(F.abs(F.col("value") - level), F.abs("slope"), "x")).alias("best"), F.bool_or("stationary").alias("stationary"))
    kind = F.when((F.col("x") == low) | (F.col("x") == high), "boundary").when(F.col("stationary"), "stationary").otherwise("crossing")
    made = one.select("best.*", "stationary").select("x", "value", kind.alias("kind"), "slope")
    return made if slope is not None else made.drop("slope")


def level_stretches(spark: SparkSession, f: Numbers, level: float, low: float, high: float, intervals: int, tolerance: float = 1e-10, width: float = 1e-12, steps: int = 100) -> DataFrame:
    """x, until: maximal stretches of a line on which f keeps the level within the tolerance: neighbouring nodes that have it,
    as f has between them, taken together, with their ends refined to the width towards the next nodes that do not."""
    if not low < high or intervals < 1 or not tolerance > 0 or not width > 0 or steps < 1:
        raise InputError("need low < high, an interval, a step and positive tolerances")
    step = (high - low) / intervals
    nodes = spark.range(intervals + 1).select("id", F.when(F.col("id") == intervals, high).otherwise(F.lit(low) + F.col("id") * step).alias("x"))
    inner = [0.25, 0.5, 0.75]
    flat = lambda x: (np.abs(f([x]) - level) <= tolerance).astype(float)
    valued = _mapped(nodes, ["x"], lambda x: [flat(x[0]), np.minimum.reduce([flat(np.minimum(x[0] + step * t, high)) for t in (0.0, *inner, 1.0)])], ["has", "keeps"])
    valued = checkpointed(valued.withColumn("keeps", F.when(F.col("id") == intervals, 0.0).otherwise(F.col("keeps"))))
    # A stretch is a run of intervals that keep the level: islands by a running count, one number a node.
    w = Window.orderBy("id")  # as many rows as nodes were asked for
    runs = valued.where("keeps = 1").withColumn("island", F.col("id") - F.row_number().over(w))
    spans = runs.groupBy("island").agg(F.min("id").alias("first"), (F.max("id") + 1).alias("last"))
    at = lambda name, k: nodes.select(F.col("id").alias(name), F.col("x").alias(k))
    ends = spans.join(at("first", "a"), "first").join(at("last", "b"), "last").select("a", "b")

    def refined(x: list[np.ndarray]) -> list[np.ndarray]:
        made = []
        for inside, sign, stop in ((x[0], -1.0, low), (x[1], 1.0, high)):
            good, bad = inside.copy(), np.clip(inside + sign * step, low, high)
            same = flat(bad) == 1  # the rectangle's end, or a neighbour that has the level again beyond a gap
            good = np.where(same & (bad == stop), bad, good)
            for _ in range(steps):
                middle = (good + bad) / 2
                keeps = flat(middle) == 1
                open_ = np.abs(bad - good) > width
                good, bad = np.where(open_ & keeps, middle, good), np.where(open_ & ~keeps, middle, bad)
            made.append(good)
        return made

    return _mapped(ends, ["a", "b"], refined, ["x", "until"]).select("x", "until")


def level_set(spark: SparkSession, f: Numbers, level: float, low: float, high: float, intervals: int, tolerance: float = 1e-10, steps: int = 100, slope: Numbers | None = None, width: float = 1e-12) -> DataFrame:
    """x, until, kind: the whole level set on a line: stretches (kind interval) and the points of ``level_points`` outside of
    them, whose until is null."""
    points = level_points(spark, f, level, low, high, intervals, tolerance, steps, slope, width).select("x", "kind")
    stretches = checkpointed(level_stretches(spark, f, level, low, high, intervals, tolerance, width, steps))
    near = F.lit(2 * width + (high - low) * 1e-12)
    covered = points.join(F.broadcast(stretches.select(F.col("x").alias("from"), "until")), (F.col("x") >= F.col("from") - near) & (F.col("x") <= F.col("until") + near), "left_anti")  # as many stretches as intervals at most
    return stretches.select("x", "until", F.lit("interval").alias("kind")).union(covered.select("x", F.lit(None).cast("double").alias("until"), "kind"))


# -- lines


def grid_nodes(spark: SparkSession, f: Numbers, level: float, low: Sequence[float], high: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """i, j, x, y, g = f - level on the corners of a grid of cells."""
    (nx, ny) = cells
    if nx < 1 or ny < 1 or not all(a < b < float("inf") and a > float("-inf") for a, b in zip(low, high)):
        raise InputError("need a cell and a finite rectangle")
    at = lambda k, n, a, b: F.when(k == n, b).otherwise(F.lit(a) + k * ((b - a) / n))
    ids = spark.range((nx + 1) * (ny + 1)).select((F.col("id") % (nx + 1)).alias("i"), F.expr(f"id div {nx + 1}").alias("j"))
    placed = ids.select("i", "j", at(F.col("i"), nx, low[0], high[0]).alias("x"), at(F.col("j"), ny, low[1], high[1]).alias("y"))
    return checkpointed(_mapped(placed, ["x", "y"], lambda x: [f(x) - level], ["g"]))


#: side, steps to the other end, and the place of its vertices in the order of all: nodes come before all sides
SIDES = (("h", 1, 0, 1), ("v", 0, 1, 2), ("d", 1, 1, 3))


def _vid(kind: Column | int, i: Column, j: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return kind.cast("long") * (1 << 60) + i.cast("long") * (1 << 30) + j.cast("long")


def edge_crossings(nodes: DataFrame, f: Numbers, level: float, tolerance: float = 1e-12, steps: int = 100, diagonals: bool = False) -> DataFrame:
    """side (h, v, and d for diagonals), i, j, vid, x, y: where the level crosses an edge that starts at node (i, j). Nodes
    meet their neighbours by equi-joins. A node on the level is itself the vertex of its edges; an edge with both ends on it
    is an error. vid orders vertices: nodes, then sides h, v and d, each by column and row."""
    made = None
    for side, di, dj, kind in SIDES if diagonals else SIDES[:2]:
        far = nodes.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("g").alias("g1"))
        met = nodes.join(far, ["i", "j"]).where("g = 0 or g1 = 0 or (g < 0) <> (g1 < 0)")
        vid = F.when(F.col("g") == 0, _vid(0, F.col("i"), F.col("j"))).when(F.col("g1") == 0, _vid(0, F.col("i") + di, F.col("j") + dj)).otherwise(_vid(kind, F.col("i"), F.col("j")))
        part = met.select(F.lit(side).alias("side"), "i", "j", vid.alias("vid"), "x", "y", "g", "x1", "y1", "g1")
        made = part if made is None else made.union(part)
    made = checkpointed(made)
    both = made.where("g = 0 and g1 = 0").first()
    if both is not None:
        raise InputError("an edge of the grid lies on the level", side=both["side"], i=both["i"], j=both["j"])

    def refine(c: list[np.ndarray]) -> list[np.ndarray]:
        x, y, g, x1, y1, g1 = c
        at = lambda t: [x + (x1 - x) * t, y + (y1 - y) * t]
        t = np.where(g == 0, 0.0, np.where(g1 == 0, 1.0, bisect(lambda t: f(at(t)) - level, np.zeros(len(x)), np.ones(len(x)), tolerance, 1e-15, steps)))
        return at(t)

    return _mapped(made, ["x", "y", "g", "x1", "y1", "g1"], refine, ["__x", "__y"]).select("side", "i", "j", "vid", F.col("__x").alias("x"), F.col("__y").alias("y"))


def segments(nodes: DataFrame, vertices: DataFrame, method: str = "squares") -> DataFrame:
    """i, j, a, b, ax, ay, bx, by: the segments of cell (i, j) between its sides' vertices. squares: a cell with four different
    vertices is decided by its bilinear saddle, where that is 0 by its center, and at last in favour of the positive corners:
    those that share the decider's sign are connected. simplices: the cell is two triangles on either side of its diagonal.
    A cell with three different vertices, as where the level runs through a corner and two sides, is an error."""
    if method not in ("squares", "simplices"):
        raise InputError("no such method", method=method)
    n = F.col("side")
    spot = lambda di, dj, at, part: F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(part).alias("part"), F.lit(at).alias("at"))
    two = method == "simplices"
    # bottom 0, right 1, top 2, left 3; triangle 0 has bottom, right and the diagonal, triangle 1 the diagonal, top and left
    homes = F.when(n == "h", F.array(spot(0, 0, 0, 0), spot(0, 1, 2, int(two)))).when(n == "v", F.array(spot(0, 0, 3, int(two)), spot(1, 0, 1, 0))).otherwise(F.array(spot(0, 0, 4, 0), spot(0, 0, 4, 1)))
    placed = vertices.where("side <> 'd'" if not two else "true").select(F.explode(homes).alias("c"), "vid", "x", "y").select("c.*", "vid", "x", "y")
    cells = placed.groupBy("i", "j", "part").agg(F.array_sort(F.collect_list(F.struct("at", "vid", "x", "y"))).alias("v"))
    last = nodes.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    cells = cells.where(F.col("i").between(0, last["i"] - 1) & F.col("j").between(0, last["j"] - 1)).withColumn("different", F.size(F.array_distinct(F.transform("v", lambda e: e["vid"]))))
    corner = lambda di, dj, name: nodes.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("g").alias(name))
    three = cells.where("different = 3").first()
    if three is not None:
        raise InputError("the level enters a cell at three places", i=three["i"], j=three["j"])
    four = cells.where("different = 4")
    for di, dj, name in ((0, 0, "ll"), (1, 0, "lr"), (1, 1, "ur"), (0, 1, "ul")):
        four = four.join(corner(di, dj, name), ["i", "j"])
    size = F.greatest(*[F.abs(F.col(c)) for c in ("ll", "lr", "ur", "ul")])
    q = {c: F.col(c) / size for c in ("ll", "lr", "ur", "ul")}
    saddle = F.try_divide(q["ll"] * q["ur"] - q["lr"] * q["ul"], q["ll"] + q["ur"] - q["lr"] - q["ul"])
    center = (q["ll"] + q["ur"] + q["lr"] + q["ul"]) / 4.0
    positive = F.coalesce(F.nullif(saddle, F.lit(0.0)) > 0, F.nullif(center, F.lit(0.0)) > 0, F.lit(True))
    right = (F.col("ll") > 0) == positive  # the lower left corner is connected with the upper right one
    get = lambda k: F.get("v", k)
    pair = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    drawn = four.select("i", "j", F.explode(F.when(right, F.concat(pair(get(0), get(1)), pair(get(2), get(3)))).otherwise(F.concat(pair(get(0), get(3)), pair(get(1), get(2))))).alias("s"))
    other = F.element_at(F.filter("v", lambda e: e["vid"] != get(0)["vid"]), 1)
    plain = cells.where("different = 2").select("i", "j", F.struct(get(0).alias("a"), other.alias("b")).alias("s"))
    every = plain.union(drawn)
    return every.select("i", "j", F.col("s.a.vid").alias("a"), F.col("s.b.vid").alias("b"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _walked(arcs: pd.DataFrame) -> pd.DataFrame:
    """line, seq, vid, closed of the lines that arcs between vertices make, of which none has more than two."""
    ids, ends = np.unique(arcs[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    near = np.full((len(ids), 2), -1)
    fro, to = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((to, fro))
    fro, to = fro[by], to[by]
    near[fro, np.arange(len(fro)) - np.searchsorted(fro, fro)] = to  # the lower neighbour first
    open_ = near[:, 1] < 0
    beside, seen, made = near.tolist(), [False] * len(ids), []
    for start in [*np.flatnonzero(open_).tolist(), *np.flatnonzero(~open_).tolist()]:
        if seen[start]:
            continue
        at, path = start, []
        while at >= 0:
            seen[at] = True
            path.append(at)
            at = next((k for k in beside[at] if k >= 0 and not seen[k]), -1)
        made.append(pd.DataFrame({"line": ids[min(path)], "seq": np.arange(len(path)), "vid": ids[path], "closed": bool(not open_[start])}))
    return pd.concat(made)


def _doubled(state: DataFrame, moved: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """One round of pointer doubling over steps a to b, of which each points to the step na to nb ahead (nb null: none ahead).
    A step is pointed to by one other at most, so the two meet in a group; a join of the state with itself would do the same,
    but Spark takes a join to be as large as the product of its sides, and that guess, squared in each round, becomes a
    number of millions of digits."""
    whole = F.struct(*state.columns)
    none = F.lit(None).cast(state.select(whole.alias("s")).schema["s"].dataType)
    offered = state.select("a", "b", whole.alias("then"), none.alias("own"))
    asked = state.where("nb is not null").select(F.col("na").alias("a"), F.col("nb").alias("b"), none.alias("then"), whole.alias("own"))
    met = offered.union(asked).groupBy("a", "b").agg(F.max("then").alias("then"), F.max("own").alias("own")).where("own is not null")
    return met.select(*moved(F.col("own"), F.col("then"))).union(state.where("nb is null"))


def _doubled_lines(half: DataFrame) -> DataFrame:
    """The same as ``_walked`` from the arcs in both directions, in a number of rounds that grows with the logarithm of the
    longest line: no task holds a line."""
    ahead = half.select(F.col("a").alias("b"), F.col("b").alias("c"))
    follows = checkpointed(half.join(ahead, "b", "left").groupBy("a", "b").agg(F.max(F.when(F.col("c") != F.col("a"), F.col("c"))).alias("c")))
    # Each step from a to b knows the lowest vertex within twice as many steps ahead in every round.
    state = checkpointed(follows.select("a", "b", F.col("b").alias("na"), F.col("c").alias("nb"), F.least("a", "b").alias("low")))
    mark = F.struct(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.count("nb").alias("open"))
    before = state.agg(mark.alias("m")).first()["m"]
    for _ in range(64):
        state = checkpointed(_doubled(state, lambda own, then: [own["a"].alias("a"), own["b"].alias("b"), then["na"].alias("na"), then["nb"].alias("nb"), F.least(own["low"], then["low"]).alias("low")]))
        after = state.agg(mark.alias("m")).first()["m"]
        if not after["open"] or after == before:
            break
        before = after
    back = state.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("low").alias("low2"))
    line = checkpointed(state.join(back, ["a", "b"]).select("a", "b", F.least("low", "low2").alias("line")))
    degree = half.groupBy("a").agg(F.count("*").alias("n"))
    first = line.join(degree, "a").groupBy("line").agg(F.min(F.when(F.col("n") == 1, F.col("a"))).alias("end"), F.min(F.when(F.col("a") == F.col("line"), F.col("b"))).alias("toward"))
    # The walk: steps that lead away from its first vertex; the step that would come round to the first one is the last.
    known = line.join(follows, ["a", "b"]).join(first, "line")
    round_ = F.col("end").isNull() & (((F.col("b") == F.col("line")) & (F.col("c") == F.col("toward"))) | ((F.col("c") == F.col("line")) & (F.col("b") == F.col("toward"))))
    state = checkpointed(known.select("a", "b", F.col("b").alias("na"), F.when(~round_, F.col("c")).alias("nb"), F.when(round_ | F.col("c").isNull(), 0).otherwise(1).cast("long").alias("left"), F.col("b").alias("last")))
    for _ in range(64):
        if state.where("nb is not null").isEmpty():
            break
        state = checkpointed(_doubled(state, lambda own, then: [own["a"].alias("a"), own["b"].alias("b"), then["na"].alias("na"), then["nb"].alias("nb"), (own["left"] + then["left"]).alias("left"), then["last"].alias("last")]))
    walk = state.select("a", "b", "left", "last").join(line, ["a", "b"]).join(first, "line")
    walk = walk.where(F.when(F.col("end").isNotNull(), F.col("last") != F.col("end")).otherwise(F.col("last") == F.col("line")))
    lengths = walk.groupBy("line").agg(F.max("left").alias("most"))
    seated = walk.join(lengths, "line").withColumn("seq", F.col("most") - F.col("left"))
    closed = F.col("end").isNull()
    return seated.select("line", "seq", F.col("a").alias("vid"), closed.alias("closed")).union(seated.where(~closed & (F.col("left") == 0)).select("line", F.col("seq") + 1, "b", closed))


def polylines(drawn: DataFrame) -> DataFrame:
    """line, seq, vid, x, y, closed: the vertices of each line in order. An open line begins at the end with the lower vid, a
    closed one at its lowest vertex, towards that one's lower neighbour; line is its lowest vid. No vertex may have more
    than two segments. Up to ONE_TASK segments are put in order by one task, more by pointer doubling."""
    arcs = checkpointed(drawn.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    half = arcs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    crowded = half.groupBy("a").count().where("count > 2").first()
    if crowded is not None:
        raise InputError("a vertex has more than two segments", vertex=crowded["a"])
    if arcs.count() <= ONE_TASK:
        listed = arcs.withColumn("bucket", F.lit(0)).groupBy("bucket").applyInPandas(_walked, "line long, seq long, vid long, closed boolean")
    else:
        listed = _doubled_lines(half)
    spots = drawn.select(F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("b").alias("vid"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("v")).select("v.*").groupBy("vid").agg(F.min(F.struct("x", "y")).alias("at"))
    return listed.join(spots, "vid").select("line", "seq", "vid", "at.x", "at.y", "closed")


def isolines(nodes: DataFrame, vertices: DataFrame, method: str = "squares") -> DataFrame:
    """``polylines`` of ``segments``, where every open line must end on the rectangle's sides: one that ends within is an error."""
    lines = checkpointed(polylines(segments(nodes, vertices, method)))
    ends = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    loose = open_inside(lines, lines.where(F.col("x").isin(ends[0], ends[1]) | F.col("y").isin(ends[2], ends[3])).select("vid").distinct()).first()
    if loose is not None:
        raise InputError("a line ends within the rectangle", line=loose["line"], vertex=loose["vid"])
    return lines


def line_summary(lines: DataFrame) -> DataFrame:
    """line, vertices, segments, closed of each line."""
    return lines.groupBy("line").agg(F.count("*").alias("vertices"), F.bool_and("closed").alias("closed")).select("line", "vertices", (F.col("vertices") - F.when(F.col("closed"), 0).otherwise(1)).alias("segments"), "closed")


def open_inside(lines: DataFrame, boundary: DataFrame) -> DataFrame:
    """The ends of open lines that are not among the vertices (vid) of the boundary: there should be none."""
    ends = lines.where("not closed").groupBy("line").agg(F.min_by("vid", "seq").alias("first"), F.max_by("vid", "seq").alias("last"))
    return ends.select("line", F.explode(F.array("first", "last")).alias("vid")).join(boundary, "vid", "left_anti")


def thickness(
    locations: DataFrame, place: Sequence[str], value: Numbers, gradient: Callable[[list[np.ndarray]], list[np.ndarray]], levels: tuple[float, float], reach: float, steps: int, halvings: int = 60, tolerance: float = 1e-12, least_slope: float = 1e-12
) -> DataFrame:
    """locations with thickness and failure, in one to three dimensions: from each place the search goes along the gradient
    for the upper level and against it for the lower, in ``steps`` equal steps up to ``reach``, to the first step that ends
    within the tolerance of the level or across it, then halves that. The thickness is the distance of the two points found.
    failure is gradient (shorter than ``least_slope``), not_found or refinement_limit (not within the tolerance of value or
    place after ``halvings``) where there is none, else null. value and gradient take arrays of coordinates and are
    computed for a batch of rows at once. Null coordinates give a null thickness without a failure."""
    low, high = levels
    if not low < high or not reach > 0 or steps < 1 or halvings < 1 or not tolerance > 0 or not least_slope > 0:
        raise InputError("need two levels in order and a positive reach, steps, halvings and tolerances")
    if {"thickness", "failure"} & set(locations.columns):
        raise InputError("the result's names are taken")

    def search(x: list[np.ndarray], way: list[np.ndarray], level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distance along the way, whether a step reached the level, and whether it was refined."""
        residual = lambda s: value([c + w * s for c, w in zip(x, way)]) - level
        a, fa = np.zeros(len(x[0])), residual(np.zeros(len(x[0])))
        done, left, right, f_left = np.abs(fa) <= tolerance, a.copy(), a.copy(), fa.copy()
        for k in range(1, steps + 1):
            b = np.full(len(a), reach * k / steps)
            fb = residual(b)
            new = ~done & ((np.abs(fb) <= tolerance) | ((fa < 0) != (fb < 0)))
            left, right, f_left = np.where(new, a, left), np.where(new, b, right), np.where(new, fa, f_left)
            done, a, fa = done | new, b, fb
        found, good = right.copy(), ~done | (np.abs(residual(right)) <= tolerance)
        for _ in range(halvings):
            if good.all():
                break
            middle = (left + right) / 2
            f = residual(middle)
            stop = ~good & ((np.abs(f) <= tolerance) | (right - left <= tolerance))
            found, good = np.where(stop, middle, found), good | stop
            same = (f < 0) == (f_left < 0)
            left, f_left, right = np.where(same, middle, left), np.where(same, f, f_left), np.where(same, right, middle)
        return found, done, good

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in place]
            none = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
            x = [c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
            g = gradient(x)
            norm = np.sqrt(sum(c * c for c in g))
            flat = ~(norm >= least_slope)
            way = [c / np.where(flat, 1.0, norm) for c in g]
            up, up_done, up_good = search(x, way, high)
            down, down_done, down_good = search(x, [-w for w in way], low)
            lost = ~flat & ~(up_done & down_done)
            rough = ~flat & ~lost & ~(up_good & down_good)
            bad = np.select([none, flat, lost, rough], [None, "gradient", "not_found", "refinement_limit"], None)
            thick = pa.array(up + down, mask=none | flat | lost | rough)
            yield pa.RecordBatch.from_arrays([*batch.columns, thick, pa.array(bad.tolist(), pa.string())], [*batch.schema.names, "thickness", "failure"])

    return locations.mapInArrow(run, StructType([*locations.schema.fields, StructField("thickness", DoubleType()), StructField("failure", StringType())]))


def thickness_proposals(measured: DataFrame, least: float) -> DataFrame:
    """The rows thinner than ``least``, with the thickness required there and its label: proposals for cones, never a fit."""
    return measured.where(F.col("thickness") < least).withColumns({"required": F.lit(least), "label": F.lit("SampledGeometricValidation")})


def thickness_report(measured: DataFrame, least: float, quantiles: Sequence[float]) -> DataFrame:
    """measured, failed, violations (thinner than ``least``), the minimum and type-7 quantiles; nulls without a success.
    Quantiles are found by rank: no task holds all values."""
    made = checkpointed(measured.select("thickness", "failure"))
    q = [F.lit(v).cast("double").alias(f"q{k}") for k, v in enumerate(ranking.quantiles(made, "thickness", quantiles))]
    measured = made
    return measured.agg(F.count("thickness").alias("measured"), F.count("failure").alias("failed"), F.count_if(F.col("thickness") < least).alias("violations"), F.min("thickness").alias("minimum"), *q)
