"""Constraints as rows: semantic rows (one relation each) and canonical rows (one coefficient each).

A semantic row has obs_id, ord, rel (eq, bound or cone), constant, target, lower, upper, enforcement (hard or soft), scale,
loss (l1, l2 or huber) and delta; its terms are rows (obs_id, var, coef) of an affine expression over the variables.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from fieldspark.errors import GaugeError, InfeasibleError, InputError
from fieldspark.functions.geometry import with_complement
from fieldspark.operators import functionals, ranking
from fieldspark.sessions import checkpointed

NEAR = 128 * 2.0**-52


def violations(constraints: DataFrame) -> DataFrame:
    """obs_id, problem of every semantic row that is not well formed, and of ids that repeat."""
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    problem = (
        F.when(~F.col("rel").isin("eq", "bound", "cone"), "no such relation")
        .when(~finite("constant"), "constant")
        .when((F.col("rel") == "eq") & ~finite("target"), "target")
        .when((F.col("rel") == "bound") & F.col("lower").isNull() & F.col("upper").isNull(), "no bound")
        .when((F.col("rel") == "bound") & (F.col("lower") > F.col("upper")), "lower above upper")
        .when((F.col("enforcement") == "soft") & ~F.coalesce(F.col("scale") > 0, F.lit(False)), "scale")
        .when((F.col("enforcement") == "soft") & (F.col("loss") == "huber") & ~F.coalesce(F.col("delta") > 0, F.lit(False)), "delta")
        .when(F.count("*").over(Window.partitionBy("obs_id")) > 1, "repeated id")
    )
    return constraints.select("obs_id", problem.alias("problem")).where("problem is not null")


def require_valid(constraints: DataFrame) -> DataFrame:
    first = violations(constraints).orderBy("obs_id").first()
    if first is not None:
        raise InputError(first["problem"], observation=first["obs_id"])
    return constraints


def canonical(constraints: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """eq, bound, cone and soft rows (row, obs_id, var, coef and sides) from semantic ones: a z + q = t becomes a z = t - q,
    bounds move by the constant, cones keep it. Rows are numbered within their class in the order of ord."""
    kind = F.when(F.col("enforcement") == "soft", "soft").otherwise(F.col("rel"))
    numbered = ranking.numbered(constraints.withColumn("cls", kind), ["ord", "obs_id"], "row", within="cls")
    summed = terms.groupBy("obs_id", "var").agg(F.sum("coef").alias("coef")).where("coef <> 0")
    moved = lambda c: numbered.where(F.col("cls") == c).join(summed, "obs_id").select(
        "row", "obs_id", "var", "coef", (F.col("target") - F.col("constant")).alias("rhs"), (F.col("lower") - F.col("constant")).alias("lower"),
        (F.col("upper") - F.col("constant")).alias("upper"), "constant", "scale", "loss", "delta",
    )
    sides = {"eq": ["rhs"], "bound": ["lower", "upper"], "cone": ["constant"], "soft": ["rhs", "lower", "upper", "scale", "loss", "delta"]}
    return {c: moved(c).select("row", "obs_id", "var", "coef", *columns) for c, columns in sides.items()}


def near_duplicates(rows: DataFrame) -> DataFrame:
    """first, second, kind of rows (row, var, coef) that are multiples of one another, scaled by their largest coefficient.
    duplicate: first is the smallest row of the class of exact multiples that second is in; each other row of a class comes
    once. near_duplicate: the smallest rows of two classes within 128 eps, which stand for all their rows' pairs. Classes
    meet by the set of their variables and the rounded ratio of their coefficients, or its neighbour, not as all pairs."""
    largest = rows.groupBy("row").agg(F.max(F.abs("coef")).alias("top"), F.min_by(F.signum("coef"), "var").alias("sign"))
    scaled = rows.join(largest, "row").select("row", "var", (F.col("coef") / F.col("top") * F.col("sign")).alias("c"))
    whole = scaled.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("var", "c"))).alias("entries"))
    classes = whole.groupBy("entries").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    exact = whole.join(classes.where("rows > 1"), "entries").where("row > first").select("first", F.col("row").alias("second"), F.lit("duplicate").alias("kind"))
    shape = F.transform("entries", lambda e: e["var"])
    probe = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["c"] / (F.pmod(F.hash(e["var"]), F.lit(7)) + 1.0))
    cell = F.floor(probe * 1e9)
    keyed = classes.select(F.col("first").alias("row"), "entries", shape.alias("shape"), cell.alias("cell"))
    right = keyed.select(F.col("row").alias("second"), F.col("entries").alias("others"), "shape", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    met = keyed.join(right, ["shape", "cell"]).where("row < second")
    gap = F.array_max(F.zip_with("entries", "others", lambda a, b: F.abs(a["c"] - b["c"])))
    return exact.union(met.select(F.col("row").alias("first"), "second", gap.alias("gap")).where(F.col("gap") <= NEAR).select("first", "second", F.lit("near_duplicate").alias("kind")))


_EXACT = StructType([StructField(n, DoubleType() if n in ("low", "high") else StringType()) for n in ("key", "low", "low_exact", "high", "high_exact")])


@F.pandas_udf(_EXACT)
def _exact(entries: pd.Series, lower: pd.Series, upper: pd.Series) -> pd.DataFrame:
    """A row's direction and interval in exact arithmetic: coefficients and bounds over the first coefficient, as fractions,
    and the bounds rounded, which keeps their order."""
    made = []
    for terms, low, high in zip(entries, lower, upper):
        terms = [(t["var"], Fraction(t["coef"])) for t in terms if t["coef"]]
        top = terms[0][1] if terms else Fraction(1)
        sides = [None if pd.isna(s) else Fraction(s) / top for s in (low, high)]
        low, high = sides if top > 0 else sides[::-1]
        key = ";".join(f"{var}:{coef / top}" for var, coef in terms)
        made.append((key, low if low is None else float(low), low if low is None else str(low), high if high is None else float(high), high if high is None else str(high)))
    return pd.DataFrame(made, columns=["key", "low", "low_exact", "high", "high_exact"])


@F.pandas_udf(BooleanType())
def _above(lows: pd.Series, highs: pd.Series) -> pd.Series:
    return pd.Series([max(map(Fraction, a)) > min(map(Fraction, b)) for a, b in zip(lows, highs)], dtype=bool)


def hard_conflicts(rows: DataFrame) -> DataFrame:
    """row, lower, upper of groups of exactly proportional hard rows (row, var, coef, lower, upper) whose common interval is
    empty; row is the smallest of the group, the interval that of its expression over its first coefficient. Equalities
    have equal sides. A row whose coefficients are all 0 is a constant 0, which its own interval may exclude. Proportions
    and intervals are compared in exact arithmetic: z = 0.3 and 3 z = 0.9 exclude one another in binary numbers."""
    whole = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("var", "coef"))).alias("entries"), F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    exact = checkpointed(whole.select("row", _exact("entries", "lower", "upper").alias("e")).select("row", "e.*"))
    constant = F.col("key") == ""
    zero = exact.where(constant & ((F.col("low") > 0) | (F.col("high") < 0))).select("row", F.col("low").alias("lower"), F.col("high").alias("upper"))
    sides = exact.where(~constant).groupBy("key").agg(F.min("row").alias("row"), F.max("low").alias("lower"), F.min("high").alias("upper"))
    apart = sides.where("lower > upper").select("row", "lower", "upper")
    close = sides.where("lower = upper").select("key", F.col("row").alias("least"), "lower", "upper")
    tied = exact.join(close, "key").groupBy("key", "least", "lower", "upper").agg(
        F.collect_set(F.when(F.col("low") == F.col("lower"), F.col("low_exact"))).alias("lows"), F.collect_set(F.when(F.col("high") == F.col("upper"), F.col("high_exact"))).alias("highs"),
    )
    touching = tied.where(_above("lows", "highs")).select(F.col("least").alias("row"), "lower", "upper")
    return zero.union(apart).union(touching)


def variable_blocks(blocks: DataFrame) -> DataFrame:
    """block, first, length: where each named block of variables begins, in the order of ord. blocks (block, ord, length) is a
    small table; a repeated name or a negative length is an error."""
    bad = blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("length").alias("least")).where("n > 1 or not least >= 0").first()
    if bad is not None:
        raise InputError("a block repeats or has no length", block=bad["block"])
    before = F.sum("length").over(Window.orderBy("ord", "block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("block", F.coalesce(before, F.lit(0)).cast("long").alias("first"), F.col("length").cast("long").alias("length"))


def term_violations(terms: DataFrame, variables: int) -> DataFrame:
    """obs_id, term_idx, problem of affine terms (obs_id, term_idx, var, coef) that are not in strictly ascending order of
    their variables, that are not below ``variables``, or whose coefficient is 0 or not finite."""
    before = F.lag("var").over(Window.partitionBy("obs_id").orderBy("term_idx"))
    coef = F.col("coef")
    problem = (
        F.when(F.col("var").isNull() | (F.col("var") < 0) | (F.col("var") >= variables), "no such variable")
        .when(before >= F.col("var"), "variables are not ascending")
        .when(coef.isNull() | F.isnan("coef") | (F.abs("coef") == float("inf")) | (coef == 0), "coefficient")
    )
    return terms.select("obs_id", "term_idx", problem.alias("problem")).where("problem is not null")


def require_feasible(rows: DataFrame) -> DataFrame:
    first = hard_conflicts(rows).orderBy("row").first()
    if first is not None:
        raise InfeasibleError("proportional rows exclude one another", row=first["row"], lower=first["lower"], upper=first["upper"])
    return rows


# -- bounds on linear functionals


def gap_terms(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """obs_id and the terms of upper - lower: pairs (obs_id, upper_id, lower_id) of expressions, terms (expr_id, ...)."""
    made = [pairs.join(terms, F.col(side) == F.col("expr_id")).select("obs_id", *[(F.col("coef") * sign if c == "coef" else F.col(c)).alias(c) for c in terms.columns if c != "expr_id"]) for side, sign in (("upper_id", 1.0), ("lower_id", -1.0))]
    return made[0].union(made[1])


def lower_linear(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Semantic bound rows from linear constraints (obs_id, ord, kind, value, upper, enforcement, scale, loss, delta) on the
    expressions of terms (expr_id = obs_id, coef, kind, ...). A gap is 0 or more; increasing and decreasing bound a single
    derivative with coefficient 1; anything else is an error that names the observation."""
    kinds = ["lower", "upper", "interval", "inside", "outside", "gap", "increasing", "decreasing"]
    atoms = terms.groupBy(F.col("expr_id").alias("obs_id")).agg(F.count("*").alias("atoms"), F.count_if((F.col("kind") == functionals.DERIVATIVE) & (F.col("coef") == 1.0)).alias("slopes"))
    met = rows.join(atoms, "obs_id", "left")
    single = (F.col("atoms") == 1) & (F.col("slopes") == 1)
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "no such kind").when(F.col("atoms").isNull(), "no terms")
        .when(F.col("kind").isin("gap", "increasing", "decreasing") & ~F.coalesce(F.col("value") >= 0, F.lit(False)), "a gap or rate must be 0 or more")
        .when(F.col("kind").isin("increasing", "decreasing") & ~F.coalesce(single, F.lit(False)), "needs a single derivative with coefficient 1")
    )
    first = met.select("obs_id", problem.alias("problem")).where("problem is not null").orderBy("obs_id").first()
    if first is not None:
        raise InputError(first["problem"], observation=first["obs_id"])
    plain = rows.withColumnRenamed("upper", "__upper")
    made = bounds(plain, F.col("kind"), F.col("value"), F.col("__upper"))
    null = F.lit(None).cast("double")
    return made.select("obs_id", "ord", F.lit("bound").alias("rel"), F.lit(0.0).alias("constant"), null.alias("target"), "lower", "upper", "enforcement", "scale", "loss", "delta")


def compose(field_rows: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of a field's bounds after those of another problem over the same variables, in their order; an observation
    that both have is an error."""
    clash = own.join(field_rows, "obs_id", "left_semi").first()
    if clash is not None:
        raise InputError("an observation is in both", observation=clash["obs_id"])
    last = own.agg(F.max("ord")).first()[0]
    first = field_rows.agg(F.min("ord")).first()[0]
    shift = 0 if last is None or first is None else last + 1 - first
    return own.unionByName(field_rows.withColumn("ord", F.col("ord") + F.lit(shift).cast(dict(own.dtypes)["ord"])))


def bounds(rows: DataFrame, kind: Column, value: Column, upper: Column) -> DataFrame:
    """rows with lower and upper: kind is lower, upper, interval, inside, outside (a side of a level), gap, increasing or
    decreasing (by at least a rate)."""
    low = F.when(kind.isin("lower", "interval", "gap", "increasing", "outside"), value)
    high = F.when(kind == "interval", upper).when(kind.isin("upper", "inside"), value).when(kind == "decreasing", -value)
    return rows.select("*", low.alias("lower"), high.alias("upper"))


# -- observations of gradients


def normal_rows(observations: DataFrame, normal: Sequence[str], mode: str, least: Column | None = None, angle: Column | None = None) -> DataFrame:
    """obs_id, row, rel, coefficients c0 ..., lower, upper of unit normals. mode: gradient (each component equals the
    normal's times ``least``), axial (no gradient across), polarity (and at least ``least`` along), cone (within an angle in
    degrees of the normal, the first row the bound of the cone's norm)."""
    dim = len(normal)
    if mode in ("axial", "polarity", "cone"):
        if dim == 1:
            raise InputError("a direction needs two dimensions")
        observations = with_complement(observations, normal)
    n = [F.col(c) for c in normal]
    basis = [[F.col(f"__t_{which}_{k}") for k in range(dim)] for which in range(dim - 1)]
    zero = F.lit(0.0)
    row = lambda rel, c, low, high: F.struct(F.lit(rel).alias("rel"), *[(x + zero).alias(f"c{k}") for k, x in enumerate(c)], F.coalesce(low, F.lit(None).cast("double")).alias("lower"), F.coalesce(high, F.lit(None).cast("double")).alias("upper"))
    null = F.lit(None).cast("double")
    if mode == "gradient":
        made = [row("eq", [F.lit(1.0 if i == k else 0.0) for i in range(dim)], n[k] * least, n[k] * least) for k in range(dim)]
    elif mode in ("axial", "polarity"):
        made = [row("eq", t, zero, zero) for t in basis]
        if mode == "polarity":
            made.append(row("bound", n, least, null))
    elif mode == "cone":
        slope = F.tan(F.radians(angle))
        made = [row("cone", [c * slope for c in n], null, null), *[row("cone", t, null, null) for t in basis], row("bound", n, least, null)]
    else:
        raise InputError("no such mode", mode=mode)
    spread = observations.select("obs_id", F.posexplode(F.array(*made)).alias("row", "made"))
    return spread.select("obs_id", "row", "made.*")


def near_zero_gradients(rows: DataFrame, gradient: Sequence[str], reference: Column, relative: float) -> DataFrame:
    """rows with norm and near_zero: whether the gradient's norm is at most ``relative`` of the reference. Nothing is changed."""
    if not 0 <= relative < float("inf"):
        raise InputError("the relative threshold must be 0 or more and finite", relative=relative)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in gradient[1:]), F.col(gradient[0]) * F.col(gradient[0])))
    return rows.select("*", norm.alias("norm"), (norm <= reference * relative).alias("near_zero"))


def soft_normal_violations(observations: DataFrame, dimension: int, mode: str) -> DataFrame:
    """obs_id, problem of soft normals (enforcement, loss) that cannot be: in three dimensions the two rows across a normal
    depend on the choice of their basis unless the loss is l2."""
    across = dimension == 3 and mode in ("axial", "polarity")
    bad = (F.col("enforcement") == "soft") & ~F.coalesce(F.col("loss") == "l2", F.lit(False)) & F.lit(across)
    return observations.where(bad).select("obs_id", F.lit("only l2 does not depend on the basis").alias("problem"))


def tangent_rows(observations: DataFrame, place: Sequence[str], tangent: Sequence[str], anchor: tuple[int, Sequence[float], float] | None) -> tuple[DataFrame, DataFrame]:
    """Semantic rows and terms of tangents, no slope along each, and of the anchor (obs_id, place, value), a hard value that
    comes last: derivatives alone leave the field's level open, so without it there is a GaugeError. observations have
    obs_id, ord, enforcement, scale, loss and delta; a tangent of length 0 is an error."""
    flat = observations.where(" and ".join(f"coalesce({t}, 0) = 0" for t in tangent)).first()
    if flat is not None:
        raise InputError("a tangent has no direction", observation=flat["obs_id"])
    if anchor is None:
        raise GaugeError("derivatives alone leave the level open; give an anchor")
    spark, (anchor_id, at, value) = observations.sparkSession, anchor
    if observations.where(F.col("obs_id") == anchor_id).first() is not None:
        raise InputError("the anchor repeats an observation", observation=anchor_id)
    null = F.lit(None).cast("double")
    row = lambda target: [F.lit("eq").alias("rel"), F.lit(0.0).alias("constant"), F.lit(target).alias("target"), null.alias("lower"), null.alias("upper")]
    rows = observations.select("obs_id", F.col("ord").cast("long").alias("ord"), *row(0.0), "enforcement", F.col("scale").cast("double").alias("scale"), "loss", F.col("delta").cast("double").alias("delta"))
    last = observations.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).cast("long").alias("ord"))
    text = F.lit(None).cast("string")
    own = last.select(F.lit(anchor_id).cast("long").alias("obs_id"), "ord", *row(float(value)), F.lit("hard").alias("enforcement"), null.alias("scale"), text.alias("loss"), null.alias("delta"))
    n = range(len(place))
    terms = observations.select(F.col("obs_id").alias("expr_id"), F.lit(1.0).alias("coef"), F.lit(functionals.DERIVATIVE).alias("kind"), *[F.col(place[k]).alias(f"x{k}") for k in n], *[F.col(tangent[k]).alias(f"u{k}") for k in n])
    point = spark.range(1).select(F.lit(anchor_id).cast("long").alias("expr_id"), F.lit(1.0).alias("coef"), F.lit(functionals.VALUE).alias("kind"), *[F.lit(float(at[k])).alias(f"x{k}") for k in n], *[F.lit(0.0).alias(f"u{k}") for k in n])
    return rows.union(own), terms.union(point)


#: What a thickness is, by how it was found.
THICKNESS_LABELS = {"gap": "ScalarLevelGap", "cone": "SampledLocalNormalCone", "validation": "SampledGeometricValidation"}


def labelled_thickness(rows: DataFrame, how: str) -> DataFrame:
    """rows with label: a gap of levels, a cone at sampled places, or a validation by search are not the same thickness."""
    if how not in THICKNESS_LABELS:
        raise InputError("no such thickness", how=how)
    return rows.withColumn("label", F.lit(THICKNESS_LABELS[how]))


def thickness_cones(locations: DataFrame, thickness: Column, dimension: int) -> DataFrame:
    """obs_id, row, axis, coef: thickness times the gradient's norm at most the gap of two levels, a Lorentz cone of
    dimension + 1 rows for each location; row 0 is the gap."""
    rows = [F.struct(F.lit(k).alias("row"), F.lit(k - 1).alias("axis"), (F.lit(1.0) if k == 0 else thickness).alias("coef")) for k in range(dimension + 1)]
    return locations.select("obs_id", F.explode(F.array(*rows)).alias("r")).select("obs_id", "r.*")
