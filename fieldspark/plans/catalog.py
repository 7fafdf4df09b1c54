"""Queries over the relational tables, one or more for each operator, and the same results in DuckDB SQL.

Floating results are rounded to six places on both sides: the engines' exp and ln differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions import geometry as G
from fieldspark.functions import polynomials
from fieldspark.functions.kernels import Anisotropy, Kernel, distance, jet, metric_review
from fieldspark.operators import constraints, convex, fields, functionals, levels, levelsets, neighbors, projects, ranking, selection, sparsefactor, tensors, trends
from fieldspark.plans import points as P
from fieldspark.sessions import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(column: Column, name: str) -> Column:
    return (F.round(column, 6) + 0.0).alias(name)


def s6(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


PTS1 = "(SELECT CAST(p_size AS DOUBLE) AS x0, avg(p_retailprice) / 997 AS y FROM part GROUP BY p_size)"
SUPPLIERS = "(SELECT s_suppkey AS idx, CAST(s_nationkey AS DOUBLE) AS x0, s_acctbal / 1000 AS x1 FROM supplier)"
CUSTOMERS = "(SELECT c_custkey AS idx, CAST(c_nationkey AS DOUBLE) AS x0, c_acctbal / 1000 AS x1 FROM customer)"
TRIPLES = "(SELECT l_quantity AS x0, round(l_discount * 100) + 0.0 AS x1, round(l_tax * 100) + 0.0 AS x2, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2, 3)"
GRID = f"(SELECT CAST(x0 * 10000 + x1 * 100 + x2 AS BIGINT) AS idx, * FROM {TRIPLES})"
DIRS2 = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_discount / sqrt(l_discount ** 2 + l_tax ** 2) AS u0, l_tax / sqrt(l_discount ** 2 + l_tax ** 2) AS u1, l_quantity AS w FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0)"
LEN3 = "sqrt(l_quantity ** 2 + (100 * l_discount) ** 2 + (100 * l_tax) ** 2)"
DIRS3 = f"(SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / {LEN3} AS u0, 100 * l_discount / {LEN3} AS u1, 100 * l_tax / {LEN3} AS u2, l_quantity AS w FROM lineitem WHERE l_quantity <> 0 OR l_discount <> 0 OR l_tax <> 0)"

# -- geometry and orientations


@query("unit_normalize_d2", f"SELECT l_orderkey, l_linenumber, {s6('u0', 'u0')}, {s6('u1', 'u1')} FROM {DIRS2}")
def unit_normalize_d2(spark, sf):
    return P.directions(spark, sf, 2).select("l_orderkey", "l_linenumber", r6(F.col("u0"), "u0"), r6(F.col("u1"), "u1"))


@query("unit_normalize_d3", f"SELECT l_orderkey, l_linenumber, {s6('u0', 'u0')}, {s6('u1', 'u1')}, {s6('u2', 'u2')} FROM {DIRS3}")
def unit_normalize_d3(spark, sf):
    return P.directions(spark, sf, 3).select("l_orderkey", "l_linenumber", *[r6(F.col(f"u{k}"), f"u{k}") for k in range(3)])


_S, _D = "radians((l_partkey % 360 + 90) % 360)", "radians(l_suppkey % 91)"


@query("orientation_strike_dip", f"SELECT l_orderkey, l_linenumber, {s6(f'sin({_D}) * sin({_S})', 'n0')}, {s6(f'sin({_D}) * cos({_S})', 'n1')}, {s6(f'cos({_D})', 'n2')} FROM lineitem")
def orientation_strike_dip(spark, sf):
    rows = P.table(spark, sf, "lineitem")
    n = G.strike_dip(F.pmod(F.col("l_partkey"), F.lit(360)).cast("double"), F.pmod(F.col("l_suppkey"), F.lit(91)).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(c, f"n{k}") for k, c in enumerate(n)])


_A, _P = "radians(l_partkey % 360)", "radians(l_suppkey % 181 - 90)"


@query("orientation_azimuth_plunge", f"SELECT l_orderkey, l_linenumber, {s6(f'cos({_P}) * sin({_A})', 'n0')}, {s6(f'cos({_P}) * cos({_A})', 'n1')}, {s6(f'-sin({_P})', 'n2')} FROM lineitem")
def orientation_azimuth_plunge(spark, sf):
    rows = P.table(spark, sf, "lineitem")
    n = G.azimuth_plunge(F.pmod(F.col("l_partkey"), F.lit(360)).cast("double"), (F.pmod(F.col("l_suppkey"), F.lit(181)) - 90).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(c, f"n{k}") for k, c in enumerate(n)])


@query("orientation_signed_dip", f"SELECT l_orderkey, l_linenumber, {s6(f'sin({_P}) * sign', 'n0')}, {s6(f'cos({_P}) * sign', 'n1')} FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lineitem)")
def orientation_signed_dip(spark, sf):
    rows = P.table(spark, sf, "lineitem")
    n = G.with_polarity(G.signed_dip((F.pmod(F.col("l_suppkey"), F.lit(181)) - 90).cast("double")), F.when(F.col("l_returnflag") == "R", "negative").otherwise("unknown"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(c, f"n{k}") for k, c in enumerate(n)])


@query("orientation_plunge", f"SELECT l_orderkey, l_linenumber, {s6(f'cos({_P})', 'n0')}, {s6(f'-sin({_P})', 'n1')} FROM lineitem")
def orientation_plunge(spark, sf):
    rows = P.table(spark, sf, "lineitem")
    n = G.plunge((F.pmod(F.col("l_suppkey"), F.lit(181)) - 90).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(c, f"n{k}") for k, c in enumerate(n)])


@query("orientation_violations", "SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS id, unnest([{'field': 'strike', 'value': CAST(l_partkey % 400 AS DOUBLE), 'bad': l_partkey % 400 >= 360}, {'field': 'dip', 'value': CAST(l_suppkey AS DOUBLE), 'bad': l_suppkey > 90}, {'field': 'plunge', 'value': l_quantity * 4 - 100, 'bad': l_quantity * 4 - 100 > 90 OR l_quantity * 4 - 100 < -90}], recursive := true) FROM lineitem) WHERE bad".replace("SELECT * FROM (", "SELECT id, field, value FROM ("))
def orientation_violations(spark, sf):
    rows = P.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 400).cast("double").alias("strike"), F.col("l_suppkey").cast("double").alias("dip"), (F.col("l_quantity") * 4 - 100).alias("plunge"))
    return G.angle_violations(rows, {"strike": "full", "dip": "dip", "plunge": "signed"}, "id")


@query("frame_ordered", f"SELECT idx, x1 AS east, x0 AS north, {s6('degrees(x0)', 'angle')} FROM {CUSTOMERS}")
def frame_ordered(spark, sf):
    """Columns that come as (north, east), angles that come in radians."""
    frame = G.Frame("metre", "radians", epsg=32633, axis_order=(1, 0))
    east, north = frame.ordered(["x0", "x1"])
    return P.customers(spark, sf).select("idx", east.alias("east"), north.alias("north"), r6(frame.degrees(F.col("x0")), "angle"))


AFFINE = G.Affine((4.0, -3.0), ((2.0, 1.0), (0.0, 0.5)))  # its inverse: ((0.5, -1), (0, 2))


@query("affine_normalize_point", f"SELECT idx, {s6('0.5 * (x0 - 4) - (x1 + 3)', 'z0')}, {s6('2 * (x1 + 3)', 'z1')}, {s6('x0', 'back0')}, {s6('x1', 'back1')} FROM {CUSTOMERS}")
def affine_normalize_point(spark, sf):
    z = AFFINE.normalize([F.col("x0"), F.col("x1")])
    back = AFFINE.denormalize(z)
    return P.customers(spark, sf).select("idx", r6(z[0], "z0"), r6(z[1], "z1"), r6(back[0], "back0"), r6(back[1], "back1"))


@query("affine_gradient", f"SELECT idx, {s6('0.5 * x0', 'g0')}, {s6('2 * x1 - x0', 'g1')} FROM {CUSTOMERS}")
def affine_gradient(spark, sf):
    g = AFFINE.gradient([F.col("x0"), F.col("x1")])
    return P.customers(spark, sf).select("idx", r6(g[0], "g0"), r6(g[1], "g1"))


@query("affine_hessian", f"SELECT idx, {s6('0.25 * x0', 'h00')}, {s6('x1 - 0.5 * x0', 'h01')}, {s6('x0 - 4 * x1 + 4', 'h11')} FROM {CUSTOMERS}")
def affine_hessian(spark, sf):
    h = AFFINE.hessian([[F.col("x0"), F.col("x1")], [F.col("x1"), F.lit(1.0)]])
    return P.customers(spark, sf).select("idx", r6(h[0][0], "h00"), r6(h[0][1], "h01"), r6(h[1][1], "h11"))


# -- kernels

L = 1.7
_Q, _H2 = f"(r / {L})", f"(1 + r * r / {L * L})"
_T3, _T5 = f"(sqrt(3) * r / {L})", f"(sqrt(5) * r / {L})"
RHO = 2.5
_W, _WT = f"(r / {RHO})", f"(greatest(1 - r / {RHO}, 0))"
#: name: kernel, and SQL of phi, its first and its second derivative at r > 0
KERNELS = {
    "gaussian": (Kernel("gaussian", L), f"exp(-({_Q} ** 2) / 2)", f"-{_Q} / {L} * exp(-({_Q} ** 2) / 2)", f"({_Q} ** 2 - 1) / {L * L} * exp(-({_Q} ** 2) / 2)"),
    "imq": (Kernel("imq", L), f"{_H2} ** -0.5", f"-{_Q} / {L} * {_H2} ** -1.5", f"(2 * {_Q} ** 2 - 1) / {L * L} * {_H2} ** -2.5"),
    "mq": (Kernel("mq", L), f"-sqrt({_H2})", f"-{_Q} / {L} / sqrt({_H2})", f"-({_H2} ** -1.5) / {L * L}"),
    "matern12": (Kernel("matern12", L), f"exp(-{_Q})", f"-exp(-{_Q}) / {L}", f"exp(-{_Q}) / {L * L}"),
    "matern32": (Kernel("matern32", L), f"(1 + {_T3}) * exp(-{_T3})", f"-3 * r / {L * L} * exp(-{_T3})", f"3 / {L * L} * ({_T3} - 1) * exp(-{_T3})"),
    "matern52": (Kernel("matern52", L), f"(1 + {_T5} + {_T5} ** 2 / 3) * exp(-{_T5})", f"-5 * r / {3 * L * L} * (1 + {_T5}) * exp(-{_T5})", f"5 / {3 * L * L} * ({_T5} ** 2 - {_T5} - 1) * exp(-{_T5})"),
    "phs1": (Kernel("phs", 1), "-r", "-1.0", "0.0"),
    "phs2": (Kernel("phs", 2), "r * r * ln(r)", "r * (2 * ln(r) + 1)", "2 * ln(r) + 3"),
    "phs3": (Kernel("phs", 3), "r ** 3", "3 * r * r", "6 * r"),
    "phs4": (Kernel("phs", 4), "-(r ** 4) * ln(r)", "-(r ** 3) * (4 * ln(r) + 1)", "-r * r * (12 * ln(r) + 7)"),
    "phs5": (Kernel("phs", 5), "-(r ** 5)", "-5 * r ** 4", "-20 * r ** 3"),
    "surface_d2m2": (Kernel.surface_spline(2, 2), "r * r * ln(r)", "r * (2 * ln(r) + 1)", "2 * ln(r) + 3"),
    "wendland_c2": (Kernel("wendland_c2", RHO), f"{_WT} ** 4 * (1 + 4 * {_W})", f"-20 * {_W} / {RHO} * {_WT} ** 3", f"20 / {RHO * RHO} * (4 * {_W} - 1) * {_WT} ** 2"),
    "wendland_c4": (Kernel("wendland_c4", RHO), f"{_WT} ** 6 * (1 + 6 * {_W} + 35 * {_W} ** 2 / 3)", f"-56.0 / 3 * {_W} / {RHO} * (1 + 5 * {_W}) * {_WT} ** 5", f"-56.0 / 3 / {RHO * RHO} * (1 + 4 * {_W} - 35 * {_W} ** 2) * {_WT} ** 4"),
    "wendland_c6": (Kernel("wendland_c6", RHO), f"{_WT} ** 8 * (1 + 8 * {_W} + 25 * {_W} ** 2 + 32 * {_W} ** 3)", f"-22 * {_W} / {RHO} * (1 + 7 * {_W} + 16 * {_W} ** 2) * {_WT} ** 7", f"-22 / {RHO * RHO} * (1 + 6 * {_W} - 15 * {_W} ** 2 - 160 * {_W} ** 3) * {_WT} ** 6"),
}


def _kernel_query(kernel: Kernel) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = F.sqrt(F.pow("x0", 2) + F.pow("x1", 2)) / 5 + 0.01
        parts = kernel.radial(F.col("r"))
        return P.customers(spark, sf).select("idx", r.alias("r")).select("idx", *[r6(parts[k], k) for k in ("phi", "d1", "d2")])

    return run


for _name, (_kernel, _phi, _d1, _d2) in KERNELS.items():
    query(f"kernel_{_name}", f"SELECT idx, {s6(_phi, 'phi')}, {s6(_d1, 'd1')}, {s6(_d2, 'd2')} FROM (SELECT idx, sqrt(x0 ** 2 + x1 ** 2) / 5 + 0.01 AS r FROM {CUSTOMERS})")(_kernel_query(_kernel))


def _jet_sql(dim: int, phi: str, a: str, curve: str) -> str:
    """curve: (phi'' - a) / r^2, so that the Hessian is curve d d' + a I."""
    g = ", ".join(s6(f"{a} * d{i}", f"g{i}") for i in range(dim))
    h = ", ".join(s6(f"{curve} * d{i} * d{j}" + (f" + {a}" if i == j else ""), f"h{i}{j}") for i in range(dim) for j in range(i, dim))
    return f"{s6(phi, 'value')}, {g}, {h}"


JETS = {
    "gaussian": (Kernel("gaussian", 3.0), "exp(-r * r / 18)", "(-exp(-r * r / 18) / 9)", "(exp(-r * r / 18) / 81)"),
    "imq": (Kernel("imq", 3.0), "(1 + r * r / 9) ** -0.5", "(-((1 + r * r / 9) ** -1.5) / 9)", "(3 * (1 + r * r / 9) ** -2.5 / 81)"),
    "matern52": (Kernel("matern52", 3.0), "(1 + sqrt(5) * r / 3 + 5 * r * r / 27) * exp(-sqrt(5) * r / 3)", "(-5.0 / 27 * (1 + sqrt(5) * r / 3) * exp(-sqrt(5) * r / 3))", "(25.0 / 243 * exp(-sqrt(5) * r / 3))"),
    "phs5": (Kernel("phs", 5), "-((r / 10) ** 5)", None, None),
}
_CENTER = (12.0, 5.0, 4.0)


def _jet_query(kernel: Kernel, dim: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = jet(kernel, [F.col(f"x{k}") - _CENTER[k] for k in range(dim)], 2)
        columns = [r6(made["value"], "value"), *[r6(g, f"g{i}") for i, g in enumerate(made["g"])], *[r6(made["h"][i][j], f"h{i}{j}") for i in range(dim) for j in range(i, dim)]]
        return P.grid(spark, sf).select("idx", *columns)

    return run


for _name, (_kernel, _phi, _a, _curve) in JETS.items():
    if _a is not None:
        for _dim in (1, 2, 3):
            _d = ", ".join(f"x{k} - {_CENTER[k]} AS d{k}" for k in range(_dim))
            _r = " + ".join(f"(x{k} - {_CENTER[k]}) ** 2" for k in range(_dim))
            query(f"kernel_jet_{_name}_d{_dim}", f"SELECT idx, {_jet_sql(_dim, _phi, _a, _curve)} FROM (SELECT idx, {_d}, sqrt({_r}) AS r FROM {GRID})")(_jet_query(_kernel, _dim))


_D3 = [(i, j, l) for i in range(3) for j in range(i, 3) for l in range(j, 3)]  # noqa: E741
_THIRD = lambda i, j, l: f"exp(-r2 / 18) * ({' + '.join([f'd{l} / 81' if i == j else '0', f'd{j} / 81' if i == l else '0', f'd{i} / 81' if j == l else '0'])} - d{i} * d{j} * d{l} / 729)"  # noqa: E731, E741


@query("kernel_third_gaussian_d3", f"SELECT idx, {', '.join(s6(_THIRD(*n), 't' + ''.join(map(str, n))) for n in _D3)} FROM (SELECT *, d0 * d0 + d1 * d1 + d2 * d2 AS r2 FROM (SELECT idx, x0 - 12 AS d0, x1 - 5 AS d1, x2 - 4 AS d2 FROM {GRID}))")
def kernel_third_gaussian_d3(spark, sf):
    made = jet(Kernel("gaussian", 3.0), [F.col(f"x{k}") - _CENTER[k] for k in range(3)], 3)["t"]
    return P.grid(spark, sf).select("idx", *[r6(made[i][j][l], f"t{i}{j}{l}") for i, j, l in _D3])  # noqa: E741


#: A' A of the ellipsoid with axes (0.6, 0.8) and (-0.8, 0.6) and lengths 5 and 2
_B = {(0, 0): 0.1744, (0, 1): -0.1008, (1, 1): 0.1156}
_BD = ("(0.1744 * d0 - 0.1008 * d1)", "(0.1156 * d1 - 0.1008 * d0)")
_E = f"exp(-(d0 * {_BD[0]} + d1 * {_BD[1]}) / 2)"
_D2 = [(i, j, l) for i in range(2) for j in range(i, 2) for l in range(j, 2)]  # noqa: E741
_B3 = lambda i, j, l: f"{_E} * ({_B[i, j]} * {_BD[l]} + {_B[i, l]} * {_BD[j]} + {_B[j, l]} * {_BD[i]} - {_BD[i]} * {_BD[j]} * {_BD[l]})"  # noqa: E731, E741


@query(
    "aniso_jet_ellipsoidal",
    f"SELECT idx, {s6(f'-{_BD[0]} * {_E}', 'g0')}, {s6(f'-{_BD[1]} * {_E}', 'g1')}, " + ", ".join(s6(f"({_BD[i]} * {_BD[j]} - ({_B[i, j]})) * {_E}", f"h{i}{j}") for i, j in _B) + ", "
    + ", ".join(s6(_B3(*n), "t" + "".join(map(str, n))) for n in _D2) + f" FROM (SELECT idx, x0 - 12 AS d0, x1 - 4 AS d1 FROM {CUSTOMERS})",
)
def aniso_jet_ellipsoidal(spark, sf):
    made = jet(Kernel("gaussian", 1.0), [F.col("x0") - 12.0, F.col("x1") - 4.0], 3, Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (5.0, 2.0)))
    columns = [r6(g, f"g{i}") for i, g in enumerate(made["g"])] + [r6(made["h"][i][j], f"h{i}{j}") for i, j in _B] + [r6(made["t"][i][j][l], f"t{i}{j}{l}") for i, j, l in _D2]  # noqa: E741
    return P.customers(spark, sf).select("idx", *columns)


ANISOTROPIES = {
    "isotropic": (Anisotropy.isotropic(2, 2.0), "sqrt(d0 ** 2 + d1 ** 2) / 2"),
    "spheroidal": (Anisotropy.spheroidal((0.0, 1.0), 5.0, 2.0), "sqrt((d0 / 2) ** 2 + (d1 / 5) ** 2)"),
    "ellipsoidal": (Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (5.0, 2.0)), "sqrt(((0.6 * d0 + 0.8 * d1) / 5) ** 2 + ((0.6 * d1 - 0.8 * d0) / 2) ** 2)"),
}


def _anisotropy_query(a: Anisotropy) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        z = a.separation([F.col("x0") - 12.0, F.col("x1") - 4.0])
        return P.customers(spark, sf).select("idx", r6(distance(z), "r"))

    return run


for _name, (_a, _sql) in ANISOTROPIES.items():
    query(f"aniso_distance_{_name}", f"SELECT idx, {s6(_sql, 'r')} FROM (SELECT idx, x0 - 12 AS d0, x1 - 4 AS d1 FROM {CUSTOMERS})")(_anisotropy_query(_a))

# -- polynomials and functionals

_X = {1: ["x0"], 2: ["x0", "x1"], 3: ["x0", "x1", "x2"]}


def _basis_query(dim: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = polynomials.values([F.col(c) / 10 for c in _X[dim]], 3)
        return P.grid(spark, sf).select("idx", *[r6(m, f"p{k}") for k, m in enumerate(made)])

    return run


for _dim in (1, 2, 3):
    _terms = [" * ".join(["1.0", *[f"x{k} / 10" for k, n in enumerate(e) for _ in range(n)]]) for e in polynomials.exponents(_dim, 3)]
    query(f"poly_basis_d{_dim}", f"SELECT idx, {', '.join(s6(t, f'p{k}') for k, t in enumerate(_terms))} FROM {GRID}")(_basis_query(_dim))


@query("poly_gradient_d2", f"SELECT idx, {s6('x0 / 5', 'g3_0')}, {s6('x1 / 10', 'g4_0')}, {s6('x0 / 10', 'g4_1')}, {s6('x1 / 5', 'g5_1')} FROM {CUSTOMERS}")
def poly_gradient_d2(spark, sf):
    g = polynomials.gradients([F.col("x0") / 10, F.col("x1") / 10], 3)
    return P.customers(spark, sf).select("idx", r6(g[3][0], "g3_0"), r6(g[4][0], "g4_0"), r6(g[4][1], "g4_1"), r6(g[5][1], "g5_1"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A functional for each order: values at its odd lines' quantities and derivatives at its even ones'."""
    odd = F.col("l_linenumber") % 2 == 1
    return P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("expr_id"), F.when(odd, F.col("l_discount")).otherwise(F.col("l_tax")).alias("coef"), F.when(odd, functionals.VALUE).otherwise(functionals.DERIVATIVE).alias("kind"),
        F.col("l_quantity").alias("x0"), F.lit(1.0).alias("u0"),
    )


@query("functional_samples", f"SELECT l_orderkey, count(*) AS terms, {s6('sum(CASE WHEN l_linenumber % 2 = 1 THEN l_discount * l_quantity ELSE l_tax * 2 * l_quantity END)', 'value')} FROM lineitem GROUP BY l_orderkey")
def functional_samples(spark, sf):
    """Functionals of a field sampled at the lines: its value is the quantity there, its gradient twice that."""
    made = functionals.apply_to_samples(_lines(spark, sf), F.col("x0"), [F.col("x0") * 2.0])
    return made.select(F.col("expr_id").alias("l_orderkey"), "terms", r6(F.col("value"), "value"))


@query(
    "functional_polynomial",
    f"SELECT l_orderkey, k, {s6('sum(CASE WHEN l_linenumber % 2 = 1 THEN l_discount * CASE k WHEN 0 THEN 1 WHEN 1 THEN x ELSE x * x END ELSE l_tax * CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 * x END END)', 'v')} "
    "FROM (SELECT *, l_quantity / 10 AS x FROM lineitem) CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY 1, 2",
)
def functional_polynomial(spark, sf):
    made = functionals.apply_to_polynomials(_lines(spark, sf).withColumn("x0", F.col("x0") / 10), 1, 3)
    return made.select(F.col("expr_id").alias("l_orderkey"), "k", r6(F.col("v"), "v"))


@query("functional_order", "SELECT l_orderkey, CAST(max(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS derivatives FROM lineitem GROUP BY 1")
def functional_order(spark, sf):
    return functionals.derivative_order(_lines(spark, sf)).select(F.col("expr_id").alias("l_orderkey"), "derivatives")


def _slopes(spark: SparkSession, sf: str) -> DataFrame:
    """A functional for each size: the value and half the derivative there."""
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("coef"), F.lit(functionals.VALUE).alias("kind")), F.struct(F.lit(0.5).alias("coef"), F.lit(functionals.DERIVATIVE).alias("kind")))).alias("t")
    return P.pts1(spark, sf).select("field_id", F.col("idx").alias("expr_id"), "x0", F.lit(1.0).alias("u0"), both).select("field_id", "expr_id", "x0", "u0", "t.*")


@query("functional_kernel", f"WITH p AS (SELECT row_number() OVER (ORDER BY x0) - 1 AS i, x0 FROM {PTS1}) SELECT a.i AS i, b.i AS j, {s6('exp(-((a.x0 - b.x0) ** 2) / 50) * (1 + 0.25 * (1.0 / 25 - (a.x0 - b.x0) ** 2 / 625))', 'v')} FROM p a, p b")
def functional_kernel(spark, sf):
    terms = _slopes(spark, sf)
    made = functionals.apply_to_kernel(terms, terms, Kernel("gaussian", 5.0), 1)
    return made.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("v"), "v"))


@query("fit_gradient_reproduction", f"SELECT idx, {s6('1 + x0 / 10 - 2 * (x0 / 10) ** 2', 'f')}, {s6('1 - 4 * x0 / 10', 'f_0')}, -4.0 AS f_00 FROM {CUSTOMERS}")
def fit_gradient_reproduction(spark, sf):
    """A quadratic comes back from its values at even sizes and its derivatives at odd ones."""
    odd, x = F.col("x0") % 2 == 1, F.col("x0") / 10
    centers = P.pts1(spark, sf).select("field_id", F.col("idx").alias("expr_id"), odd.alias("odd"), x.alias("x0")).persist()
    x = F.col("x0")
    observed = centers.select("field_id", "expr_id", F.when(F.col("odd"), 1 - 4 * x).otherwise(1 + x - 2 * x * x).alias("y"))
    terms = centers.select("field_id", "expr_id", F.lit(1.0).alias("coef"), F.when(F.col("odd"), functionals.DERIVATIVE).otherwise(functionals.VALUE).alias("kind"), "x0", F.lit(1.0).alias("u0"))
    field = functionals.fit_functional_field(observed, terms, Kernel("phs", 5), 1)
    rows = P.customers(spark, sf).select("idx", (F.col("x0") / 10).alias("x0"))
    made = field.evaluate(rows, order=2)
    return made.select("idx", *[r6(F.col(c), c) for c in ("f", "f_0", "f_00")])


# -- matrices and fits

MATERN, MATERN_L = Kernel("matern12", 5.0), 5.0


@query("gram_upper", f"SELECT a.x0 AS a0, b.x0 AS b0, {s6('exp(-((b.x0 - a.x0) ** 2) / 50)', 'v')} FROM {PTS1} a JOIN {PTS1} b ON a.x0 <= b.x0")
def gram_upper(spark, sf):
    centers = P.pts1(spark, sf).persist()
    pairs = fields.kernel_pairs(centers, Kernel("gaussian", 5.0), 1)
    a, b = centers.select(F.col("idx").alias("i"), F.col("x0").alias("a0")), centers.select(F.col("idx").alias("j"), F.col("x0").alias("b0"))
    return pairs.join(a, "i").join(b, "j").select("a0", "b0", r6(F.col("v"), "v"))


@query(
    "gram_cpd_augmented",
    f"WITH p AS (SELECT row_number() OVER (ORDER BY x0) - 1 AS i, x0 / 10 AS x FROM (SELECT x0 FROM {PTS1})), n AS (SELECT count(*) AS n FROM p) "
    f"SELECT a.i AS i, b.i AS j, {s6('abs(a.x - b.x) ** 3', 'v')} FROM p a, p b UNION ALL SELECT i, n, 1.0 FROM p, n UNION ALL SELECT i, n + 1, {s6('x', 'v')} FROM p, n "
    f"UNION ALL SELECT n, i, 1.0 FROM p, n UNION ALL SELECT n + 1, i, {s6('x', 'v')} FROM p, n",
)
def gram_cpd_augmented(spark, sf):
    centers = P.pts1(spark, sf).withColumn("x0", F.col("x0") / 10)
    return fields.augmented(centers, Kernel("phs", 3), 1).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("v"), "v"))


def _sides(sql: str) -> str:
    return f"SELECT x0, y, lag(x0) OVER w AS xl, lag(y) OVER w AS yl, lead(x0) OVER w AS xr, lead(y) OVER w AS yr FROM {sql} WINDOW w AS (ORDER BY x0)"


@query(
    "fit_matern12_weights",
    f"SELECT x0, {s6('y + coalesce((a * a * y - a * yl) / (1 - a * a), 0) + coalesce((b * b * y - b * yr) / (1 - b * b), 0)', 'w')} FROM (SELECT *, exp(-(x0 - xl) / {MATERN_L}) AS a, exp(-(xr - x0) / {MATERN_L}) AS b FROM ({_sides(PTS1)}))",
)
def fit_matern12_weights(spark, sf):
    centers = P.pts1(spark, sf).persist()
    return fields.fit(centers, MATERN, 1).join(centers, ["field_id", "idx"]).select("x0", r6(F.col("value"), "w"))


def matern_field(spark: SparkSession, sf: str) -> fields.FittedField:
    return fields.fit_field(P.pts1(spark, sf).persist(), MATERN, 1)


_BETWEEN = f"SELECT q.*, p.* FROM q JOIN ({_sides(PTS1)}) p ON (q.x >= p.x0 AND (q.x < p.xr OR p.xr IS NULL)) OR (p.xl IS NULL AND q.x < p.x0)"
_SINH = f"CASE WHEN xr IS NULL OR x < x0 THEN y * exp(-abs(x - x0) / {MATERN_L}) ELSE (sinh((xr - x) / {MATERN_L}) * y + sinh((x - x0) / {MATERN_L}) * yr) / sinh((xr - x0) / {MATERN_L}) END"


@query("fit_matern12_eval", f"WITH q AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT x AS l_quantity, n, {s6(_SINH, 'field_value')} FROM ({_BETWEEN})")
def fit_matern12_eval(spark, sf):
    """The flagship: a field through mean prices by size, at every quantity that line items have."""
    counted = P.table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return matern_field(spark, sf).evaluate(counted, ["l_quantity"]).select("l_quantity", "n", r6(F.col("f"), "field_value"))


@query("eval_batch_value", f"WITH q AS (SELECT event_id, abs(value) % 60 AS x FROM events WHERE value IS NOT NULL) SELECT event_id, {s6(_SINH, 'f')} FROM ({_BETWEEN})")
def eval_batch_value(spark, sf):
    rows = P.table(spark, sf, "events").where("value is not null").select("event_id", (F.abs("value") % 60).alias("x"))
    return matern_field(spark, sf).evaluate(rows, ["x"]).select("event_id", r6(F.col("f"), "f"))


_CLAMPED = "CASE WHEN xr IS NULL OR x < x0 THEN y ELSE y + (yr - y) * (x - x0) / (xr - x0) END"


@query("fit_phs1_eval", f"WITH q AS (SELECT event_id, abs(value) % 60 AS x FROM events WHERE value IS NOT NULL) SELECT event_id, {s6(_CLAMPED, 'f')} FROM ({_BETWEEN})")
def fit_phs1_eval(spark, sf):
    rows = P.table(spark, sf, "events").where("value is not null").select("event_id", (F.abs("value") % 60).alias("x"))
    return fields.fit_field(P.pts1(spark, sf).persist(), Kernel("phs", 1), 1).evaluate(rows, ["x"]).select("event_id", r6(F.col("f"), "f"))


@query("fit_phs3_linear_reproduction", f"SELECT idx, {s6('2 - x0 / 10', 'f')}, -0.1 AS f_0, 0.0 AS f_00 FROM {CUSTOMERS}")
def fit_phs3_linear_reproduction(spark, sf):
    centers = P.pts1(spark, sf).withColumn("y", 2 - F.col("x0") / 10).persist()
    made = fields.fit_field(centers, Kernel("phs", 3), 1).evaluate(P.customers(spark, sf), ["x0"], order=2)
    return made.select("idx", r6(F.col("f"), "f"), r6(F.col("f_0"), "f_0"), r6(F.col("f_00"), "f_00"))


_QUADRATIC = "1 + u - 2 * v + 0.5 * u * u - u * v + v * v"


@query(
    "fit_phs5_d2_quadratic_reproduction",
    f"SELECT idx, {s6(_QUADRATIC, 'f')}, {s6('1 + u - v', 'f_0')}, {s6('-2 - u + 2 * v', 'f_1')}, 1.0 AS f_00, -1.0 AS f_01, 2.0 AS f_11 FROM (SELECT idx, x0 / 12.5 - 1 AS u, x1 / 5 - 1 AS v FROM {CUSTOMERS})",
)
def fit_phs5_d2_quadratic_reproduction(spark, sf):
    """A quadratic through a place of each nation, its customers' least, mean or largest balance, comes back with its
    derivatives at all customers' places."""
    u, v = F.col("x0"), F.col("x1")
    rows = P.customers(spark, sf).select("idx", (u / 12.5 - 1).alias("x0"), (v / 5 - 1).alias("x1"))
    nth = F.pmod(F.round((u + 1) * 12.5).cast("int"), F.lit(3))
    spot = rows.groupBy("x0").agg(F.min("x1").alias("low"), F.avg("x1").alias("mean"), F.max("x1").alias("high")).select("x0", F.when(nth == 0, F.col("low")).when(nth == 1, F.col("mean")).otherwise(F.col("high")).alias("x1"))
    centers = spot.select(F.lit(0).cast("long").alias("field_id"), (F.row_number().over(Window.orderBy("x0", "x1")) - 1).alias("idx"), u, v, (1 + u - 2 * v + 0.5 * u * u - u * v + v * v).alias("y")).persist()
    made = fields.fit_field(centers, Kernel("phs", 5), 2).evaluate(rows, order=2)
    return made.select("idx", *[r6(F.col(c), c) for c in ("f", "f_0", "f_1", "f_00", "f_01", "f_11")])


@query("fit_by_segment", f"WITH m AS (SELECT c_nationkey % 5 AS field_id, CAST(c_nationkey AS DOUBLE) AS x0, avg(c_acctbal) / 997 AS y FROM customer GROUP BY c_nationkey), s AS (SELECT *, lag(x0) OVER w AS xl, lag(y) OVER w AS yl, lead(x0) OVER w AS xr, lead(y) OVER w AS yr FROM m WINDOW w AS (PARTITION BY field_id ORDER BY x0)), e AS (SELECT *, exp(-(x0 - xl) / {MATERN_L}) AS a, exp(-(xr - x0) / {MATERN_L}) AS b FROM s) SELECT CAST(field_id AS BIGINT) AS field_id, x0, {s6('y + coalesce((a * a * y - a * yl) / (1 - a * a), 0) + coalesce((b * b * y - b * yr) / (1 - b * b), 0)', 'w')} FROM e")
def fit_by_segment(spark, sf):
    """Five fields fitted side by side, one task each."""
    means = P.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("double").alias("x0")).agg((F.avg("c_acctbal") / 997).alias("y"))
    named = means.withColumn("field_id", (F.col("x0") % 5).cast("long"))
    centers = named.withColumn("idx", F.row_number().over(Window.partitionBy("field_id").orderBy("x0")) - 1).persist()
    return fields.fit(centers, MATERN, 1).join(centers, ["field_id", "idx"]).select("field_id", "x0", r6(F.col("value"), "w"))


_SPOTS = f"(SELECT x0, x0 % 10 AS x1, (7 * x0) % 9 AS x2, y FROM {PTS1})"
_BUMPS = "q.w * exp(-q.r2 / 32)"


@query(
    "eval_batch_gradient",
    f"WITH q AS (SELECT nth, l_orderkey, l_linenumber, l_quantity - x0 AS d0, l_discount * 100 - x1 AS d1, l_tax * 100 - x2 AS d2, y AS w, (l_quantity - x0) ** 2 + (l_discount * 100 - x1) ** 2 + (l_tax * 100 - x2) ** 2 AS r2 FROM (SELECT row_number() OVER () AS nth, * FROM lineitem) CROSS JOIN {_SPOTS}) "
    f"SELECT l_orderkey, l_linenumber, {s6(f'sum({_BUMPS})', 'f')}, " + ", ".join(s6(f"sum(-q.d{k} / 16 * {_BUMPS})", f"f_{k}") for k in range(3)) + " FROM q GROUP BY nth, l_orderkey, l_linenumber",
)
def eval_batch_gradient(spark, sf):
    """Value and gradient at every line item of a field with a Gaussian at a place for each size, 50, weighted by price."""
    spots = P.pts1(spark, sf).select("x0", (F.col("x0") % 10).alias("x1"), ((F.col("x0") * 7) % 9).alias("x2"), "y").toPandas()
    field = fields.FittedField(Kernel("gaussian", 4.0), spots[["x0", "x1", "x2"]].to_numpy(float), spots["y"].to_numpy(float), np.empty(0))
    rows = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("x1"), (F.col("l_tax") * 100).alias("x2"))
    made = field.evaluate(rows, order=1)
    return made.select("l_orderkey", "l_linenumber", *[r6(F.col(c), c) for c in ("f", "f_0", "f_1", "f_2")])


@query("project_reference", f"SELECT idx, {s6('2 - x0 / 10', 'slope')}, -0.1 AS slope_0, {s6('1 + x0 / 5', 'rise')}, 0.2 AS rise_0 FROM {CUSTOMERS}")
def project_reference(spark, sf):
    """Two fields by their ids, with gradients, at all customers."""
    spots = P.pts1(spark, sf).persist()
    made = [(n, fields.fit_field(spots.withColumn("y", y), Kernel("phs", 3), 1)) for n, y in (("slope", 2 - F.col("x0") / 10), ("rise", 1 + F.col("x0") / 5))]
    out = projects.Project(tuple(made)).evaluate(P.customers(spark, sf), ["x0"], 1)
    return out.select("idx", *[r6(F.col(c), c) for c in ("slope", "slope_0", "rise", "rise_0")])


# -- neighbours and sparse systems


@query("neighbor_pairs", f"SELECT a.idx AS i, b.idx AS j, {s6('sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)', 'r')} FROM {SUPPLIERS} a JOIN {CUSTOMERS} b ON (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 < 1.5 * 1.5")
def neighbor_pairs(spark, sf):
    """Suppliers are the few that go to the cells around theirs. Pairs grow with the product of both tables: what is done for
    each is arithmetic of doubles, as in the SQL, for F.round makes a decimal of each number."""
    pairs = neighbors.within(P.customers(spark, sf), P.suppliers(spark, sf), 1.5, 2)
    return pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.rint(F.col("r") * 1e6) / 1e6).alias("r"))


C4 = Kernel("wendland_c4", 1.5)
_C4 = "(greatest(1 - r / 1.5, 0) ** 6 * (1 + 6 * r / 1.5 + 35 * (r / 1.5) ** 2 / 3))"
_NEAR3 = f"(SELECT a.idx AS i, b.idx AS j, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS r FROM {GRID} a JOIN {GRID} b ON abs(a.x0 - b.x0) < 1.5 AND abs(a.x1 - b.x1) < 1.5 AND abs(a.x2 - b.x2) < 1.5)"


@query("sparse_coo", f"SELECT i, j, {s6(_C4, 'v')} FROM {_NEAR3} WHERE r < 1.5")
def sparse_coo(spark, sf):
    return neighbors.sparse_matrix(P.grid(spark, sf), C4, 3).select("i", "j", r6(F.col("v"), "v"))


@query("sparse_stats", f"WITH m AS (SELECT i, count(*) AS m FROM {_NEAR3} WHERE r < 1.5 GROUP BY i) SELECT count(*) AS n, CAST(sum(m) AS BIGINT) AS nonzeros, CAST((sum(m) - count(*)) / 2 AS BIGINT) AS pairs, {s6('sum(m) / (count(*) * count(*))', 'density')}, max(m) AS longest_row, count(*) FILTER (m = 1) AS isolated FROM m")
def sparse_stats(spark, sf):
    places = P.grid(spark, sf)
    return neighbors.matrix_stats(places, neighbors.sparse_matrix(places, C4, 3)).withColumn("density", F.round("density", 6) + 0.0)


@query("fit_wendland_isolated", f"SELECT idx, {s6('y / 0.997', 'w')} FROM {GRID}")
def fit_wendland_isolated(spark, sf):
    """With a support of one spacing no center reaches another: the weights are the values."""
    return neighbors.fit_sparse(P.grid(spark, sf), Kernel("wendland_c2", 1.0), 3).select("idx", r6(F.col("w") / 0.997, "w"))  # no ties in rounding


@query("fit_wendland_residual", f"SELECT idx, {s6('y / 0.997', 'f')} FROM {GRID}")
def fit_wendland_residual(spark, sf):
    """A sparse fit by conjugate gradients takes the given values at its centers."""
    places = checkpointed(P.grid(spark, sf))
    kernel = Kernel("wendland_c4", 1.2)
    return neighbors.evaluate_sparse(places, places, neighbors.fit_sparse(places, kernel, 3), kernel, 3).select("idx", r6(F.col("f") / 0.997, "f"))


@query("fit_wendland_factor", f"SELECT idx, {s6('y / 0.997', 'f')}, true AS exact FROM {GRID}")
def fit_wendland_factor(spark, sf):
    """A sparse fit by the factor of each connected component takes the given values at its centers."""
    places = checkpointed(P.grid(spark, sf))
    kernel = Kernel("wendland_c4", 1.2)
    weights = checkpointed(sparsefactor.fit_factored(places, kernel, 3))
    found = neighbors.evaluate_sparse(places, places, weights.select("idx", "w"), kernel, 3)
    return found.join(weights, "idx").select("idx", r6(F.col("f") / 0.997, "f"), (F.col("backward_error") <= 128 * sparsefactor.EPS * 5000).alias("exact"))


_BALANCES = "(SELECT CAST(round(c_nationkey * 100000 + c_acctbal) AS BIGINT) AS idx, avg(c_custkey) / 997 AS y FROM customer GROUP BY 1)"


@query(
    "fit_wendland_components",
    f"WITH p AS (SELECT *, CASE WHEN idx - lag(idx) OVER (ORDER BY idx) < 30 THEN 0 ELSE 1 END AS opens FROM {_BALANCES}), q AS (SELECT *, sum(opens) OVER (ORDER BY idx) AS island FROM p) "
    f"SELECT idx, min(idx) OVER (PARTITION BY island) AS component, {s6('y', 'f')} FROM q",
)
def fit_wendland_components(spark, sf):
    """Customers along a line by nation and balance: their many components are factorised side by side."""
    rows = P.table(spark, sf, "customer").groupBy(F.round(F.col("c_nationkey") * 100000 + F.col("c_acctbal")).cast("long").alias("idx")).agg((F.avg("c_custkey") / 997).alias("y"))
    places = checkpointed(rows.withColumn("x0", F.col("idx") / 1000.0))
    kernel = Kernel("wendland_c2", 0.0299999)  # 30 thousandths are apart, whatever the rounding
    weights = checkpointed(sparsefactor.fit_factored(places, kernel, 1))
    found = neighbors.evaluate_sparse(places, places, weights.select("idx", "w"), kernel, 1)
    return found.join(weights, "idx").select("idx", "component", r6(F.col("f"), "f"))


@query("eval_local_counts", f"SELECT a.idx AS idx, count(b.idx) AS visited FROM {SUPPLIERS} a LEFT JOIN {CUSTOMERS} b ON (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 < 0.25 GROUP BY 1")
def eval_local_counts(spark, sf):
    weights = P.customers(spark, sf).select("idx", F.lit(1.0).alias("w"))
    return neighbors.evaluate_sparse(P.suppliers(spark, sf), P.customers(spark, sf), weights, Kernel("wendland_c2", 0.5), 2).select("idx", "visited")


# -- tensors

_M2 = "sum(w) AS total, sum(w * u0 * u0) / sum(w) AS c_00, sum(w * u0 * u1) / sum(w) AS c_01, sum(w * u1 * u1) / sum(w) AS c_11"


@query("tensor_d2", f"SELECT l_returnflag, {', '.join(s6(c, c) for c in ('c_00', 'c_01', 'c_11'))} FROM (SELECT l_returnflag, {_M2} FROM {DIRS2} GROUP BY 1)")
def tensor_d2(spark, sf):
    made = tensors.tensor(P.directions(spark, sf, 2), ["u0", "u1"], "w", ["l_returnflag"])
    return made.select("l_returnflag", *[r6(F.col(c), c) for c in ("c_00", "c_01", "c_11")])


@query("tensor_d2_eigen", f"SELECT l_returnflag, {s6('0.5 + d', 'l0')}, {s6('0.5 - d', 'l1')}, {s6('2 * d', 'gap')}, {s6('cos(atan2(2 * c_01, c_00 - c_11) / 2)', 'u0')}, {s6('sin(atan2(2 * c_01, c_00 - c_11) / 2)', 'u1')} FROM (SELECT *, sqrt(((c_00 - c_11) / 2) ** 2 + c_01 ** 2) AS d FROM (SELECT l_returnflag, {_M2} FROM {DIRS2} GROUP BY 1))")
def tensor_d2_eigen(spark, sf):
    made = tensors.tensor(P.directions(spark, sf, 2), ["u0", "u1"], "w", ["l_returnflag"])
    axes = tensors.axes_2d(F.col("c_00"), F.col("c_01"), F.col("c_11"))
    return made.select("l_returnflag", *[r6(axes[c], c) for c in ("l0", "l1", "gap", "u0", "u1")])


_C3 = [(i, j) for i in range(3) for j in range(i, 3)]


@query("tensor_axes", f"SELECT l_returnflag, {s6('2 * d', 'gap_0')}, 2 * d <= 0.3 AS isotropic, 2.0 AS ratio_0, 1.0 AS ratio_1 FROM (SELECT *, sqrt(((c_00 - c_11) / 2) ** 2 + c_01 ** 2) AS d FROM (SELECT l_returnflag, {_M2} FROM {DIRS2} GROUP BY 1))")
def tensor_axes(spark, sf):
    made = tensors.tensor(P.directions(spark, sf, 2), ["u0", "u1"], "w", ["l_returnflag"])
    axes = tensors.axes_2d(F.col("c_00"), F.col("c_01"), F.col("c_11"))
    found = tensors.axis_review(made.select("l_returnflag", axes["l0"].alias("l0"), axes["l1"].alias("l1")), ["l0", "l1"], 0.3)
    return tensors.fixed_ratios(found, [2.0, 1.0]).select("l_returnflag", r6(F.col("gap_0"), "gap_0"), "isotropic", "ratio_0", "ratio_1")


@query("tensor_d3", f"SELECT l_returnflag, {', '.join(s6(f'sum(w * u{i} * u{j}) / sum(w)', f'c_{i}{j}') for i, j in _C3)}, 1.0 AS trace FROM {DIRS3} GROUP BY 1")
def tensor_d3(spark, sf):
    made = tensors.axes_3d(tensors.tensor(P.directions(spark, sf, 3), ["u0", "u1", "u2"], "w", ["l_returnflag"]))
    return made.select("l_returnflag", *[r6(F.col(f"c_{i}{j}"), f"c_{i}{j}") for i, j in _C3], r6(F.col("l0") + F.col("l1") + F.col("l2"), "trace"))


_OWN = "s00 / w - (s00 - own * u0 * u0) / (w - own)", "s01 / w - (s01 - own * u0 * u1) / (w - own)", "s11 / w - (s11 - own * u1 * u1) / (w - own)"


@query("tensor_influence", f"SELECT l_orderkey, l_linenumber, round(1e6 * sqrt((({_OWN[0]}) ** 2 + 2 * ({_OWN[1]}) ** 2 + ({_OWN[2]}) ** 2) / 2), 4) + 0.0 AS influence FROM (SELECT l_orderkey, l_linenumber, u0, u1, w AS own, sum(w) OVER () AS w, sum(w * u0 * u0) OVER () AS s00, sum(w * u0 * u1) OVER () AS s01, sum(w * u1 * u1) OVER () AS s11 FROM {DIRS2})")
def tensor_influence(spark, sf):
    rows = P.directions(spark, sf, 2).withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    made = tensors.influence(rows, ["u0", "u1"], "w", "key")
    return made.select("key.l_orderkey", "key.l_linenumber", (F.round(F.col("influence") * 1e6, 4) + 0.0).alias("influence"))


@query("tensor_ratio_cv")
def tensor_ratio_cv(spark, sf):
    return tensors.ratio_cv(P.directions(spark, sf, 2), ["u0", "u1"], "w", [1.0, 1.5, 2.0, 4.0]).select("ratio", r6(F.col("loss"), "loss"))


# -- trends

BUMP = trends.Weight(0.8, center=(12.0, 5.0), radius=3.0)
BOX = trends.Weight(1.0, low=(2.0, 1.0), high=(20.0, 8.0), transition=1.5)
MIXTURE = trends.Mixture(((trends.Weight(0.5), Kernel("gaussian", 1.0), Anisotropy.isotropic(2, 4.0)), (BUMP, Kernel("gaussian", 1.0), Anisotropy.ellipsoidal(((0.6, 0.8), (-0.8, 0.6)), (5.0, 2.0)))))
_BUMP = "0.8 * exp(-((x0 - 12) ** 2 + (x1 - 5) ** 2) / 18)"
_STEP = lambda t: f"(CASE WHEN {t} <= 0 THEN 0 WHEN {t} >= 1 THEN 1 ELSE 6 * ({t}) ** 5 - 15 * ({t}) ** 4 + 10 * ({t}) ** 3 END)"
_BOX = " * ".join(_STEP(t) for t in ("(x0 - 2) / 1.5", "(20 - x0) / 1.5", "(x1 - 1) / 1.5", "(8 - x1) / 1.5"))
_MIX = f"0.25 * exp(-((x0 - 10) ** 2 + (x1 - 4) ** 2) / 32) + {_BUMP} * (0.8 * exp(-5.0 / 18)) * exp(-(((0.6 * (x0 - 10) + 0.8 * (x1 - 4)) / 5) ** 2 + ((0.6 * (x1 - 4) - 0.8 * (x0 - 10)) / 2) ** 2) / 2)"


def _at() -> list[Column]:
    return [F.col("x0"), F.col("x1")]


def _to() -> list[Column]:
    return [F.lit(10.0), F.lit(4.0)]


@query("weight_gaussian", f"SELECT idx, {s6(_BUMP, 'b')} FROM {CUSTOMERS}")
def weight_gaussian(spark, sf):
    return P.customers(spark, sf).select("idx", r6(BUMP.at(_at()), "b"))


@query("region_gate", f"SELECT idx, {s6(_BOX, 'b')} FROM {CUSTOMERS}")
def region_gate(spark, sf):
    return P.customers(spark, sf).select("idx", r6(BOX.at(_at()), "b"))


@query("mixture_value", f"SELECT idx, {s6(_MIX, 'k')} FROM {CUSTOMERS}")
def mixture_value(spark, sf):
    return P.customers(spark, sf).select("idx", r6(MIXTURE.value(_at(), _to()), "k"))


_ANI = "exp(-(((0.6 * (x0 - 10) + 0.8 * (x1 - 4)) / 5) ** 2 + ((0.6 * (x1 - 4) - 0.8 * (x0 - 10)) / 2) ** 2) / 2)"
_ISO = "exp(-((x0 - 10) ** 2 + (x1 - 4) ** 2) / 32)"
_P = ("(0.1744 * (x0 - 10) - 0.1008 * (x1 - 4))", "(0.1156 * (x1 - 4) - 0.1008 * (x0 - 10))")
_C = ("((x0 - 12) / 9)", "((x1 - 5) / 9)")
_Q = ("((x0 - 10) / 16)", "((x1 - 4) / 16)")
_BK = f"{_BUMP} * (0.8 * exp(-5.0 / 18)) * {_ANI}"
_MIX_G = lambda i: f"-0.25 * {_ISO} * {_Q[i]} - {_BK} * ({_P[i]} + {_C[i]})"
_MIX_H = lambda i, j: f"0.25 * {_ISO} * ({_Q[i]} * {_Q[j]} - {1 / 16 if i == j else 0}) + {_BK} * (({_P[i]} + {_C[i]}) * ({_P[j]} + {_C[j]}) - ({_B[i, j]}) - {1 / 9 if i == j else 0})"


@query("mixture_gradient", f"SELECT idx, {s6(_MIX_G(0), 'g0')}, {s6(_MIX_G(1), 'g1')} FROM {CUSTOMERS}")
def mixture_gradient(spark, sf):
    g = MIXTURE.gradient(_at(), _to())
    return P.customers(spark, sf).select("idx", r6(g[0], "g0"), r6(g[1], "g1"))


@query("mixture_hessian", f"SELECT idx, {', '.join(s6(_MIX_H(i, j), f'h{i}{j}') for i, j in _B)} FROM {CUSTOMERS}")
def mixture_hessian(spark, sf):
    h = MIXTURE.derivatives(_at(), _to())[1]
    return P.customers(spark, sf).select("idx", *[r6(h[i][j], f"h{i}{j}") for i, j in _B])


_STEP1 = lambda t: f"(CASE WHEN {t} <= 0 OR {t} >= 1 THEN 0 ELSE 30 * ({t}) ** 2 * (1 - ({t})) ** 2 END)"
_BOX0 = f"({_STEP1('(x0 - 2) / 1.5')} * {_STEP('(20 - x0) / 1.5')} - {_STEP('(x0 - 2) / 1.5')} * {_STEP1('(20 - x0) / 1.5')}) / 1.5 * {_STEP('(x1 - 1) / 1.5')} * {_STEP('(8 - x1) / 1.5')}"


@query("mixture_boxed_gradient", f"SELECT idx, {s6(f'-0.25 * {_ISO} * {_Q[0]} + {_ISO} * (({_BOX0}) - {_BOX} * {_Q[0]})', 'g0')} FROM {CUSTOMERS}")
def mixture_boxed_gradient(spark, sf):
    """The weight of the second component leaves its box smoothly; at the other point it is 1."""
    mixture = trends.Mixture(((trends.Weight(0.5), Kernel("gaussian", 1.0), Anisotropy.isotropic(2, 4.0)), (BOX, Kernel("gaussian", 1.0), Anisotropy.isotropic(2, 4.0))))
    return P.customers(spark, sf).select("idx", r6(mixture.gradient(_at(), _to())[0], "g0"))


def _controls(spark: SparkSession, sf: str) -> DataFrame:
    """A control for each supplier; its direction turns with its key."""
    turn = F.col("idx") * 0.7
    return P.suppliers(spark, sf).select(F.col("idx").alias("ord"), "x0", "x1", F.when(F.col("idx") % 10 == 9, 0.0).otherwise(3 * F.cos(turn)).alias("u0"), F.when(F.col("idx") % 10 == 9, 0.0).otherwise(3 * F.sin(turn)).alias("u1"), F.lit(5.0).alias("along"), (1.0 + F.col("idx") % 4).alias("across"), F.lit(2.0).alias("radius"), F.when(F.col("idx") % 10 == 8, -1.0).otherwise(0.5).alias("strength"))


_CTRL = f"(SELECT idx, row_number() OVER (ORDER BY idx) AS component, idx % 10 = 9 AS flat, CASE WHEN idx % 10 = 9 THEN NULL ELSE cos(idx * 0.7) END AS u0, CASE WHEN idx % 10 = 9 THEN NULL ELSE sin(idx * 0.7) END AS u1, 1.0 + idx % 4 AS across FROM {SUPPLIERS})"


@query(
    "trend_controls",
    f"SELECT component, {s6('(1.0 / 5 - 1 / across) * u0 * u0 + 1 / across', 'm00')}, {s6('(1.0 / 5 - 1 / across) * u0 * u1', 'm01')}, {s6('jump', 'jump')}, CASE WHEN idx % 10 = 8 THEN 'a length, radius or strength is not positive' WHEN flat THEN 'no direction' WHEN 5 / across > 4 THEN 'condition' WHEN jump > 0.69 THEN 'jump' END AS problem "
    f"FROM (SELECT *, acos(least(1.0, abs(u0 * lag(u0) OVER (ORDER BY idx) + u1 * lag(u1) OVER (ORDER BY idx)))) AS jump FROM {_CTRL}) UNION ALL SELECT 0, 0.25, 0.0, NULL, NULL",
)
def trend_controls(spark, sf):
    made = trends.compiled_controls(_controls(spark, sf), (0.5, 4.0), trends.TrendPolicy(condition=4.0, jump=0.69))
    return made.select("component", r6(F.col("matrix")[0][0], "m00"), r6(F.col("matrix")[0][1], "m01"), r6(F.col("jump"), "jump"), "problem")


@query("trend_diagnostics", f"SELECT count(*) AS samples, count(*) FILTER (c < 0.3) AS low_confidence, {s6('min(c)', 'least')}, {s6('max(c)', 'most')}, (SELECT count(*) FROM supplier) AS controls FROM (SELECT 0.25 + ({_BUMP}) ** 2 AS c FROM {CUSTOMERS})")
def trend_diagnostics(spark, sf):
    compiled = trends.compiled_controls(_controls(spark, sf), (0.5, 4.0), trends.TrendPolicy())
    made = trends.diagnostics(compiled, P.customers(spark, sf), MIXTURE, 0.3)["summary"]
    return made.select("samples", "low_confidence", r6(F.col("least"), "least"), r6(F.col("most"), "most"), "controls")


@query("mixture_coverage", f"SELECT idx, {s6(f'0.25 + ({_BUMP}) ** 2', 'coverage')}, 0.25 AS background, 2 AS active FROM {CUSTOMERS}")
def mixture_coverage(spark, sf):
    made = MIXTURE.coverage(_at())
    return P.customers(spark, sf).select("idx", r6(made["coverage"], "coverage"), r6(made["background"], "background"), made["active"].alias("active"))


_JUMP = "acos(least(1.0, abs(u0 * lag(u0) OVER o + u1 * lag(u1) OVER o)))"


@query("direction_jumps", f"SELECT l_orderkey, l_linenumber, {s6('jump', 'jump')}, coalesce(jump > 0.5, false) AS exceeds FROM (SELECT l_orderkey, l_linenumber, {_JUMP} AS jump FROM {DIRS2} WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, u0, u1))")
def direction_jumps(spark, sf):
    made = trends.direction_jumps(P.directions(spark, sf, 2), ["u0", "u1"], ["l_orderkey"], ["l_linenumber", "u0", "u1"], 0.5)
    return made.select("l_orderkey", "l_linenumber", r6(F.col("jump"), "jump"), "exceeds")


# -- selection and tuning


@query("select_user", "SELECT CAST(nth AS INTEGER) AS nth, idx FROM (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS nth, s_suppkey AS idx FROM supplier) WHERE nth < 3")
def select_user(spark, sf):
    """The three richest suppliers, in that order."""
    rich = P.table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3).collect()
    return selection.select_user(P.suppliers(spark, sf), [r["s_suppkey"] for r in rich])


#: Eight farthest points, one after another: the least distance to those before, the largest of it, ties by idx. The ties by
#: a seeded hash that the operator has do not occur where distances differ.
@query(
    "select_farthest",
    f"WITH RECURSIVE s AS MATERIALIZED (SELECT idx, x0, x1 FROM {SUPPLIERS}), r(nth, idx, distance, taken) AS ("
    "SELECT 0, idx, CAST(0 AS DOUBLE), [idx] FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM s) WHERE k = 5 % n UNION ALL "
    "SELECT nth + 1, best.idx, best.d, list_append(taken, best.idx) FROM (SELECT r.nth, r.taken, (SELECT max_by({'idx': c.idx, 'd': c.d}, c.d) FROM (SELECT a.idx, min(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)) AS d FROM s a JOIN s b ON list_contains(r.taken, b.idx) WHERE NOT list_contains(r.taken, a.idx) GROUP BY a.idx) c) AS best FROM r WHERE r.nth < 7)) "
    f"SELECT nth, idx, {s6('distance', 'distance')} FROM r",
)
def select_farthest(spark, sf):
    return selection.select_farthest(P.suppliers(spark, sf), 2, 8, seed=5).select("nth", "idx", r6(F.col("distance"), "distance"))


@query("select_all", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS nth, s_suppkey AS idx FROM supplier")
def select_all(spark, sf):
    return selection.select_all(P.suppliers(spark, sf))


@query("select_basis", "SELECT CAST(0 AS BIGINT) AS field_id, count(DISTINCT p_size) AS selected FROM part")
def select_basis(spark, sf):
    """All sizes as centers: their exponential kernel is positive definite."""
    candidates = P.pts1(spark, sf).persist()
    return selection.selected_basis(candidates, selection.select_all(candidates), Kernel("matern12", 5.0), 1)


@query("select_greedy_power")
def select_greedy_power(spark, sf):
    return selection.select_greedy(P.pts1(spark, sf).persist(), Kernel("matern12", 5.0), 1, 20, "power").select("nth", "idx", r6(F.col("score"), "score"))


@query("select_greedy_residual")
def select_greedy_residual(spark, sf):
    return selection.select_greedy(P.pts1(spark, sf).persist(), Kernel("matern12", 5.0), 1, 10).select("nth", "idx", r6(F.col("score"), "score"))


@query("tune_nn_distances", f"SELECT a.idx AS idx, {s6('min(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2))', 'nearest')} FROM {SUPPLIERS} a JOIN {SUPPLIERS} b ON a.idx <> b.idx GROUP BY 1")
def tune_nn_distances(spark, sf):
    return selection.nearest_distances(P.suppliers(spark, sf), 2).select("idx", r6(F.col("nearest"), "nearest"))


_MEDIAN = f"(SELECT quantile_cont(d, 0.5) FROM (SELECT min(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)) AS d FROM {SUPPLIERS} a JOIN {SUPPLIERS} b ON a.idx <> b.idx GROUP BY a.idx))"


@query("tune_distance", f"SELECT cand, {s6(f'ln(length / {_MEDIAN}) ** 2', 'score')} FROM (VALUES (0, 0.25), (1, 0.5), (2, 1.0), (3, 2.0), (4, 4.0)) t(cand, length)")
def tune_distance(spark, sf):
    median = ranking.quantiles(selection.nearest_distances(P.suppliers(spark, sf), 2), "nearest", [0.5])[0]
    candidates = spark.createDataFrame([(k, 0.25 * 2**k) for k in range(5)], "cand int, length double")
    return selection.distance_scores(median, candidates, ["length"]).select("cand", r6(F.col("score"), "score"))


_WRAP = 18446744073709551616
_MIX64 = f"""WITH a AS (SELECT idx, xor((idx::UHUGEINT * 11400714819323198485::UHUGEINT) % {_WRAP}::UHUGEINT, 24301::UHUGEINT) AS v FROM (SELECT s_suppkey AS idx FROM supplier)),
b AS (SELECT idx, (v + 11400714819323198485::UHUGEINT) % {_WRAP}::UHUGEINT AS z FROM a),
c AS (SELECT idx, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) % {_WRAP}::UHUGEINT AS z FROM b),
d AS (SELECT idx, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) % {_WRAP}::UHUGEINT AS z FROM c),
e AS (SELECT idx, xor(z, z >> 31) AS z FROM d)
SELECT idx, CAST((row_number() OVER (ORDER BY z, idx) - 1) % 5 AS INTEGER) AS fold FROM e"""


@query("tune_folds", _MIX64)
def tune_folds(spark, sf):
    return selection.folds(P.suppliers(spark, sf), 5, 0x5EED).select("idx", F.col("fold").cast("int").alias("fold"))


_EVIDENCE = "SELECT c.cand, n_regionkey AS fold, sum((c.length - 2) ** 2 * abs(c_acctbal) / 1000) AS e, sum(abs(c_acctbal) / 1000) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES (0, 0.5), (1, 1.0), (2, 2.0), (3, 4.0)) c(cand, length) GROUP BY 1, 2"


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    candidates = F.explode(F.array(*[F.struct(F.lit(k).alias("cand"), F.lit(0.5 * 2**k).alias("length")) for k in range(4)])).alias("c")
    joined = P.table(spark, sf, "customer").join(P.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((F.abs("c_acctbal") / 1000).alias("w"), F.col("n_regionkey").alias("fold"), candidates)
    return joined.groupBy(F.col("c.cand").alias("cand"), "fold").agg(F.sum(F.pow(F.col("c.length") - 2, 2) * F.col("w")).alias("weighted_squared_error"), F.sum("w").alias("weight"))


@query("tune_candidates", "SELECT * FROM (SELECT p_partkey AS cand, CASE WHEN p_size / 10.0 < 0.5 OR p_size / 10.0 > 4 THEN 'length is out of bounds' WHEN p_partkey % 7 = 0 THEN 'axis_ratio has no bounds' WHEN p_partkey > min(p_partkey) OVER (PARTITION BY p_size, p_partkey % 7 = 0) THEN 'repeats a candidate' END AS problem FROM part) WHERE problem IS NOT NULL")
def tune_candidates(spark, sf):
    """A candidate for each part: most repeat the length of another one."""
    rows = P.table(spark, sf, "part").select(F.col("p_partkey").alias("cand"), (F.col("p_size") / 10.0).alias("length"), F.when(F.col("p_partkey") % 7 == 0, 2.0).alias("axis_ratio"))
    return selection.candidate_violations(rows, {"length": (0.5, 4.0)})


@query("tune_fixed", "SELECT p_partkey AS cand, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN 'Selected' ELSE 'NotEvaluated' END AS status FROM part")
def tune_fixed(spark, sf):
    rows = P.table(spark, sf, "part").select(F.col("p_partkey").alias("cand"))
    return selection.fixed_choice(rows, rows.agg(F.min("cand")).first()[0])


@query("tune_power", "SELECT c_nationkey AS cand, max(abs(c_acctbal)) AS score FROM customer GROUP BY 1")
def tune_power(spark, sf):
    return selection.power_scores(P.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cand"), F.abs("c_acctbal").alias("max_sq_power"), F.lit(1).cast("long").alias("samples")))


_BRIDGE = "CASE WHEN before IS NULL THEN yb * exp(-(after - x0) / l) WHEN after IS NULL THEN ya * exp(-(x0 - before) / l) ELSE (ya * (exp((after - x0) / l) - exp(-(after - x0) / l)) + yb * (exp((x0 - before) / l) - exp(-(x0 - before) / l))) / (exp((after - before) / l) - exp(-(after - before) / l)) END"


@query(
    "tune_fitted",
    f"WITH p AS (SELECT *, (row_number() OVER w - 1) % 3 AS fold, lag(x0) OVER w AS before, lead(x0) OVER w AS after, lag(y) OVER w AS ya, lead(y) OVER w AS yb FROM {PTS1} WINDOW w AS (ORDER BY x0)), "
    f"m AS (SELECT cand, fold, {_BRIDGE} - y AS miss FROM p CROSS JOIN (VALUES (0, 0.5), (1, 1.0), (2, 2.0), (3, 4.0)) c(cand, l)) SELECT cand, CAST(fold AS INTEGER) AS fold, {s6('sum(miss * miss)', 'weighted_squared_error')}, CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY 1, 2",
)
def tune_fitted(spark, sf):
    """Exponential kernels of four lengths, each fitted without a third of the sizes: between its neighbours a left-out price
    is foretold by the two alone."""
    points = P.pts1(spark, sf).withColumn("fold", (F.col("idx") % 3).cast("int"))
    candidates = spark.createDataFrame([(k, 0.5 * 2**k) for k in range(4)], "cand int, length double")
    made = selection.cross_validated(candidates, points, 1, lambda c: Kernel("matern12", c["length"]), ["length"])
    return made.select("cand", "fold", r6(F.col("weighted_squared_error"), "weighted_squared_error"), "weight")


@query("tune_evaluated", f"SELECT cand, fold, round(e, 3) + 0.0 AS weighted_squared_error, round(w, 3) + 0.0 AS weight FROM ({_EVIDENCE})")
def tune_evaluated(spark, sf):
    """The same evidence by an evaluator of each region's customers under each candidate."""
    joined = P.table(spark, sf, "customer").join(P.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((F.abs("c_acctbal") / 1000).alias("w"), F.col("n_regionkey").alias("fold"))
    candidates = spark.createDataFrame([(k, 0.5 * 2**k) for k in range(4)], "cand int, length double")
    made = selection.evaluated(candidates, joined, lambda rows, own: (((own["length"] - 2) ** 2 * rows["w"]).sum(), rows["w"].sum()), ["length"])
    return made.select("cand", "fold", *[(F.round(c, 3) + 0.0).alias(c) for c in ("weighted_squared_error", "weight")])


@query("tune_cv", f"SELECT cand, {s6('sum(e) / sum(w)', 'score')} FROM ({_EVIDENCE}) GROUP BY 1")
def tune_cv(spark, sf):
    return selection.cv_scores(_evidence(spark, sf)).select("cand", r6(F.col("score"), "score"))


@query("tune_select", f"WITH s AS (SELECT cand, sum(e) / sum(w) AS score FROM ({_EVIDENCE}) GROUP BY 1) SELECT min_by(cand, score) AS cand, {s6('min(score)', 'score')}, CAST(count(*) FILTER (score = (SELECT min(score) FROM s)) AS BIGINT) AS ties FROM s")
def tune_select(spark, sf):
    return selection.select_minimum(selection.cv_scores(_evidence(spark, sf)), 7).select("cand", r6(F.col("score"), "score"), "ties")


@query("tune_gcv", "SELECT c_nationkey AS cand, round(n * rss / (n - 2.5) ** 2, 6) + 0.0 AS score FROM (SELECT c_nationkey, count(*) AS n, sum((c_acctbal / 1000) ** 2) AS rss FROM customer GROUP BY 1)")
def tune_gcv(spark, sf):
    rows = P.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cand")).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("c_acctbal") / 1000, 2)).alias("rss"), F.lit(2.5).alias("dof"))
    return selection.gcv_scores(rows).select("cand", r6(F.col("score"), "score"))


@query("metric_definite", "SELECT l_orderkey, l_linenumber, l_partkey % 3 = 1 AS definite FROM lineitem")
def metric_definite(spark, sf):
    """Metrics (a^2, a b, b^2 + s) with s of -1, 0 and 1: their determinant, a^2 s, is below the rounding of its terms."""
    a, b, s = F.lit(94_000_000.0) + F.col("l_partkey"), F.lit(94_300_000.0) + F.col("l_suppkey") * 2, (F.col("l_partkey") % 3).cast("double")
    rows = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (a * a).alias("m00"), (a * b).alias("m01"), (b * b + F.when(s == 2, -1.0).otherwise(s)).alias("m11"))
    return metric_review(rows, ["m00", "m01", "m11"], 2).select("l_orderkey", "l_linenumber", "definite")


@query("metric_condition", f"SELECT l_orderkey, l_linenumber, {s6('greatest(l_quantity, 100 * l_discount + 1) / least(l_quantity, 100 * l_discount + 1) / 0.997', 'condition')} FROM lineitem")
def metric_condition(spark, sf):
    """Metrics with two known principal values, turned by 3-4-5."""
    p, q = F.col("l_quantity"), F.col("l_discount") * 100 + 1
    rows = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (p * 0.64 + q * 0.36).alias("m00"), ((p - q) * 0.48).alias("m01"), (p * 0.36 + q * 0.64).alias("m11"))
    return metric_review(rows, ["m00", "m01", "m11"], 2).select("l_orderkey", "l_linenumber", r6(F.col("condition") / 0.997, "condition"))


# -- dense factors, ranks and null spaces: a field for each nation


def _by_nation(spark: SparkSession, sf: str, *axes: Column) -> DataFrame:
    """field_id, idx, x0 ..., y: the customers of each nation along their numbers."""
    idx = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return P.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("field_id"), idx.alias("idx"), *[a.alias(f"x{k}") for k, a in enumerate(axes)], (F.col("c_acctbal") / 1000).alias("y"))


@query("fit_ldlt_inertia", "SELECT CAST(c_nationkey AS BIGINT) AS field_id, count(*) AS positive, CAST(3 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS zero FROM customer GROUP BY 1")
def fit_ldlt_inertia(spark, sf):
    """Systems with a linear polynomial, by indefinite factors: as many negative eigenvalues as the polynomial has terms."""
    centers = _by_nation(spark, sf, F.col("c_custkey") / 100, F.col("c_acctbal") / 1000)
    return fields.fit_review(centers, Kernel("phs", 3), 2).select("field_id", "positive", "negative", "zero")


_SLOPES = """(SELECT CAST(c_nationkey AS BIGINT) AS field_id, row_number() OVER w - 1 AS idx,
coalesce((lead(c_acctbal) OVER w - c_acctbal) / (lead(c_custkey) OVER w - c_custkey), 0) / 10 AS after, coalesce((c_acctbal - lag(c_acctbal) OVER w) / (c_custkey - lag(c_custkey) OVER w), 0) / 10 AS before
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))"""


@query("fit_null_space_weights", f"SELECT field_id, idx, {s6('(before - after) / 1.994', 'w')} FROM {_SLOPES}")
def fit_null_space_weights(spark, sf):
    """The piecewise linear function through the balances, solved for within the null space of the constant: each weight is
    half the fall of the slope at its center, by hundreds of customers. Places are whole numbers, whose distances are exact."""
    made = fields.fit(_by_nation(spark, sf, F.col("c_custkey").cast("double")), Kernel("phs", 1), 1, options=fields.SolveOptions(route="null_space"))
    return made.where("role = 'center'").select("field_id", F.col("idx").cast("long").alias("idx"), r6(F.col("value") * 100 / 0.997, "w"))


@query("fit_augmented_weights", f"SELECT field_id, idx, {s6('(before - after) / 1.994', 'w')} FROM {_SLOPES}")
def fit_augmented_weights(spark, sf):
    """The same weights by the indefinite factor of the whole system."""
    made = fields.fit(_by_nation(spark, sf, F.col("c_custkey").cast("double")), Kernel("phs", 1), 1)
    return made.where("role = 'center'").select("field_id", F.col("idx").cast("long").alias("idx"), r6(F.col("value") * 100 / 0.997, "w"))


@query("cpd_energies", f"SELECT CAST(a.c_nationkey AS BIGINT) AS field_id, CAST(count(DISTINCT a.c_custkey) - 1 AS BIGINT) AS terms, CAST(count(DISTINCT a.c_custkey) - 1 AS BIGINT) AS positive, round(sum(abs(a.c_custkey - b.c_custkey)) / 100 / count(DISTINCT a.c_custkey) / 0.997, 4) + 0.0 AS total FROM customer a JOIN customer b USING (c_nationkey) GROUP BY 1")
def cpd_energies(spark, sf):
    """Energies of -|x - y| within the null space of the constant: all positive, and their sum is that of all distances over
    the number of centers."""
    made = fields.projected_energies(_by_nation(spark, sf, F.col("c_custkey") / 100), Kernel("phs", 1), 1)
    return made.groupBy("field_id").agg(F.count("*").alias("terms"), F.count_if(F.col("energy") > 0).alias("positive"), (F.round(F.sum("energy") / 0.997, 4) + 0.0).alias("total"))


@query("cpd_rank", "SELECT CAST(c_nationkey AS BIGINT) AS field_id, CASE c_nationkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'deficient' ELSE 'ambiguous' END AS decision, CASE c_nationkey % 3 WHEN 0 THEN CAST(3 AS BIGINT) WHEN 1 THEN CAST(2 AS BIGINT) END AS svd_rank FROM customer GROUP BY 1, 2, 3")
def cpd_rank(spark, sf):
    """Linear polynomials at customers' places: in the plane, on a line, and off a line by about the rank's threshold, which is
    one of rows and columns brought to a largest entry of 1: each place is off in proportion to its row's largest entry."""
    own = Window.partitionBy("c_nationkey")
    x, third = F.col("c_custkey") / 100, F.col("c_nationkey") % 3
    off = F.greatest(x, F.lit(1.0)) * F.count("*").over(own) * (1.8 * 2.0**-52) * F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(-1.0)
    centers = _by_nation(spark, sf, x, F.when(third == 0, F.col("c_acctbal") / 1000).when(third == 1, x).otherwise(x + off))
    made = fields.polynomial_ranks(centers, 2, 2)
    return made.select("field_id", "decision", F.when(F.col("decision") != "ambiguous", F.col("svd_rank")).alias("svd_rank"))


@query("fit_regularized_isolated", f"SELECT CAST(0 AS BIGINT) AS field_id, idx, {s6('y / 1.25', 'w')} FROM (SELECT row_number() OVER (ORDER BY x0) - 1 AS idx, y FROM {PTS1})")
def fit_regularized_isolated(spark, sf):
    """Centers out of each other's reach and a quarter on the diagonal, as an option asks."""
    made = fields.fit(P.pts1(spark, sf), Kernel("wendland_c2", 0.9), 1, options=fields.SolveOptions(regularization=0.25, condition_limit=10.0))
    return made.select("field_id", F.col("idx").cast("long").alias("idx"), r6(F.col("value"), "w"))


# -- constraints: one row for each line item, its discount and tax the coefficients of two variables


#: What tells the lines of an order with one number apart; lines that agree in all of it are alike.
_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
_LINE_ID = f"(l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)})"


def _line_id() -> Column:
    """An id of its own for each line item."""
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINE))
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + copy


def _constraints(spark: SparkSession, sf: str, own: bool = False) -> DataFrame:
    k = F.col("l_linenumber")
    rows = P.table(spark, sf, "lineitem").select((_line_id() if own else F.col("l_orderkey") * 8 + k).alias("obs_id"), k, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return rows.select(
        "obs_id", F.col("obs_id").alias("ord"), F.when(k % 3 == 0, "eq").when(k % 3 == 1, "bound").otherwise("cone").alias("rel"), F.col("l_discount").alias("constant"), F.col("l_quantity").alias("target"),
        F.when(k % 3 == 1, F.col("l_quantity") - 25).alias("lower"), F.when(k % 2 == 0, F.lit(20.0)).alias("upper"), F.when(F.col("l_returnflag") == "R", "soft").otherwise("hard").alias("enforcement"),
        F.col("l_tax").alias("scale"), F.lit("l2").alias("loss"), F.lit(None).cast("double").alias("delta"), "l_discount", "l_tax",
    )


_CONSTRAINTS = """(SELECT l_orderkey * 8 + l_linenumber AS obs_id, CASE l_linenumber % 3 WHEN 0 THEN 'eq' WHEN 1 THEN 'bound' ELSE 'cone' END AS rel, l_discount AS constant, l_quantity AS target,
CASE WHEN l_linenumber % 3 = 1 THEN l_quantity - 25 END AS lower, CASE WHEN l_linenumber % 2 = 0 THEN 20.0 END AS upper, CASE WHEN l_returnflag = 'R' THEN 'soft' ELSE 'hard' END AS enforcement, l_tax AS scale, l_discount, l_tax FROM lineitem)"""
_OWN_CONSTRAINTS = _CONSTRAINTS.replace("l_orderkey * 8 + l_linenumber AS obs_id", f"{_LINE_ID} AS obs_id")


@query("semantic_validate", f"SELECT * FROM (SELECT obs_id, CASE WHEN rel = 'bound' AND lower IS NULL AND upper IS NULL THEN 'no bound' WHEN rel = 'bound' AND lower > upper THEN 'lower above upper' WHEN enforcement = 'soft' AND NOT scale > 0 THEN 'scale' WHEN count(*) OVER (PARTITION BY obs_id) > 1 THEN 'repeated id' END AS problem FROM {_CONSTRAINTS}) WHERE problem IS NOT NULL")
def semantic_validate(spark, sf):
    return constraints.violations(_constraints(spark, sf))


def _canonical(spark: SparkSession, sf: str, cls: str) -> DataFrame:
    rows = _constraints(spark, sf, own=True)
    terms = rows.select("obs_id", F.explode(F.array(F.struct(F.lit(0).alias("var"), (F.col("l_discount") * 100).alias("coef")), F.struct(F.lit(1).alias("var"), (F.col("l_tax") * 100).alias("coef")))).alias("t")).select("obs_id", "t.*")
    return constraints.canonical(rows, terms)[cls]


_TERMS = "CROSS JOIN LATERAL (SELECT 0 AS var, l_discount * 100 AS coef UNION ALL SELECT 1, l_tax * 100) t"


@query("canonical_eq", f"SELECT nth AS \"row\", obs_id, var, {s6('coef', 'coef')}, {s6('target - constant', 'rhs')} FROM (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS nth FROM {_OWN_CONSTRAINTS} WHERE rel = 'eq' AND enforcement = 'hard') {_TERMS} WHERE coef <> 0")
def canonical_eq(spark, sf):
    return _canonical(spark, sf, "eq").select("row", "obs_id", "var", r6(F.col("coef"), "coef"), r6(F.col("rhs"), "rhs"))


@query("canonical_bound", f"SELECT nth AS \"row\", obs_id, var, {s6('coef', 'coef')}, {s6('lower - constant', 'lower')}, {s6('upper - constant', 'upper')} FROM (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS nth FROM {_OWN_CONSTRAINTS} WHERE rel = 'bound' AND enforcement = 'hard') {_TERMS} WHERE coef <> 0")
def canonical_bound(spark, sf):
    return _canonical(spark, sf, "bound").select("row", "obs_id", "var", r6(F.col("coef"), "coef"), r6(F.col("lower"), "lower"), r6(F.col("upper"), "upper"))


@query("canonical_cone", f"SELECT nth AS \"row\", obs_id, var, {s6('coef', 'coef')}, {s6('constant', 'constant')} FROM (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS nth FROM {_OWN_CONSTRAINTS} WHERE rel = 'cone' AND enforcement = 'hard') {_TERMS} WHERE coef <> 0")
def canonical_cone(spark, sf):
    return _canonical(spark, sf, "cone").select("row", "obs_id", "var", r6(F.col("coef"), "coef"), r6(F.col("constant"), "constant"))


@query("canonical_soft", f"SELECT nth AS \"row\", obs_id, var, {s6('coef', 'coef')}, {s6('target - constant', 'rhs')}, {s6('lower - constant', 'lower')}, {s6('upper - constant', 'upper')}, scale FROM (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS nth FROM {_OWN_CONSTRAINTS} WHERE enforcement = 'soft') {_TERMS} WHERE coef <> 0")
def canonical_soft(spark, sf):
    return _canonical(spark, sf, "soft").select("row", "obs_id", "var", *[r6(F.col(c), c) for c in ("coef", "rhs", "lower", "upper")], "scale")


@query("affine_violations", f"SELECT l_orderkey AS obs_id, nth AS term_idx, problem FROM (SELECT *, CASE WHEN l_suppkey >= 90 THEN 'no such variable' WHEN lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY nth) >= l_suppkey THEN 'variables are not ascending' WHEN l_tax = 0 THEN 'coefficient' END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(_LINE)}) AS nth FROM lineitem)) WHERE problem IS NOT NULL")
def affine_violations(spark, sf):
    """An expression for each order, over its lines' suppliers."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *_LINE))
    terms = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("obs_id"), nth.alias("term_idx"), F.col("l_suppkey").alias("var"), F.col("l_tax").alias("coef"))
    return constraints.term_violations(terms, 90)


@query("variable_blocks", "SELECT c_mktsegment AS block, CAST(coalesce(sum(n) OVER (ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n AS length FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def variable_blocks(spark, sf):
    """A variable for each customer, in a block for each segment."""
    counted = P.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("block")).agg(F.count("*").alias("length"))
    return constraints.variable_blocks(counted.withColumn("ord", F.col("block")))


_LINEAR = ["lower", "upper", "interval", "inside", "outside", "gap", "increasing", "decreasing"]


@query("linear_lowered", "SELECT c_custkey AS obs_id, 'bound' AS rel, CASE WHEN k IN (0, 2, 4, 5, 6) THEN v END AS lower, CASE WHEN k IN (1, 3) THEN v WHEN k = 2 THEN v + 10 WHEN k = 7 THEN -v END AS upper FROM (SELECT c_custkey, c_custkey % 8 AS k, abs(c_acctbal) AS v FROM customer)")
def linear_lowered(spark, sf):
    """A constraint of one of eight kinds for each customer: slopes on a derivative, others on a value."""
    rows = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_custkey").alias("ord"), F.get(F.array(*map(F.lit, _LINEAR)), (F.col("c_custkey") % 8).cast("int")).alias("kind"), F.abs("c_acctbal").alias("value"))
    null = F.lit(None).cast("double")
    rows = rows.withColumn("upper", F.col("value") + 10).withColumn("enforcement", F.lit("hard")).withColumn("scale", null).withColumn("loss", F.lit(None).cast("string")).withColumn("delta", null)
    terms = rows.select(F.col("obs_id").alias("expr_id"), F.lit(1.0).alias("coef"), F.when(F.col("obs_id") % 8 >= 6, functionals.DERIVATIVE).otherwise(functionals.VALUE).alias("kind"))
    return constraints.lower_linear(rows, terms).select("obs_id", "rel", "lower", "upper")


@query("linear_gap", "SELECT o_orderkey AS obs_id, 'u' || k AS place, CASE k WHEN 0 THEN 2.0 ELSE -3.0 END AS coef FROM orders CROSS JOIN (VALUES (0), (1)) t(k)")
def linear_gap(spark, sf):
    """The difference of two expressions for each order: 2 f(u0) above and 3 f(u1) below."""
    orders = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), (F.col("o_orderkey") * 2).alias("upper_id"), (F.col("o_orderkey") * 2 + 1).alias("lower_id"))
    terms = orders.select(F.explode(F.array(F.struct(F.col("upper_id").alias("expr_id"), F.lit(2.0).alias("coef"), F.lit("u0").alias("place")), F.struct(F.col("lower_id").alias("expr_id"), F.lit(3.0).alias("coef"), F.lit("u1").alias("place")))).alias("t")).select("t.*")
    return constraints.gap_terms(orders, terms).select("obs_id", "place", "coef")


@query("linear_composed", "SELECT CAST(row_number() OVER (ORDER BY s, k) - 1 AS BIGINT) AS ord, k AS obs_id FROM (SELECT 0 AS s, s_suppkey AS k FROM supplier UNION ALL SELECT 1, -1 - c_custkey FROM customer) ORDER BY 1")
def linear_composed(spark, sf):
    """Rows for suppliers, then for customers, whose ids are negative."""
    own = ranking.numbered(P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("obs_id")), ["obs_id"], "ord")
    more = ranking.numbered(P.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("obs_id")), ["obs_id"], "ord")
    return constraints.compose(more.select("ord", "obs_id"), own.select("ord", "obs_id"))


@query("linear_bounds", "SELECT c_custkey AS idx, c_mktsegment AS kind, CASE WHEN c_nationkey % 7 IN (0, 2, 4, 5, 6) THEN c_acctbal END AS lower, CASE WHEN c_nationkey % 7 = 2 THEN c_acctbal + 10 WHEN c_nationkey % 7 = 1 THEN c_acctbal WHEN c_nationkey % 7 = 3 THEN -c_acctbal END AS upper FROM customer")
def linear_bounds(spark, sf):
    kinds = ["lower", "upper", "interval", "decreasing", "gap", "increasing", "outside"]
    kind = F.get(F.array(*map(F.lit, kinds)), F.pmod(F.col("c_nationkey"), F.lit(7)))
    made = constraints.bounds(P.table(spark, sf, "customer"), kind, F.col("c_acctbal"), F.col("c_acctbal") + 10)
    return made.select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("kind"), "lower", "upper")


@query("near_duplicates", "SELECT first, id AS second, 'duplicate' AS kind FROM (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey % 50) AS first FROM orders WHERE o_custkey % 5 = 0) WHERE id > first")
def near_duplicates(spark, sf):
    """Rows of two coefficients in proportion (c + 1) : 1, for every fifth c; the others' second variable is their own."""
    base = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 50).alias("c"), F.when(F.col("o_orderkey") % 2 == 0, -4.0).otherwise(2.0).alias("k"))
    other = F.when(F.col("c") % 5 == 0, F.lit(-1)).otherwise(F.col("row"))
    spread = F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("var"), (F.col("k") * (F.col("c") + 1)).alias("coef")), F.struct(other.cast("long").alias("var"), F.col("k").alias("coef"))))
    return constraints.near_duplicates(base.select("row", spread.alias("t")).select("row", "t.*"))


@query("hard_conflicts", "SELECT min(o_orderkey) AS \"row\", max(o_totalprice) AS lower, min(o_totalprice) AS upper FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > min(o_totalprice)")
def hard_conflicts(spark, sf):
    """One equality z_customer = price for each order: those of a customer with different prices exclude one another."""
    rows = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("var"), F.lit(1.0).alias("coef"), F.col("o_totalprice").alias("lower"), F.col("o_totalprice").alias("upper"))
    return constraints.hard_conflicts(rows)


@query("normals_complement", f"SELECT l_orderkey * 8 + l_linenumber AS obs_id, {s6('abs(u1)', 'c0')}, {s6('CASE WHEN u1 = 0 THEN abs(u0) WHEN u1 < 0 THEN u0 ELSE -u0 END', 'c1')} FROM {DIRS2}")
def normals_complement(spark, sf):
    rows = P.directions(spark, sf, 2).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "u0", "u1")
    return constraints.normal_rows(rows, ["u0", "u1"], "axial").select("obs_id", r6(F.col("c0"), "c0"), r6(F.col("c1"), "c1"))


@query("normals_polarity", f"SELECT l_orderkey * 8 + l_linenumber AS obs_id, 2 AS \"row\", {s6('u0', 'c0')}, {s6('u1', 'c1')}, {s6('u2', 'c2')}, 0.5 AS lower FROM {DIRS3}")
def normals_polarity(spark, sf):
    rows = P.directions(spark, sf, 3).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "u0", "u1", "u2")
    made = constraints.normal_rows(rows, ["u0", "u1", "u2"], "polarity", least=F.lit(0.5)).where("rel = 'bound'")
    return made.select("obs_id", "row", *[r6(F.col(f"c{k}"), f"c{k}") for k in range(3)], "lower")


_AXIS = "CASE WHEN abs(u0) = least(abs(u0), abs(u1), abs(u2)) THEN 0 WHEN abs(u1) = least(abs(u0), abs(u1), abs(u2)) THEN 1 ELSE 2 END"
_RAW = [f"(CASE WHEN axis = {k} THEN 1.0 ELSE 0.0 END - along * u{k}) / sqrt(1 - along * along)" for k in range(3)]
_SIGN = lambda v: f"CASE WHEN {v}0 > 0 THEN 1.0 WHEN {v}0 < 0 THEN -1.0 WHEN {v}1 > 0 THEN 1.0 WHEN {v}1 < 0 THEN -1.0 WHEN {v}2 < 0 THEN -1.0 ELSE 1.0 END"


@query(
    "normals_basis",
    f"WITH a AS (SELECT *, {_AXIS} AS axis FROM {DIRS3}), b AS (SELECT *, CASE axis WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END AS along FROM a), c AS (SELECT *, {', '.join(f'{r} AS r{k}' for k, r in enumerate(_RAW))} FROM b), "
    f"d AS (SELECT *, {', '.join(f'({_SIGN("r")}) * r{k} AS p{k}' for k in range(3))} FROM c), e AS (SELECT *, u1 * p2 - u2 * p1 AS s0, u2 * p0 - u0 * p2 AS s1, u0 * p1 - u1 * p0 AS s2 FROM d) "
    f"SELECT l_orderkey * 8 + l_linenumber AS obs_id, 0 AS \"row\", {', '.join(s6(f'p{k}', f'c{k}') for k in range(3))} FROM e "
    f"UNION ALL SELECT l_orderkey * 8 + l_linenumber, 1, {', '.join(s6(f'sign(CASE WHEN abs(s1) > 1e-9 THEN s1 ELSE s2 END) * s{k}', f'c{k}') for k in range(3))} FROM e",
)
def normals_basis(spark, sf):
    """The two rows across each normal; the second, whose sign rounding may decide, with its middle
    part positive, or the last one where that is 0."""
    rows = P.directions(spark, sf, 3).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "u0", "u1", "u2")
    turn = F.when(F.col("row") == 1, F.signum(F.when(F.abs("c1") > 1e-9, F.col("c1")).otherwise(F.col("c2")))).otherwise(1.0)
    return constraints.normal_rows(rows, ["u0", "u1", "u2"], "axial").select("obs_id", "row", *[r6(F.col(f"c{k}") * turn, f"c{k}") for k in range(3)])


@query("normals_gradient", f"SELECT l_orderkey * 8 + l_linenumber AS obs_id, k AS \"row\", CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END AS c0, CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END AS c1, {s6('2 * CASE k WHEN 0 THEN u0 ELSE u1 END', 'lower')} FROM {DIRS2} CROSS JOIN (VALUES (0), (1)) t(k)")
def normals_gradient(spark, sf):
    rows = P.directions(spark, sf, 2).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "u0", "u1")
    return constraints.normal_rows(rows, ["u0", "u1"], "gradient", least=F.lit(2.0)).select("obs_id", "row", "c0", "c1", r6(F.col("lower"), "lower"))


@query("normals_cone", f"SELECT l_orderkey * 8 + l_linenumber AS obs_id, k AS \"row\", CASE WHEN k = 2 THEN 'bound' ELSE 'cone' END AS rel, {s6('CASE k WHEN 0 THEN u0 * tan(radians(20)) WHEN 1 THEN abs(u1) ELSE u0 END', 'c0')}, {s6('CASE k WHEN 0 THEN u1 * tan(radians(20)) WHEN 1 THEN CASE WHEN u1 = 0 THEN abs(u0) WHEN u1 < 0 THEN u0 ELSE -u0 END ELSE u1 END', 'c1')} FROM {DIRS2} CROSS JOIN (VALUES (0), (1), (2)) t(k)")
def normals_cone(spark, sf):
    rows = P.directions(spark, sf, 2).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "u0", "u1")
    made = constraints.normal_rows(rows, ["u0", "u1"], "cone", least=F.lit(0.5), angle=F.lit(20.0))
    return made.select("obs_id", "row", "rel", r6(F.col("c0"), "c0"), r6(F.col("c1"), "c1"))


@query("normals_near_zero", "SELECT l_orderkey * 8 + l_linenumber AS obs_id, round(sqrt(l_discount ** 2 + l_tax ** 2), 6) + 0.0 AS norm, sqrt(l_discount ** 2 + l_tax ** 2) <= 0.001 * l_quantity AS near_zero FROM lineitem")
def normals_near_zero(spark, sf):
    rows = P.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obs_id"), "l_discount", "l_tax", "l_quantity")
    return constraints.near_zero_gradients(rows, ["l_discount", "l_tax"], F.col("l_quantity"), 0.001).select("obs_id", r6(F.col("norm"), "norm"), "near_zero")


@query("normals_soft", "SELECT o_orderkey AS obs_id, 'only l2 does not depend on the basis' AS problem FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0")
def normals_soft(spark, sf):
    loss = F.when(F.col("o_orderkey") % 3 == 0, "l2").when(F.col("o_orderkey") % 3 == 1, "l1").otherwise("huber")
    rows = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), F.when(F.col("o_orderstatus") == "O", "soft").otherwise("hard").alias("enforcement"), loss.alias("loss"))
    return constraints.soft_normal_violations(rows, 3, "axial")


def _tangents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_suppkey").alias("ord"), F.lit("hard").alias("enforcement"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("string").alias("loss"), F.lit(None).cast("double").alias("delta"), F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 1000).alias("b"), F.lit(2.0).alias("t"), F.lit(-1.0).alias("s"))
    return constraints.tangent_rows(rows, ["a", "b"], ["t", "s"], (-1, (0.0, 0.0), 5.0))


@query("tangents_rows", "SELECT s_suppkey AS obs_id, s_suppkey AS ord, 'eq' AS rel, 0.0 AS target FROM supplier UNION ALL SELECT -1, max(s_suppkey) + 1, 'eq', 5.0 FROM supplier")
def tangents_rows(spark, sf):
    return _tangents(spark, sf)[0].select("obs_id", "ord", "rel", "target")


@query("tangents_terms", f"SELECT idx AS expr_id, 1.0 AS coef, 'dderiv' AS kind, {s6('x0', 'x0')}, {s6('x1', 'x1')}, 2.0 AS u0, -1.0 AS u1 FROM {SUPPLIERS} UNION ALL SELECT -1, 1.0, 'value', 0.0, 0.0, 0.0, 0.0")
def tangents_terms(spark, sf):
    return _tangents(spark, sf)[1].select("expr_id", "coef", "kind", r6(F.col("x0"), "x0"), r6(F.col("x1"), "x1"), "u0", "u1")


@query("hard_conflicts_exact", "SELECT o_orderkey AS \"row\", 0.1 * k AS lower, 0.1 * k AS upper FROM (SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS k FROM orders) WHERE k IN (1, 2, 3, 4, 6)")
def hard_conflicts_exact(spark, sf):
    """z = k / 10 and 3 z = 3 k / 10 for each order: both are binary numbers, which for most k exclude one another."""
    rows = P.table(spark, sf, "orders").select(F.col("o_orderkey"), (F.col("o_orderkey") % 7).cast("int").alias("k"))
    tenths = lambda of: F.get(F.array(*[F.lit(float(f"{n / 10:.1f}")) for n in range(19)]), of)
    both = F.explode(F.array(F.struct(F.col("o_orderkey").alias("row"), F.lit(1.0).alias("coef"), tenths(F.col("k")).alias("side")), F.struct((-F.col("o_orderkey")).alias("row"), F.lit(3.0).alias("coef"), tenths(F.col("k") * 3).alias("side")))).alias("r")
    spread = rows.select(F.col("o_orderkey").alias("var"), both).select("r.row", "var", "r.coef", F.col("r.side").alias("lower"), F.col("r.side").alias("upper"))
    found = constraints.hard_conflicts(spread)
    return found.select((-F.col("row")).alias("row"), r6(F.col("lower"), "lower"), r6(F.col("upper"), "upper"))


@query("thickness_labels", "SELECT s_suppkey AS idx, 'SampledLocalNormalCone' AS label FROM supplier")
def thickness_labels(spark, sf):
    return constraints.labelled_thickness(P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx")), "cone")


@query("thickness_cones", "SELECT s_suppkey AS obs_id, k AS \"row\", k - 1 AS axis, CASE WHEN k = 0 THEN 1.0 ELSE s_acctbal END AS coef FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3)) t(k)")
def thickness_cones(spark, sf):
    return constraints.thickness_cones(P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("obs_id"), "s_acctbal"), F.col("s_acctbal"), 3)


# -- levels: the lines of an order, each above the one before


_LEVELS = "(SELECT DISTINCT l_orderkey AS g, l_linenumber AS k, l_orderkey * 8 + l_linenumber AS id FROM lineitem)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    id_ = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    ordered = lines.select(id_.alias("upper_id"), F.lag(id_).over(w).alias("lower_id"), (F.col("l_linenumber") * 0.25).alias("min_gap"))
    return ordered.where("lower_id is not null").select("lower_id", "upper_id", "min_gap")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber")
    kind = F.when(k % 3 == 0, "fixed").otherwise("unknown")
    lines = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.select((F.col("l_orderkey") * 8 + k).alias("level_id"), (F.col("l_orderkey") * 8 + k).alias("ord"), kind.alias("kind"), F.when(kind == "fixed", k * 0.5).alias("value"), F.lit(None).cast("double").alias("mean"))


@query("levels_components", f"SELECT id AS level_id, min(id) OVER (PARTITION BY g) AS component FROM {_LEVELS}")
def levels_components(spark, sf):
    return levels.components(_levels(spark, sf), _orders(spark, sf))


@query("levels_topological", f"SELECT id AS level_id, row_number() OVER w - 1 AS depth, coalesce(sum(CASE WHEN first <> id THEN k * 0.25 END) OVER w, 0.0) AS height FROM (SELECT *, min(id) OVER (PARTITION BY g) AS first FROM {_LEVELS}) WINDOW w AS (PARTITION BY g ORDER BY k)")
def levels_topological(spark, sf):
    return levels.topological_depth(_levels(spark, sf), _orders(spark, sf)).select("level_id", F.col("depth").cast("long").alias("depth"), "height")


@query("levels_gauge", f"SELECT min(id) AS component, count(*) AS levels FROM {_LEVELS} GROUP BY g HAVING bool_and(k % 3 <> 0)")
def levels_gauge(spark, sf):
    return levels.loose_components(_levels(spark, sf), _orders(spark, sf))


@query(
    "levels_gauge_members",
    f"WITH g AS (SELECT *, bool_or(k % 2 = 1) OVER (PARTITION BY g) AS joined FROM {_LEVELS}), c AS (SELECT *, CASE WHEN joined THEN -1 ELSE g END AS part FROM g) SELECT min(id) AS component, count(*) AS levels FROM c GROUP BY part HAVING bool_and(k % 3 <> 0)",
)
def levels_gauge_members(spark, sf):
    """Odd lines' levels have members: the field connects their orders, so one fixed value among them holds all."""
    known = _levels(spark, sf)
    return levels.loose_components(known, _orders(spark, sf), known.where("level_id % 8 % 2 = 1"))


@query("levels_fixed_conflicts", f"WITH h AS (SELECT id, k, g, sum(k * 0.25) OVER (PARTITION BY g ORDER BY k) AS s FROM {_LEVELS}) SELECT a.id AS lower_id, b.id AS upper_id, b.s - a.s AS least, (b.k - a.k) * 0.5 AS difference FROM h a JOIN h b ON a.g = b.g AND a.k < b.k AND a.k % 3 = 0 AND b.k % 3 = 0 WHERE (b.k - a.k) * 0.5 < b.s - a.s")
def levels_fixed_conflicts(spark, sf):
    return levels.fixed_conflicts(_levels(spark, sf), _orders(spark, sf))


_MEMBERS = "(SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS g, l_linenumber AS k, CAST(l_orderkey AS DOUBLE) AS x0, CAST(l_linenumber % 2 AS DOUBLE) AS x1 FROM lineitem)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Odd lines of an order are at one place, even ones at another, so they must be equal."""
    lines = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("level_id"), F.col("l_orderkey").cast("double").alias("x0"), (F.col("l_linenumber") % 2).cast("double").alias("x1"))


@query("levels_closure", f"SELECT id AS level_id, min(id) OVER (PARTITION BY x0, x1) AS closure FROM {_MEMBERS}")
def levels_closure(spark, sf):
    return levels.membership_closure(_levels(spark, sf), _members(spark, sf), ["x0", "x1"])


@query(
    "levels_closure_conflicts",
    f"WITH m AS (SELECT *, min(id) OVER (PARTITION BY x0, x1) AS c FROM {_MEMBERS}) "
    "SELECT c AS closure, 'fixed' AS problem, min(k * 0.5) AS lower, max(k * 0.5) AS upper FROM m WHERE k % 3 = 0 GROUP BY c HAVING min(k) < max(k) "
    "UNION ALL SELECT c, 'order', 0.0, max(s) - min(s) FROM (SELECT *, sum(k * 0.25) OVER (PARTITION BY g ORDER BY k) AS s FROM m) GROUP BY c HAVING count(*) > 1",
)
def levels_closure_conflicts(spark, sf):
    return levels.closure_conflicts(_levels(spark, sf), _members(spark, sf), _orders(spark, sf), ["x0", "x1"])


@query(
    "levels_compiled",
    f"WITH v AS (SELECT *, row_number() OVER (ORDER BY id) + 2 AS var FROM {_LEVELS}), p AS (SELECT *, lag(var) OVER (PARTITION BY g ORDER BY k) AS lower_var FROM v) "
    "SELECT 'membership' AS cls, id AS obs_id, CAST(0 AS BIGINT) AS var, k * 1.0 AS coef, -0.5 AS rhs FROM v UNION ALL SELECT 'membership', id, var, -1.0, -0.5 FROM v UNION ALL SELECT 'fixed', id, var, 1.0, k * 0.5 FROM v WHERE k % 3 = 0 "
    "UNION ALL SELECT 'order', id, var, 1.0, k * 0.25 FROM p WHERE lower_var IS NOT NULL UNION ALL SELECT 'order', id, lower_var, -1.0, k * 0.25 FROM p WHERE lower_var IS NOT NULL",
)
def levels_compiled(spark, sf):
    """Memberships k z_0 + 0.5 - h = 0 of each line's level, fixed values and orders; three variables come before the levels'."""
    known, members = _levels(spark, sf), _members(spark, sf)
    terms = members.select(F.col("level_id").alias("obs_id"), F.lit(0).cast("long").alias("var"), F.pmod(F.col("level_id"), F.lit(8)).cast("double").alias("coef"), F.lit(0.5).alias("constant"))
    orders = _orders(spark, sf).withColumn("obs_id", F.col("upper_id"))
    made = levels.compile_levels(known, members.select("level_id", F.col("level_id").alias("obs_id")), orders, terms, 3)
    return made.select("cls", "obs_id", F.col("var").cast("long").alias("var"), F.col("coef").cast("double").alias("coef"), F.col("rhs").cast("double").alias("rhs"))


# -- level sets and thickness



@query("level_points_segments", "WITH p AS (SELECT row_number() OVER (ORDER BY x0) AS k, x0, y, lead(x0) OVER (ORDER BY x0) AS xr, lead(y) OVER (ORDER BY x0) AS yr FROM " + PTS1 + f"), m AS (SELECT avg(y) AS m FROM p) SELECT {s6('x0 + (m - y) / (yr - y) * (xr - x0)', 'x')}, 'crossing' AS kind FROM p, m WHERE (y < m) <> (yr < m)")
def level_points_segments(spark, sf):
    """Where the piecewise linear field through mean prices takes their mean; the scan's nodes are the centers and the middles."""
    centers = P.pts1(spark, sf).persist()
    mean, low, high = centers.agg(F.avg("y"), F.min("x0"), F.max("x0")).first()
    field = fields.fit_field(centers, Kernel("phs", 1), 1)
    found = levelsets.level_points(spark, field.function(), mean, low, high, int(high - low), tolerance=1e-13)
    return found.select(r6(F.col("x"), "x"), "kind")


_MEAN = "(SELECT avg(x0) / 10 AS m FROM " + PTS1 + ")"


_STEPS = f"(SELECT x0, floor(20 * y) AS y, row_number() OVER (ORDER BY x0) AS k FROM {PTS1})"


@query(
    "level_stretches",
    f"WITH m AS (SELECT min(y) AS m FROM {_STEPS}), h AS (SELECT x0, k, k - row_number() OVER (ORDER BY k) AS island FROM {_STEPS}, m WHERE y = m), i AS (SELECT min(x0) AS x, max(x0) AS until, count(*) AS n FROM h GROUP BY island), e AS (SELECT min(x0) AS low, max(x0) AS high FROM {_STEPS}) "
    f"SELECT {s6('x', 'x')}, CASE WHEN n > 1 THEN round(until, 6) + 0.0 END AS until, CASE WHEN n > 1 THEN 'interval' WHEN x = low OR x = high THEN 'boundary' ELSE 'crossing' END AS kind FROM i, e",
)
def level_stretches(spark, sf):
    """The lowest level of the piecewise linear function through whole numbers: stretches where neighbours have it, else points."""
    steps = P.pts1(spark, sf).withColumn("y", F.floor(20 * F.col("y")).cast("double")).persist()
    field = fields.fit_field(steps, Kernel("phs", 1), 1)
    least, low, high = steps.agg(F.min("y"), F.min("x0"), F.max("x0")).first()
    steps.unpersist()
    found = levelsets.level_set(spark, field.function(), least, low, high, int(high - low), tolerance=1e-9, width=1e-8)
    return found.select(r6(F.col("x"), "x"), (F.round("until", 6) + 0.0).alias("until"), "kind")


@query("level_points_stationary", f"SELECT level, {s6('m + t', 'x')}, CASE WHEN t = 0 THEN 'stationary' ELSE 'crossing' END AS kind, {s6('2 * t', 'slope')} FROM {_MEAN} CROSS JOIN (VALUES (0.0, 0.0), (1.0, -1.0), (1.0, 1.0)) v(level, t)")
def level_points_stationary(spark, sf):
    """(x - m)^2 through the sizes' places: it touches 0 at their mean m and crosses 1 on either side of it."""
    spots = P.pts1(spark, sf).withColumn("x0", F.col("x0") / 10).persist()
    m = spots.agg(F.avg("x0")).first()[0]
    field = fields.fit_field(spots.withColumn("y", (F.col("x0") - m) ** 2), Kernel("phs", 5), 1)
    at = lambda level: levelsets.level_points(spark, field.function(), level, m - 2.0, m + 1.7, 40, tolerance=1e-9, slope=field.function(1), width=1e-6).withColumn("level", F.lit(level))
    return at(0.0).union(at(1.0)).select("level", r6(F.col("x"), "x"), "kind", r6(F.round("slope", 4), "slope"))


def circle_field(spark: SparkSession, sf: str) -> fields.FittedField:
    """The square of the distance from the customers' mean place, through a place of each nation: its least, mean or largest
    balance."""
    u, v = F.col("x0"), F.col("x1")
    rows = P.customers(spark, sf).select((u / 12.5 - 1).alias("x0"), (v / 5 - 1).alias("x1"))
    cu, cv = rows.agg(F.avg("x0"), F.avg("x1")).first()
    nth = F.pmod(F.round((u + 1) * 12.5).cast("int"), F.lit(3))
    spot = rows.groupBy("x0").agg(F.min("x1").alias("low"), F.avg("x1").alias("mean"), F.max("x1").alias("high")).select("x0", F.when(nth == 0, F.col("low")).when(nth == 1, F.col("mean")).otherwise(F.col("high")).alias("x1"))
    centers = spot.select(F.lit(0).cast("long").alias("field_id"), (F.row_number().over(Window.orderBy("x0", "x1")) - 1).alias("idx"), u, v, ((u - cu) ** 2 + (v - cv) ** 2).alias("y"))
    return fields.fit_field(centers.persist(), Kernel("phs", 5), 2)


def _circle_nodes(spark: SparkSession, sf: str) -> tuple[fields.FittedField, DataFrame]:
    """As many cells a side as the square root of the number of suppliers, at least 24."""
    n = max(24, int(P.table(spark, sf, "supplier").count() ** 0.5))
    field = circle_field(spark, sf)
    return field, levelsets.grid_nodes(spark, field.function(), 0.81, (-1.5, -1.5), (1.5, 1.5), (n, n))


_N = "(SELECT greatest(24, CAST(floor(sqrt(count(*))) AS INTEGER)) AS n FROM supplier)"
_MID = f"(SELECT avg(x0 / 12.5 - 1) AS cu, avg(x1 / 5 - 1) AS cv FROM {CUSTOMERS})"
_NODES = f"(SELECT *, (x - cu) ** 2 + (y - cv) ** 2 - 0.81 AS g FROM (SELECT i, j, n, cu, cv, -1.5 + i * (3.0 / n) AS x, -1.5 + j * (3.0 / n) AS y FROM {_N} c, {_MID} m, LATERAL (SELECT unnest(range(n + 1)) AS i) a, LATERAL (SELECT unnest(range(n + 1)) AS j) b))"
_SIDES = (
    f"(SELECT 'h' AS side, a.i AS i, a.j AS j, a.cu + sign(a.x + b.x - 2 * a.cu) * sqrt(0.81 - (a.y - a.cv) ** 2) AS x, a.y AS y, a.cu AS cu, a.cv AS cv FROM {_NODES} a JOIN {_NODES} b ON b.i = a.i + 1 AND b.j = a.j WHERE (a.g < 0) <> (b.g < 0) "
    f"UNION ALL SELECT 'v', a.i, a.j, a.x, a.cv + sign(a.y + b.y - 2 * a.cv) * sqrt(0.81 - (a.x - a.cu) ** 2), a.cu, a.cv FROM {_NODES} a JOIN {_NODES} b ON b.j = a.j + 1 AND b.i = a.i WHERE (a.g < 0) <> (b.g < 0))"
)


@query("iso_nodes", f"SELECT i, j, {s6('g', 'g')} FROM {_NODES}")
def iso_nodes(spark, sf):
    return _circle_nodes(spark, sf)[1].select("i", "j", r6(F.col("g"), "g"))


@query("iso_edges", f"SELECT side, i, j, {s6('x', 'x')}, {s6('y', 'y')} FROM {_SIDES}")
def iso_edges(spark, sf):
    field, nodes = _circle_nodes(spark, sf)
    return levelsets.edge_crossings(nodes, field.function(), 0.81).select("side", "i", "j", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


def _circle_lines(spark: SparkSession, sf: str, method: str) -> DataFrame:
    field, nodes = _circle_nodes(spark, sf)
    vertices = levelsets.edge_crossings(nodes, field.function(), 0.81, diagonals=method == "simplices")
    return levelsets.isolines(nodes, vertices, method)


@query("iso_polylines", f"SELECT count(*) AS vertices, count(*) AS segments, true AS closed FROM {_SIDES}")
def iso_polylines(spark, sf):
    return levelsets.line_summary(_circle_lines(spark, sf, "squares")).select("vertices", "segments", "closed")


@query(
    "iso_vertices",
    f"WITH v AS (SELECT x, y, row_number() OVER (ORDER BY side, i, j) AS vid, row_number() OVER (ORDER BY atan2(y - cv, x - cu)) - 1 AS k, count(*) OVER () AS n FROM {_SIDES}), s AS (SELECT k AS k0 FROM v WHERE vid = 1), "
    "f AS (SELECT *, (k - k0 + n) % n AS ahead FROM v, s), w AS (SELECT max(CASE WHEN ahead = 1 THEN vid END) < max(CASE WHEN ahead = n - 1 THEN vid END) AS up FROM f) "
    f"SELECT CASE WHEN up THEN ahead ELSE (n - ahead) % n END AS seq, {s6('x', 'x')}, {s6('y', 'y')} FROM f, w",
)
def iso_vertices(spark, sf):
    """The circle's vertices in the order of the line: from the first, towards its neighbour that comes first."""
    return _circle_lines(spark, sf, "squares").select(F.col("seq").cast("long").alias("seq"), r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query(
    "iso_simplices",
    f"SELECT vertices + d AS vertices, vertices + d AS segments, true AS closed FROM (SELECT count(*) AS vertices FROM {_SIDES}), (SELECT count(*) AS d FROM {_NODES} a JOIN {_NODES} b ON b.i = a.i + 1 AND b.j = a.j + 1 WHERE (a.g < 0) <> (b.g < 0))",
)
def iso_simplices(spark, sf):
    return levelsets.line_summary(_circle_lines(spark, sf, "simplices")).select("vertices", "segments", "closed")


@query("thickness_samples", "SELECT c_custkey AS idx, CASE WHEN abs(x) <= 4 THEN 1.0 END AS thickness, CASE WHEN abs(x) > 4 THEN 'not_found' END AS failure FROM (SELECT c_custkey, c_acctbal / 1000 - 4 AS x FROM customer)")
def thickness_samples(spark, sf):
    """f = 2 x between the levels -9 and 9: wherever both are within reach the thickness is 9."""
    rows = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal") / 1000 - 4).alias("x"))
    made = levelsets.thickness(rows, ["x"], lambda x: x[0] * 2.0, lambda x: [x[0] * 0.0 + 2.0], (-9.0, 9.0), 8.5, 17)
    return made.select("idx", (F.round(F.col("thickness") / 9, 6) + 0.0).alias("thickness"), "failure")


_UPDOWN = "(SELECT *, (-r + sqrt(r * r + 4 * q * (10 - p))) / (2 * q) + (r - sqrt(r * r - 4 * q * (p - 0.05))) / (2 * q) AS t FROM (SELECT *, x * y AS p, sqrt(x * x + y * y) AS r, x * y / (x * x + y * y) AS q FROM (SELECT c_custkey, c_nationkey / 10 + 0.5 AS x, c_acctbal / 5000 + 0.5 AS y FROM customer)))"


def _saddle_thickness(spark: SparkSession, sf: str) -> DataFrame:
    """f = x y between 0.05 and 10: along its gradient's line f is quadratic."""
    rows = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_nationkey") / 10 + 0.5).alias("x"), (F.col("c_acctbal") / 5000 + 0.5).alias("y"))
    return levelsets.thickness(rows, ["x", "y"], lambda x: x[0] * x[1], lambda x: [x[1], x[0]], (0.05, 10.0), 8.0, 16)


@query("thickness_saddle", f"SELECT c_custkey AS idx, {s6('t', 'thickness')} FROM {_UPDOWN}")
def thickness_saddle(spark, sf):
    return _saddle_thickness(spark, sf).select("idx", r6(F.col("thickness"), "thickness"))


@query("thickness_quantiles", f"SELECT count(*) AS measured, CAST(0 AS BIGINT) AS failed, count(*) FILTER (t < 3) AS violations, {s6('min(t)', 'minimum')}, {s6('min(t)', 'q0')}, {s6('quantile_cont(t, 0.5)', 'q1')}, {s6('quantile_cont(t, 0.9)', 'q2')} FROM {_UPDOWN}")
def thickness_quantiles(spark, sf):
    made = levelsets.thickness_report(_saddle_thickness(spark, sf), 3.0, [0.0, 0.5, 0.9])
    return made.select("measured", "failed", "violations", *[r6(F.col(c), c) for c in ("minimum", "q0", "q1", "q2")])


@query("thickness_proposals", f"SELECT c_custkey AS idx, 3.0 AS thickness, 'SampledGeometricValidation' AS label FROM {_UPDOWN} WHERE t < 3")
def thickness_proposals(spark, sf):
    return levelsets.thickness_proposals(_saddle_thickness(spark, sf), 3.0).select("idx", F.col("required").alias("thickness"), "label")


# -- convex problems


@query("convex_box_qp", "SELECT c_custkey AS problem_id, least(greatest(c_acctbal / 1000, 0.0), 5.0) AS value FROM customer")
def convex_box_qp(spark, sf):
    value = convex.box_projection(F.col("c_acctbal") / 1000, F.lit(0.0), F.lit(5.0))
    return P.table(spark, sf, "customer").select(F.col("c_custkey").alias("problem_id"), value.alias("value"))


@query("convex_box_qp_solver", "SELECT CAST(n_nationkey AS BIGINT) AS problem_id, round(least(greatest(m, 0.0), 4.5), 4) + 0.0 AS value FROM (SELECT c_nationkey AS n_nationkey, avg(c_acctbal / 1000) AS m FROM customer GROUP BY 1)")
def convex_box_qp_solver(spark, sf):
    """The mean balance of each nation's customers within a box, by the interior-point method: a problem a nation."""
    m = P.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("problem_id")).agg((F.avg("c_acctbal") / 1000).alias("target"))
    null = F.lit(None).cast("double")
    entry = lambda row, cls, target, low, high: F.struct(F.lit(row).alias("row"), F.lit(cls).alias("cls"), F.lit(0).cast("long").alias("var"), F.lit(1.0).alias("coef"), target.alias("target"), low.alias("lower"), high.alias("upper"), F.lit(1.0).alias("scale"), F.lit("l2").alias("loss"), null.alias("delta"))
    rows = m.select("problem_id", F.explode(F.array(entry(0, "soft", F.col("target"), null, null), entry(1, "bound", null, F.lit(0.0), F.lit(4.5)))).alias("r")).select("problem_id", "r.*")
    return convex.solve_problems(rows).select("problem_id", (F.round("value", 4) + 0.0).alias("value"))


def _entries(rows: DataFrame, *made: Column) -> DataFrame:
    return rows.select("problem_id", F.explode(F.array(*made)).alias("r")).select("problem_id", "r.*")


def _entry(row: int, cls: str, var: int, target: Column | None = None, lower: Column | None = None, upper: Column | None = None, loss: str = "l2", coef: float = 1.0, cone: int | None = None) -> Column:
    side = lambda c: (F.lit(None) if c is None else c).cast("double")
    return F.struct(
        F.lit(row).alias("row"), F.lit(cls).alias("cls"), F.lit(var).cast("long").alias("var"), F.lit(coef).alias("coef"), side(target).alias("target"), side(lower).alias("lower"), side(upper).alias("upper"),
        F.lit(1.0).alias("scale"), F.lit(loss).alias("loss"), F.lit(0.75).alias("delta"), F.lit(cone).cast("long").alias("cone"),
    )


_MEANS = "(SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS m FROM customer GROUP BY 1)"


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("problem_id")).agg((F.avg("c_acctbal") / 1000).alias("m"))


_P3 = f"(SELECT k, m - k * 0.5 AS h, k * 0.3 AS a, m - 2 AS b, sqrt((k * 0.3) ** 2 + (m - 2) ** 2) AS v FROM {_MEANS})"
_HEAD = "CASE WHEN v <= h THEN h WHEN v <= -h THEN 0 ELSE (h + v) / 2 END"
_FACTOR = "CASE WHEN v <= h THEN 1 WHEN v <= -h THEN 0 ELSE (h + v) / 2 / v END"


@query("convex_soc_solver", f"SELECT CAST(k AS BIGINT) AS problem_id, CAST(var AS BIGINT) AS var, round(CASE var WHEN 0 THEN {_HEAD} WHEN 1 THEN {_FACTOR} * a ELSE {_FACTOR} * b END, 3) + 0.0 AS value FROM {_P3} CROSS JOIN (VALUES (0), (1), (2)) t(var)")
def convex_soc_solver(spark, sf):
    """The nearest point of the cone x_0 >= |(x_1, x_2)| to a point for each nation."""
    m, k = F.col("m"), F.col("problem_id")
    rows = _entries(_means(spark, sf), *[_entry(n, "soft", n, t) for n, t in enumerate((m - k * 0.5, k * 0.3, m - 2))], *[_entry(3 + n, "cone", n, cone=0) for n in range(3)])
    return convex.solve_problems(rows).select("problem_id", "var", (F.round("value", 3) + 0.0).alias("value"))


@query("convex_soft_bounds", f"SELECT CAST(k AS BIGINT) AS problem_id, round((m + least(greatest(m, 2 + k * 0.1), 3 + k * 0.1)) / 1.994, 4) + 0.0 AS value FROM {_MEANS}")
def convex_soft_bounds(spark, sf):
    """Between a target and an interval, both with squared loss: halfway from the target to the interval."""
    m, k = F.col("m"), F.col("problem_id")
    rows = _entries(_means(spark, sf), _entry(0, "soft", 0, m), _entry(1, "soft", 0, None, 2 + k * 0.1, 3 + k * 0.1))
    return convex.solve_problems(rows).select("problem_id", (F.round(F.col("value") / 0.997, 4) + 0.0).alias("value"))  # no ties in rounding


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A problem for each supplier: its number and its balance in thousands."""
    return P.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("problem_id"), (F.col("s_acctbal") / 1000).alias("m"))


_BALANCE = "(SELECT s_suppkey AS k, s_acctbal / 1000 AS m FROM supplier)"


@query("convex_wide_bounds", f"SELECT CAST(k AS BIGINT) AS problem_id, CAST(v AS BIGINT) AS var, round(CASE v WHEN 0 THEN least(greatest(m, 0.0), 10.0 ** (k % 10)) ELSE greatest(m / 1000, 0) END * 1000 / 0.997, 2) + 0.0 AS value FROM {_BALANCE} CROSS JOIN (VALUES (0), (1)) t(v)")
def convex_wide_bounds(spark, sf):
    """Values of thousands and of thousandths, within bounds from 1 to 10^9."""
    m, k = F.col("m"), F.col("problem_id")
    rows = _entries(_suppliers(spark, sf), _entry(0, "soft", 0, m), _entry(1, "soft", 1, m / 1000), _entry(2, "bound", 0, None, F.lit(0.0), F.pow(F.lit(10.0), k % 10)), _entry(3, "bound", 1, None, F.lit(0.0), F.lit(1e9)))
    return convex.solve_problems(rows).select("problem_id", "var", (F.round(F.col("value") * 1000 / 0.997, 2) + 0.0).alias("value"))


@query("convex_touching_cone", f"SELECT CAST(k AS BIGINT) AS problem_id, 'solved' AS status, round(m * m, 4) + 0.0 AS objective FROM {_BALANCE}")
def convex_touching_cone(spark, sf):
    """|x| <= t = 0 has no inner point, but a solution: x = 0, however far from where x ought to be; y is free."""
    m, k = F.col("m"), F.col("problem_id")
    rows = _entries(_suppliers(spark, sf), _entry(0, "eq", 2, F.lit(0.0)), _entry(1, "cone", 2, cone=0), _entry(2, "cone", 0, cone=0), _entry(3, "soft", 0, m), _entry(4, "soft", 1, k / 7))
    return convex.problem_status(rows).select("problem_id", "status", (F.round("objective", 4) + 0.0).alias("objective"))


@query("convex_infeasible_cone", f"SELECT CAST(k AS BIGINT) AS problem_id, CASE WHEN k % 3 = 2 THEN 'infeasible' ELSE 'solved' END AS status, CAST(CASE k % 3 WHEN 0 THEN 0.25 WHEN 1 THEN round((2 - sqrt(1.25)) ** 2, 3) END AS DOUBLE) AS objective FROM {_BALANCE}")
def convex_infeasible_cone(spark, sf):
    """|(x, y)| <= t <= 1.5 and x >= 0, 1 or 2, y ought to be 2: the cone's end, a part of it, or nothing."""
    k = F.col("problem_id")
    rows = _entries(_suppliers(spark, sf), _entry(0, "cone", 2, cone=0), _entry(1, "cone", 0, cone=0), _entry(2, "cone", 1, cone=0), _entry(3, "bound", 2, None, None, F.lit(1.5)), _entry(4, "bound", 0, None, k % 3, None), _entry(5, "soft", 1, F.lit(2.0)))
    return convex.problem_status(rows).select("problem_id", "status", (F.round("objective", 3) + 0.0).alias("objective"))


@query("convex_status", f"SELECT CAST(k AS BIGINT) AS problem_id, CASE WHEN k % 3 = 0 THEN 'infeasible' ELSE 'solved' END AS status, CASE WHEN k % 3 <> 0 THEN round(greatest(m - 5 - k * 0.01, 0), 4) + 0.0 END AS objective FROM {_MEANS}")
def convex_status(spark, sf):
    """x + y = 5 + k / 100 and y >= 0; for every third nation y >= 1 and x >= 5, which cannot be. x ought to be m."""
    m, k = F.col("m"), F.col("problem_id")
    third = k % 3 == 0
    both = [_entry(0, "eq", v, 5 + k * 0.01) for v in (0, 1)]
    rows = _entries(_means(spark, sf), *both, _entry(1, "bound", 0, None, F.when(third, 5.0), None), _entry(2, "bound", 1, None, F.when(third, 1.0).otherwise(0.0), None), _entry(3, "soft", 0, m, loss="l1"))
    made = convex.problem_status(rows.where("cls <> 'bound' or lower is not null"))
    return made.select("problem_id", "status", (F.round(F.when(F.abs("objective") < 1e-6, 0.0).otherwise(F.col("objective")), 4) + 0.0).alias("objective"))


@query("convex_l1_median", "WITH s AS (SELECT o_custkey, o_totalprice AS v, count(*) AS w FROM orders GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey ORDER BY v) AS below, sum(w) OVER (PARTITION BY o_custkey) AS total FROM s) SELECT o_custkey, min(v) AS median FROM c WHERE below * 2 >= total GROUP BY 1")
def convex_l1_median(spark, sf):
    return convex.weighted_median(P.table(spark, sf, "orders").withColumn("w", F.lit(1)), ["o_custkey"], "o_totalprice", "w")


@query("convex_huber", "SELECT o_orderkey, round(CASE WHEN abs(t) <= 0.75 THEN t * t / 2 ELSE 0.75 * abs(t) - 0.28125 END, 6) + 0.0 AS loss FROM (SELECT o_orderkey, o_totalprice / 99700 - 2 AS t FROM orders)")
def convex_huber(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", r6(convex.huber(F.col("o_totalprice") / 99700 - 2, 0.75), "loss"))


@query("convex_soc_projection", f"SELECT idx, {s6('CASE WHEN v <= h THEN h WHEN v <= -h THEN 0 ELSE (h + v) / 2 END', 'head')}, {s6('CASE WHEN v <= h THEN 1 WHEN v <= -h THEN 0 ELSE (h + v) / 2 / v END', 'factor')} FROM (SELECT idx, x1 AS h, sqrt(x0 ** 2 + 1) / 4 AS v FROM {CUSTOMERS})")
def convex_soc_projection(spark, sf):
    made = convex.cone_projection(F.col("x1"), F.sqrt(F.col("x0") ** 2 + 1) / 4)
    return P.customers(spark, sf).select("idx", r6(made["head"], "head"), r6(made["factor"], "factor"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return fit_matern12_eval(spark, sf)
