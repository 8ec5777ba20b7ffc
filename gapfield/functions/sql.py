"""Grid arithmetic, closest points and contact laws as SQL functions.

All bodies are SQL, so a call is inlined into the plan like any other expression: no Python runs and
filters, pruning and code generation see through it. Helpers hand intermediate values on as
arguments, which binds each of them once. Functions are temporary, of the session that registered them.

Vectors are ``STRUCT<x, y, z>``, grids ``STRUCT<bmin, vox, dims>`` of vectors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .grid import BLOCK_BITS, LADDER

VEC = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
IDX = "STRUCT<i: BIGINT, j: BIGINT, k: BIGINT>"
GRID = f"STRUCT<bmin: {VEC}, vox: {VEC}, dims: {IDX}>"
_AXES = tuple(zip("xyz", "ijk"))


def _vec(expr: str, names: str = "xyz") -> str:
    """A vector from one expression in which {a} is the axis and {n} the index."""
    return "named_struct(" + ", ".join(f"'{o}', {expr.format(a=a, n=n)}" for o, (a, n) in zip(names, _AXES)) + ")"


_LADDER = "CASE " + " ".join(f"WHEN n <= {s} THEN {s}" for s in LADDER[:-1]) + f" ELSE {LADDER[-1]} END"
_MASK = (1 << BLOCK_BITS) - 1

#: name, parameters, result, body; helpers first
SCALARS = (
    ("gf_vec", "x DOUBLE, y DOUBLE, z DOUBLE", VEC, "named_struct('x', x, 'y', y, 'z', z)"),
    ("gf_dot", f"p {VEC}, q {VEC}", "DOUBLE", "p.x * q.x + p.y * q.y + p.z * q.z"),
    ("gf_minus", f"p {VEC}, q {VEC}", VEC, _vec("p.{a} - q.{a}")),
    ("gf_scaled", f"p {VEC}, s DOUBLE", VEC, _vec("p.{a} * s")),
    ("gf_norm", f"p {VEC}", "DOUBLE", "sqrt(p.x * p.x + p.y * p.y + p.z * p.z)"),
    # grids
    ("gf_grid_center", f"g {GRID}, at {IDX}", VEC, _vec("g.bmin.{a} + (at.{n} + 0.5D) * g.vox.{a}")),
    ("gf_grid_nearest", f"g {GRID}, p {VEC}", IDX, _vec("CAST(round((p.{a} - g.bmin.{a}) / g.vox.{a} - 0.5D) AS BIGINT)", "ijk")),
    ("gf_grid_cell", f"g {GRID}, p {VEC}", IDX, _vec("CAST(floor((p.{a} - g.bmin.{a}) / g.vox.{a} - 0.5D) AS BIGINT)", "ijk")),
    ("gf_grid_inside", f"g {GRID}, at {IDX}, margin BIGINT", "BOOLEAN", " AND ".join(f"at.{n} >= 0 AND at.{n} + margin < g.dims.{n}" for n in "ijk")),
    ("gf_grid_lin", f"g {GRID}, at {IDX}", "BIGINT", "at.i + g.dims.i * (at.j + g.dims.j * at.k)"),
    ("gf_grid_from_lin", f"g {GRID}, n BIGINT", IDX, "named_struct('i', pmod(n, g.dims.i), 'j', pmod(n DIV g.dims.i, g.dims.j), 'k', n DIV (g.dims.i * g.dims.j))"),
    ("gf_block_key", f"at {IDX}, dim BIGINT", "BIGINT", f"shiftleft(floor(at.k / dim) & {_MASK}L, {2 * BLOCK_BITS}) | shiftleft(floor(at.j / dim) & {_MASK}L, {BLOCK_BITS}) | (floor(at.i / dim) & {_MASK}L)"),
    ("gf_snap", "n BIGINT, most BIGINT", "BIGINT", f"least({_LADDER}, most)"),
    # closest point of a triangle: the weights of its two edges from their products with each other and with the point
    ("gf_closest_edges", "uu DOUBLE, uw DOUBLE, ww DOUBLE, up DOUBLE, wp DOUBLE, by_c DOUBLE, by_b DOUBLE, far DOUBLE, back DOUBLE", "STRUCT<s: DOUBLE, t: DOUBLE>",
     """CASE WHEN up <= 0 AND wp <= 0 THEN named_struct('s', 0D, 't', 0D)
       WHEN up >= uu AND wp - uw <= up - uu THEN named_struct('s', 1D, 't', 0D)
       WHEN by_c <= 0 AND up >= 0 AND up <= uu THEN named_struct('s', coalesce(try_divide(up, uu), 0D), 't', 0D)
       WHEN wp >= ww AND up - uw <= wp - ww THEN named_struct('s', 0D, 't', 1D)
       WHEN by_b <= 0 AND wp >= 0 AND wp <= ww THEN named_struct('s', 0D, 't', coalesce(try_divide(wp, ww), 0D))
       WHEN uu * ww - uw * uw - by_b - by_c <= 0 AND far >= 0 AND back >= 0 THEN named_struct('s', 1D - coalesce(try_divide(far, far + back), 0D), 't', coalesce(try_divide(far, far + back), 0D))
       ELSE named_struct('s', coalesce(try_divide(by_b, uu * ww - uw * uw), 0D), 't', coalesce(try_divide(by_c, uu * ww - uw * uw), 0D)) END"""),
    ("gf_closest_weights", "uu DOUBLE, uw DOUBLE, ww DOUBLE, up DOUBLE, wp DOUBLE", "STRUCT<s: DOUBLE, t: DOUBLE>",
     "gf_closest_edges(uu, uw, ww, up, wp, uu * wp - uw * up, up * ww - wp * uw, (wp - uw) - (up - uu), (up - uw) - (wp - ww))"),
    ("gf_on_triangle", f"a {VEC}, u {VEC}, w {VEC}, m STRUCT<s: DOUBLE, t: DOUBLE>", VEC, _vec("a.{a} + m.s * u.{a} + m.t * w.{a}")),
    ("gf_closest_from", f"a {VEC}, u {VEC}, w {VEC}, q {VEC}", VEC, "gf_on_triangle(a, u, w, gf_closest_weights(gf_dot(u, u), gf_dot(u, w), gf_dot(w, w), gf_dot(u, q), gf_dot(w, q)))"),
    ("gf_closest_point", f"p {VEC}, a {VEC}, b {VEC}, c {VEC}", VEC, "gf_closest_from(a, gf_minus(b, a), gf_minus(c, a), gf_minus(p, a))"),
    # contact laws
    ("gf_pressure", "gap DOUBLE, k DOUBLE, eps DOUBLE", "DOUBLE", "k * greatest(eps - gap, 0D)"),
    ("gf_pressure_pow", "gap DOUBLE, k DOUBLE, ord DOUBLE", "DOUBLE", "CASE WHEN gap < 0 THEN k * power(-gap, ord) ELSE 0D END"),
    ("gf_damping", f"gap DOUBLE, c DOUBLE, vn DOUBLE, grad {VEC}", VEC, "gf_scaled(grad, CASE WHEN gap < 0 AND c > 0 THEN -vn * c ELSE 0D END)"),
    ("gf_friction_over", f"ut {VEC}, pull DOUBLE, plain DOUBLE, reg DOUBLE", VEC, "gf_scaled(ut, try_divide(pull, CASE WHEN reg > 0 THEN sqrt(plain * plain + reg * reg) WHEN plain > 1e-15D THEN plain ELSE 1D END))"),
    ("gf_friction", f"ut {VEC}, p DOUBLE, mu DOUBLE, reg DOUBLE", VEC, "gf_friction_over(ut, -mu * p, gf_norm(ut), reg)"),
)

#: name, parameters, columns, body
TABLES = (
    ("gf_voxels", f"g {GRID}", "i BIGINT, j BIGINT, k BIGINT, x DOUBLE, y DOUBLE, z DOUBLE",
     "SELECT i, j, k, g.bmin.x + (i + 0.5D) * g.vox.x, g.bmin.y + (j + 0.5D) * g.vox.y, g.bmin.z + (k + 0.5D) * g.vox.z FROM explode(sequence(0L, g.dims.i - 1L)) AS a(i), explode(sequence(0L, g.dims.j - 1L)) AS b(j), explode(sequence(0L, g.dims.k - 1L)) AS c(k)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; their names."""
    for name, params, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    for name, params, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({columns}) RETURN {body}")
    return [f[0] for f in (*SCALARS, *TABLES)]
