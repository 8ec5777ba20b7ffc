"""SQL twins of :mod:`checks.tables`, and string helpers for vector algebra in SQL."""

from __future__ import annotations

import re

X = ("x", "y", "z")
FR = ("6.180339887e-1", "4.142135623e-1", "7.320508075e-1")
# "by" is a keyword, so the second corner is called e here
CORNERS = [f"{c}{a}" for c in "aec" for a in X]


def frac(c, m):
    return f"({c}*{m} - floor({c}*{m}))"


def scatter(c, width, low):
    return [f"({frac(c, m)}*{width} + ({low}))" for m in FR]


def vec(prefix):
    return [f"{prefix}{a}" for a in X]


def add(a, b):
    return [f"({p}+{q})" for p, q in zip(a, b)]


def sub(a, b):
    return [f"({p}-{q})" for p, q in zip(a, b)]


def mul(a, s):
    return [f"({p}*({s}))" for p in a]


def dot(a, b):
    return "(" + " + ".join(f"{p}*{q}" for p, q in zip(a, b)) + ")"


def cross(a, b):
    return [f"({a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[2]}*{b[0]} - {a[0]}*{b[2]})", f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"]


def norm(a):
    return f"sqrt{dot(a, a)}"


def cols(exprs, prefix):
    return ", ".join(f"{e} AS {prefix}{a}" for e, a in zip(exprs, X))


def r6(expr, name=None, digits=6):
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def r6s(names, digits=6):
    return ", ".join(r6(n, n, digits) for n in names)


def mat(prefix):
    return [[f"{prefix}{r}{c}" for c in range(3)] for r in range(3)]


def transpose(m):
    return [[m[c][r] for c in range(3)] for r in range(3)]


def matmul(a, b):
    return [[dot(a[r], [b[k][c] for k in range(3)]) for c in range(3)] for r in range(3)]


def matvec(a, v):
    return [dot(a[r], v) for r in range(3)]


def mcols(m, prefix):
    return ", ".join(f"{m[r][c]} AS {prefix}{r}{c}" for r in range(3) for c in range(3))


# ---- derived tables ------------------------------------------------------------------------

TRI = "tri AS (SELECT CAST(label AS VARCHAR) AS mesh_id, vec_id AS tri_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(CORNERS)
) + " FROM embeddings)"
PTS = "pts AS (SELECT CAST(o_orderkey % 10 AS VARCHAR) AS mesh_id, o_orderkey AS qid, " + cols(scatter("o_totalprice", "8e-1", "-4e-1"), "") + " FROM orders)"
VERT = "vert AS (" + " UNION ALL ".join(
    f"SELECT mesh_id, tri_id*3+{n} AS vid, {c}x AS x, {c}y AS y, {c}z AS z FROM tri" for n, c in enumerate("aec")
) + ")"

_n = cross(sub(vec("e"), vec("a")), sub(vec("c"), vec("a")))
TRIN = f"""trif AS (SELECT *, {cols(_n, "f")} FROM tri),
tril AS (SELECT *, {norm(vec("f"))} AS fl FROM trif),
trin AS (SELECT *, {", ".join(f"CASE WHEN fl > 1e-15 THEN f{a}/fl ELSE {d} END AS n{a}" for a, d in zip(X, ("0e0", "0e0", "1e0")))} FROM tril)"""

SPHERES = f"""fields AS (SELECT s_suppkey AS field_id, {frac("s_acctbal", FR[0])}*4e-1+3e-1 AS radius,
 {frac("s_acctbal", FR[1])}*2e-1-1e-1 AS cx, {frac("s_acctbal", FR[2])}*2e-1-1e-1 AS cy, 5e-2 AS cz,
 CASE WHEN s_nationkey % 2 = 0 THEN 3 ELSE 0 END AS stride FROM supplier),
vox0 AS (SELECT f.*, i, j, k, (i+5e-1)*25e-2-1e0-cx AS dx, (j+5e-1)*25e-2-1e0-cy AS dy, (k+5e-1)*25e-2-1e0-cz AS dz
 FROM fields f, range(8) a(i), range(8) b(j), range(8) c(k)),
vox1 AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS l FROM vox0),
vox AS (SELECT field_id, stride, i, j, k, i//4 AS bi, j//4 AS bj, k//4 AS bk, l, l-radius AS phi, dx/l AS nx, dy/l AS ny, dz/l AS nz FROM vox1)"""
SPTS = f"""spts AS (SELECT coalesce(field_id, -1) AS field_id, o_orderkey AS qid, {cols(scatter("o_totalprice", "21e-1", "-105e-2"), "")}
 FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS field_id FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
RPTS = f"""spts AS (SELECT DISTINCT l_suppkey AS field_id, l_orderkey*10 + l_linenumber AS qid, {cols(scatter("l_extendedprice", "21e-1", "-105e-2"), "")} FROM lineitem)"""
# index of the nearest voxel and of the cell, as in the grid arithmetic
LOC = f"""loc AS (SELECT *, {", ".join(f"CAST(round(({a}+1e0)/25e-2-5e-1) AS BIGINT) AS i{a}" for a in X)},
 {", ".join(f"CAST(floor(({a}+1e0)/25e-2-5e-1) AS BIGINT) AS c{a}" for a in X)},
 {", ".join(f"({a}+1e0)/25e-2-5e-1 - floor(({a}+1e0)/25e-2-5e-1) AS t{a}" for a in X)} FROM spts)"""

CROWS = f"""crows AS (SELECT l_returnflag AS run_id, CAST(l_linenumber AS DOUBLE) AS t, l_suppkey AS cp_id, l_orderkey AS qid,
 l_discount - 5e-2 AS gap, l_quantity AS w, {cols(scatter("l_extendedprice", "2e0", "-1e0"), "g")},
 {cols(scatter("l_extendedprice", "1e0", "0e0")[::-1], "p")}, {cols(scatter("s_acctbal", "2e0", "-1e0"), "ra")},
 {cols(scatter("s_acctbal", "1e0", "5e-1")[::-1], "rb")},
 {", ".join(f"l_tax*{n + 1} - 1e-1*{m} AS {q}{a}" for m, q in enumerate(("va", "oa", "vb", "ob")) for n, a in enumerate(X))},
 (l_linestatus = 'O') AS valid, 1e3 AS k, 3e-1 AS mu, 1e0 + l_linenumber % 2 AS ord, 1e1 AS damping, 1e-4 AS reg, 1e-2 AS eps
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

EV = "ev AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - 1704067200000000)/1e6 AS t, value FROM events)"
MEAS = """meas AS (SELECT user_id, event_type, t, value - 2e1 AS gap, greatest(0e0, -(value - 2e1)) AS penetration,
 CASE WHEN value - 2e1 < 0 THEN 1 ELSE 0 END AS active_count, CAST(event_id % 5 - 1 AS DOUBLE) AS normal_velocity FROM ev)"""


def closest(src, keep, out):
    """CTE text: closest point of every row of ``src`` (point x y z, triangle a b c) to its triangle.

    Tries the foot on the plane and on the three edges and takes the nearest, which is another
    route than the region test of the engine.
    """
    k = ", ".join(keep)
    u, w, q = sub(vec("e"), vec("a")), sub(vec("c"), vec("a")), sub(vec(""), vec("a"))
    at = lambda s, t: norm(sub(vec("q"), add(mul(vec("u"), s), mul(vec("w"), t))))
    return f"""{out}0 AS (SELECT *, {cols(u, "u")}, {cols(w, "w")}, {cols(q, "q")} FROM {src}),
{out}1 AS (SELECT *, {dot(vec("u"), vec("u"))} AS uu, {dot(vec("u"), vec("w"))} AS uw, {dot(vec("w"), vec("w"))} AS ww,
 {dot(vec("u"), vec("q"))} AS d1, {dot(vec("w"), vec("q"))} AS d2_ FROM {out}0),
{out}2 AS (SELECT *, uu*ww-uw*uw AS den, greatest(0e0, least(1e0, d1/uu)) AS tab, greatest(0e0, least(1e0, d2_/ww)) AS tac,
 greatest(0e0, least(1e0, (d2_-d1-uw+uu)/(uu-2e0*uw+ww))) AS tbc FROM {out}1),
{out}3 AS (SELECT *, (ww*d1-uw*d2_)/den AS fs, (uu*d2_-uw*d1)/den AS ft FROM {out}2),
{out}4 AS (SELECT *, (fs >= 0 AND ft >= 0 AND fs+ft <= 1) AS inside, {at("tab", "0e0")} AS e1, {at("0e0", "tac")} AS e2, {at("(1e0-tbc)", "tbc")} AS e3 FROM {out}3),
{out}5 AS (SELECT *, CASE WHEN inside THEN fs WHEN e1 <= e2 AND e1 <= e3 THEN tab WHEN e2 <= e3 THEN 0e0 ELSE 1e0-tbc END AS s,
 CASE WHEN inside THEN ft WHEN e1 <= e2 AND e1 <= e3 THEN 0e0 WHEN e2 <= e3 THEN tac ELSE tbc END AS tt FROM {out}4),
{out} AS (SELECT {k}, ax+s*ux+tt*wx AS cpx, ay+s*uy+tt*wy AS cpy, az+s*uz+tt*wz AS cpz, {at("s", "tt")} AS dist FROM {out}5)"""


_raw = (1.0, 0.3713906763541037, 0.52999894000318)
_len = sum(c * c for c in _raw) ** 0.5
RAY = [f"{c / _len:.17e}" for c in _raw]


def ray_hits(src, keep, out):
    """CTE text: does the fixed ray from x y z hit the triangle?"""
    k = ", ".join(keep)
    u, w = sub(vec("e"), vec("a")), sub(vec("c"), vec("a"))
    return f"""{out}0 AS (SELECT *, {cols(u, "u")}, {cols(w, "w")}, {cols(sub(vec(""), vec("a")), "s")} FROM {src}),
{out}1 AS (SELECT *, {cols(cross(RAY, vec("w")), "pv")}, {cols(cross(vec("s"), vec("u")), "qv")} FROM {out}0),
{out}2 AS (SELECT *, {dot(vec("u"), vec("pv"))} AS det FROM {out}1),
{out}3 AS (SELECT *, {dot(vec("s"), vec("pv"))}/det AS bu, {dot(RAY, vec("qv"))}/det AS bv, {dot(vec("w"), vec("qv"))}/det AS bt FROM {out}2),
{out} AS (SELECT {k}, (abs(det) >= 1e-12 AND bu >= -1e-12 AND bu <= 1+1e-12 AND bv >= -1e-12 AND bu+bv <= 1+1e-12 AND bt > 1e-12) AS hit FROM {out}3)"""


def signed(points, out):
    """CTE text: signed distance of ``points(mesh_id, pid, x, y, z)`` to the triangles of their mesh."""
    return f"""{out}_pair AS (SELECT p.mesh_id, p.pid, x, y, z, t.* EXCLUDE (mesh_id) FROM {points} p JOIN trin t ON p.mesh_id = t.mesh_id),
{closest(out + "_pair", ["mesh_id", "pid", "tri_id", "x", "y", "z", "nx AS fnx", "ny AS fny", "nz AS fnz"], out + "_c")},
{ray_hits(out + "_pair", ["mesh_id", "pid"], out + "_h")},
{out}_near AS (SELECT mesh_id, pid, arg_min(struct_pack(tri_id := tri_id, x := x, y := y, z := z, cx := cpx, cy := cpy, cz := cpz, nx := fnx, ny := fny, nz := fnz, d := dist), dist) AS b FROM {out}_c GROUP BY mesh_id, pid),
{out}_hits AS (SELECT mesh_id, pid, count(*) FILTER (WHERE hit) AS hits FROM {out}_h GROUP BY mesh_id, pid),
{out}_s AS (SELECT n.mesh_id, n.pid, b, hits, CASE WHEN hits > 0 THEN CASE WHEN hits % 2 = 1 THEN -1e0 ELSE 1e0 END
 WHEN (b.x-b.cx)*b.nx+(b.y-b.cy)*b.ny+(b.z-b.cz)*b.nz < 0 THEN -1e0 ELSE 1e0 END AS sgn
 FROM {out}_near n JOIN {out}_hits h ON n.mesh_id = h.mesh_id AND n.pid = h.pid),
{out} AS (SELECT mesh_id, pid, b.tri_id AS tri_id, CAST(hits AS BIGINT) AS hits, b.d AS dist, sgn*b.d AS phi,
 {", ".join(f"CASE WHEN b.d <= 1e-12 THEN b.n{a}*sgn ELSE sgn*(b.{a}-b.c{a})/b.d END AS n{a}" for a in X)},
 b.cx AS wx, b.cy AS wy, b.cz AS wz FROM {out}_s)"""


def with_(*ctes, recursive=False):
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def materialized(sql, *names):
    """The named CTEs are computed once instead of at every reference."""
    for n in names:
        if f"{n} AS (" not in sql:
            raise ValueError(n)
        sql = re.sub(rf"(^|[\s,]){n} AS \(", rf"\1{n} AS MATERIALIZED (", sql, count=1)
    return sql


def unit(*parts):
    """A number in [0, 1) from the first 13 hex digits of an md5 over the joined parts."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 13) AS BIGINT) / 4503599627370496e0)"
