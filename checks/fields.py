"""Queries on field builds, stored voxels and the five query modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfield.functions.vec import AXES
from gapfield.operators import query as Q
from gapfield.operators.hessian import hessian
from gapfield.plans import build
from gapfield.session import grown
from gapfield.sources import points

from . import sql as S
from . import tables as T
from .registry import query, rounded

X = S.X
HESS = ["hxx", "hxy", "hxz", "hyy", "hyz", "hzz"]
VALS = ["gap", "nx", "ny", "nz", "wx", "wy", "wz"]
BASE = (S.SPHERES, S.SPTS, S.LOC)
IN_VOX = " AND ".join(f"i{a} >= 0 AND i{a} < 8" for a in X)
IN_CELL = " AND ".join(f"c{a} >= 0 AND c{a} < 7" for a in X)


def _results(src, valid, extra=""):
    """Final select: values only where valid, rounded."""
    vals = ", ".join(f"CASE WHEN {valid} THEN round({v}, 6) + 0.0 END AS {v}" for v in VALS)
    return f"SELECT field_id, qid, {valid} AS valid, {vals}{extra} FROM {src}"


def _finish(gap, n):
    return f"{gap} AS gap, {S.cols(n, 'n')}"


WITNESS = ", ".join(f"{a} - gap*n{a} AS w{a}" for a in X)
_m = ["(i{a}+5e-1)*25e-2-1e0".format(a=a) for a in X]
TAYLOR = f"""ty0 AS (SELECT p.*, v.phi, v.nx AS ux, v.ny AS uy, v.nz AS uz, v.l, ({IN_VOX}) AND v.phi IS NOT NULL AS ok, {", ".join(f"{a} - ({m}) AS d{a}" for a, m in zip(X, _m))}
 FROM loc p LEFT JOIN vox v ON p.field_id = v.field_id AND ix = v.i AND iy = v.j AND iz = v.k)"""
FIRST = f"""fo0 AS (SELECT field_id, qid, ok, x, y, z, phi + ux*dx+uy*dy+uz*dz AS gap, ux AS nx, uy AS ny, uz AS nz FROM ty0),
fo AS (SELECT *, {WITNESS} FROM fo0)"""
# H = (I - n n')/l on a sphere
SECOND = f"""se0 AS (SELECT *, ux*dx+uy*dy+uz*dz AS nd FROM ty0),
se1 AS (SELECT *, {", ".join(f"(d{a} - u{a}*nd)/l AS h{a}" for a in X)} FROM se0),
se2 AS (SELECT *, phi + nd + 5e-1*(dx*hx+dy*hy+dz*hz) AS gap, sqrt((ux+hx)*(ux+hx)+(uy+hy)*(uy+hy)+(uz+hz)*(uz+hz)) AS rl FROM se1),
se3 AS (SELECT field_id, qid, ok, x, y, z, gap, {", ".join(f"(u{a}+h{a})/rl AS n{a}" for a in X)} FROM se2),
se AS (SELECT *, {WITNESS} FROM se3)"""
_lin = {a: (f"CASE WHEN {b}=1 THEN t{a} ELSE 1-t{a} END", f"CASE WHEN {b}=1 THEN 4e0 ELSE -4e0 END") for a, b in zip(X, "pqr")}


def _herm(a, b):
    t = f"t{a}"
    return (
        f"CASE WHEN {b}=1 THEN {t}*{t}*(3-2*{t}) ELSE {t}*{t}*(2*{t}-3)+1 END",
        f"(CASE WHEN {b}=1 THEN {t}*{t}*({t}-1) ELSE {t}*({t}*({t}-2)+1) END)*25e-2",
        f"(CASE WHEN {b}=1 THEN 6*{t}*(1-{t}) ELSE 6*{t}*({t}-1) END)*4e0",
        f"CASE WHEN {b}=1 THEN {t}*(3*{t}-2) ELSE {t}*(3*{t}-4)+1 END",
    )


_hb = ", ".join(f"{e} AS {n}{a}" for a, b in zip(X, "pqr") for n, e in zip(("v", "s", "dv", "ds"), _herm(a, b)))
_lb = ", ".join(f"{e} AS {n}{a}" for a in X for n, e in zip(("v", "dv"), _lin[a]))
CORNERS = f"""corner AS (SELECT l.*, p, q, r FROM loc l, range(2) a(p), range(2) b(q), range(2) c(r) WHERE {IN_CELL})"""
VOXREF = "JOIN vox v ON c.field_id = v.field_id AND cx+p = v.i AND cy+q = v.j AND cz+r = v.k"


def _terms(cubic):
    names = []
    for axis in (None, "x", "y", "z"):
        val = [f"dv{a}" if a == axis else f"v{a}" for a in X]
        if not cubic:
            names.append(f"sum({val[0]}*{val[1]}*{val[2]}*phi)")
            continue
        slope = [f"ds{a}" if a == axis else f"s{a}" for a in X]
        t = [f"{val[0]}*{val[1]}*{val[2]}*phi", f"{slope[0]}*{val[1]}*{val[2]}*ux", f"{val[0]}*{slope[1]}*{val[2]}*uy", f"{val[0]}*{val[1]}*{slope[2]}*uz"]
        names.append("sum(" + " + ".join(t) + ")")
    return ", ".join(f"{e} AS {n}" for e, n in zip(names, ("gap", "gx", "gy", "gz")))


def _cell(cubic, out):
    return f"""{out}0 AS (SELECT c.*, phi, v.nx AS ux, v.ny AS uy, v.nz AS uz, {_hb if cubic else _lb} FROM corner c {VOXREF}),
{out}1 AS (SELECT field_id, qid, x, y, z, {_terms(cubic)} FROM {out}0 GROUP BY field_id, qid, x, y, z HAVING count(*) = 8),
{out}2 AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) AS gl FROM {out}1),
{out}3 AS (SELECT p.field_id, p.qid, p.x, p.y, p.z, g.gap, gx, gy, gz, g.gap IS NOT NULL AS ok,
 {", ".join(f"CASE WHEN gl > 1e-15 THEN g{a}/gl ELSE {d} END AS n{a}" for a, d in zip(X, ("1e0", "0e0", "0e0")))}
 FROM spts p LEFT JOIN {out}2 g ON p.field_id = g.field_id AND p.qid = g.qid AND p.x = g.x AND p.y = g.y AND p.z = g.z),
{out} AS (SELECT *, {WITNESS} FROM {out}3)"""


GRADS = ", " + ", ".join(f"CASE WHEN ok THEN round(g{a}, 6) + 0.0 END AS g{a}" for a in X)


def _run(spark, sf, mode, cells=False, extra=()):
    pts, f, v = T.sphere_points(spark, sf), T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf)
    r = Q.query(pts, f, v, mode, cells=Q.cell_table(v, mode == "tricubic")) if cells else Q.query(pts, f, v, mode)
    names = [*VALS, *extra]
    return rounded(r.select("field_id", "qid", "valid", *names), names)


@query("query_first", S.with_(*BASE, TAYLOR, FIRST) + _results("fo", "ok"))
def query_first(spark, sf):
    return _run(spark, sf, "first")


@query("query_second", S.with_(*BASE, TAYLOR, SECOND) + _results("se", "ok"))
def query_second(spark, sf):
    return _run(spark, sf, "second")


@query("query_trilinear", S.with_(*BASE, CORNERS, _cell(False, "tl")) + _results("tl", "ok", GRADS))
def query_trilinear(spark, sf):
    return _run(spark, sf, "trilinear", extra=("gx", "gy", "gz"))


@query("query_tricubic", S.with_(*BASE, CORNERS, _cell(True, "tc")) + _results("tc", "ok", GRADS))
def query_tricubic(spark, sf):
    return _run(spark, sf, "tricubic", extra=("gx", "gy", "gz"))


@query("cell_table_trilinear", S.with_(*BASE, CORNERS, _cell(False, "tl")) + _results("tl", "ok", GRADS))
def cell_table_trilinear(spark, sf):
    """The same answers through the materialized cell table: one equi-join, no aggregation."""
    return _run(spark, sf, "trilinear", cells=True, extra=("gx", "gy", "gz"))


@query("cell_table_tricubic", S.with_(*BASE, CORNERS, _cell(True, "tc")) + _results("tc", "ok", GRADS))
def cell_table_tricubic(spark, sf):
    return _run(spark, sf, "tricubic", cells=True, extra=("gx", "gy", "gz"))


def _asked(spark, sf, mode, cells=False):
    pts, f, v = T.repeated_points(spark, sf), T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf)
    r = Q.query(pts, f, v, mode, cells=Q.cell_table(v, mode == "tricubic") if cells else None)
    return rounded(r.select("field_id", F.col("asked").alias("qid"), "valid", *VALS), VALS)


@query("repeated_trilinear", S.with_(S.SPHERES, S.RPTS, S.LOC, CORNERS, _cell(False, "tl")) + _results("tl", "ok"))
def repeated_trilinear(spark, sf):
    """Every point is one of many under its id; each keeps its own answer."""
    return _asked(spark, sf, "trilinear")


@query("repeated_tricubic", S.with_(S.SPHERES, S.RPTS, S.LOC, CORNERS, _cell(True, "tc")) + _results("tc", "ok"))
def repeated_tricubic(spark, sf):
    return _asked(spark, sf, "tricubic")


@query("repeated_tricubic_cells", S.with_(S.SPHERES, S.RPTS, S.LOC, CORNERS, _cell(True, "tc")) + _results("tc", "ok"))
def repeated_tricubic_cells(spark, sf):
    return _asked(spark, sf, "tricubic", cells=True)


_cand = f"""cand AS (SELECT field_id, i, j, k, r, phi - r*5e-2 AS phi, nx + r*1e-1*ny AS nx, ny + r*1e-1*nz AS ny, nz + r*1e-1*nx AS nz
 FROM vox, range(3) g(r) WHERE stride > 0 AND (i+j+k) % 3 <> 0),
cq0 AS (SELECT p.field_id, p.qid, x, y, z, r, phi, c.nx/sqrt(c.nx*c.nx+c.ny*c.ny+c.nz*c.nz) AS nx, c.ny/sqrt(c.nx*c.nx+c.ny*c.ny+c.nz*c.nz) AS ny,
 c.nz/sqrt(c.nx*c.nx+c.ny*c.ny+c.nz*c.nz) AS nz, {", ".join(f"{a} - ({m}) AS d{a}" for a, m in zip(X, _m))}
 FROM loc p JOIN cand c ON p.field_id = c.field_id AND ix = c.i AND iy = c.j AND iz = c.k),
cq1 AS (SELECT *, phi + nx*dx + ny*dy + nz*dz AS gap FROM cq0),
cq2 AS (SELECT *, row_number() OVER (PARTITION BY field_id, qid ORDER BY abs(gap), r) AS rn, count(*) OVER (PARTITION BY field_id, qid) AS n FROM cq1),
cq AS (SELECT field_id, qid, n, TRUE AS ok, gap, nx, ny, nz, {WITNESS} FROM cq2 WHERE rn = 1),
al AS (SELECT field_id, qid, ok, gap, nx, ny, nz, wx, wy, wz, n FROM cq
 UNION ALL SELECT field_id, qid, ok, gap, nx, ny, nz, wx, wy, wz, CASE WHEN ok THEN 1 ELSE 0 END FROM fo o WHERE field_id NOT IN (SELECT field_id FROM fields WHERE stride = 0) AND NOT EXISTS (SELECT 1 FROM cq WHERE cq.field_id = o.field_id AND cq.qid = o.qid)
 UNION ALL SELECT field_id, qid, ok, gap, nx, ny, nz, wx, wy, wz, CASE WHEN ok THEN 1 ELSE 0 END FROM tc WHERE field_id IN (SELECT field_id FROM fields WHERE stride = 0))"""


@query("query_candidates", S.materialized(S.with_(*BASE, TAYLOR, FIRST, CORNERS, _cell(True, "tc"), _cand), "vox", "loc", "fo", "tc", "cq") + _results("al", "ok", ", CAST(n AS INTEGER) AS n_candidates"))
def query_candidates(spark, sf):
    """Several candidates per voxel, with both fallbacks."""
    r = Q.query(
        T.sphere_points(spark, sf), T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf, hess=False), "candidates",
        candidates=T.sphere_candidates(spark, sf),
    )
    r = Q.with_candidates(r)
    n = F.coalesce(F.when(F.col("valid"), F.size("candidates")), F.lit(0)).alias("n_candidates")
    return rounded(r.select("field_id", "qid", "valid", *VALS, n), VALS)


_near = {a: f"coalesce(lead(n{{c}}) OVER {a}w, n{{c}}) - coalesce(lag(n{{c}}) OVER {a}w, n{{c}})" for a in X}
_wins = "WINDOW xw AS (PARTITION BY field_id, j, k ORDER BY i), yw AS (PARTITION BY field_id, i, k ORDER BY j), zw AS (PARTITION BY field_id, i, j ORDER BY k)"
_slopes = ", ".join(f"({_near[a].format(c=c)})/5e-1 AS d{c}{a}" for a in X for c in X)


@query("voxel_hessian", S.with_(S.SPHERES, f"s AS (SELECT field_id, i, j, k, {_slopes} FROM vox {_wins})") + "SELECT field_id, i, j, k, " + ", ".join(S.r6(f"(d{p}{q}+d{q}{p})*5e-1", f"h{p}{q}") for n, p in enumerate(X) for q in X[n:]) + " FROM s")
def voxel_hessian(spark, sf):
    d = hessian(T.sphere_voxels(spark, sf, hess=False), T.sphere_fields(spark, sf))
    return rounded(d.select("field_id", "i", "j", "k", *HESS), HESS)


_modes = "m AS (SELECT 'first' AS mode, field_id, qid, ok, gap FROM fo UNION ALL SELECT 'second', field_id, qid, ok, gap FROM se UNION ALL SELECT 'trilinear', field_id, qid, ok, gap FROM tl UNION ALL SELECT 'tricubic', field_id, qid, ok, gap FROM tc)"
_msum = f"count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid, {S.r6('avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END)', 'valid_rate')}, {S.r6('avg(CASE WHEN ok THEN abs(gap) END)', 'mean_abs_gap')}"
_every = (*BASE, TAYLOR, FIRST, SECOND, CORNERS, _cell(False, "tl"), _cell(True, "tc"), _modes)


def _all_modes(spark, sf):
    pts, f, v = T.sphere_points(spark, sf), T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf)
    return Q.query_modes(pts, f, v)


@query("mode_summary", S.with_(*_every) + f"SELECT mode, {_msum} FROM m GROUP BY mode")
def mode_summary(spark, sf):
    return rounded(Q.mode_summary(_all_modes(spark, sf), ["mode"]), ["valid_rate", "mean_abs_gap"])


@query("mode_summary_totals", S.with_(*_every) + f"SELECT coalesce(mode, 'all') AS mode, {_msum} FROM m GROUP BY GROUPING SETS ((mode), ())")
def mode_summary_totals(spark, sf):
    d = Q.mode_summary(_all_modes(spark, sf), ["mode"], totals=True)
    return rounded(d.withColumn("mode", F.coalesce("mode", F.lit("all"))), ["valid_rate", "mean_abs_gap"])


@query("first_valid_samples", S.with_(*_every) + f"SELECT mode, field_id, qid, {S.r6('gap')} FROM m WHERE ok ORDER BY field_id, qid, mode LIMIT 5")
def first_valid_samples(spark, sf):
    return rounded(Q.first_valid(_all_modes(spark, sf)).select("mode", "field_id", "qid", "gap"), ["gap"])


_band = """act AS (SELECT field_id, bi, bj, bk FROM vox GROUP BY ALL HAVING min(abs(phi)) <= 1e-1),
svox AS (SELECT v.* FROM vox v JOIN act a ON v.field_id = a.field_id AND v.bi = a.bi AND v.bj = a.bj AND v.bk = a.bk)"""


def _gap(vox, f):
    return f"SELECT p.field_id, p.qid, {f.format(c='v.phi')} + {f.format(c='v.nx')}*(x-({_m[0]})) + {f.format(c='v.ny')}*(y-({_m[1]})) + {f.format(c='v.nz')}*(z-({_m[2]})) AS gap FROM loc p JOIN {vox} v ON p.field_id = v.field_id AND ix = v.i AND iy = v.j AND iz = v.k"


@query("dense_sparse_error", S.with_(*BASE, _band, f"a AS ({_gap('vox', '{c}')})", f"b AS ({_gap('svox', 'CAST(CAST({c} AS FLOAT) AS DOUBLE)')})") + f"""SELECT count(*) AS both_valid, {S.r6('avg(abs(a.gap-b.gap))', 'mean_abs', 10)}, {S.r6('max(abs(a.gap-b.gap))', 'max_abs', 10)}
 FROM a JOIN b ON a.field_id = b.field_id AND a.qid = b.qid""")
def dense_sparse_error(spark, sf):
    """The same points in the dense field and in its float narrow band."""
    pts, f, v = T.sphere_points(spark, sf), T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf, hess=False)
    pair = Q.pair_results(Q.query(pts, f, v, "first"), Q.query(pts, f, T.narrow_band(v), "first"))
    return rounded(Q.layout_error(pair), ["mean_abs", "max_abs"], 10)


@query("sparse_trilinear", S.with_(*BASE, _band, CORNERS, f"""s0 AS (SELECT c.*, CAST(CAST(phi AS FLOAT) AS DOUBLE) AS phi, {_lb} FROM corner c {VOXREF.replace('vox v', 'svox v')})""") + f"SELECT field_id, qid, round(sum(vx*vy*vz*phi), 6) + 0.0 AS gap FROM s0 GROUP BY ALL HAVING count(*) = 8")
def sparse_trilinear(spark, sf):
    """A cell counts in a narrow band only if all eight corners are stored."""
    v = T.narrow_band(T.sphere_voxels(spark, sf, hess=False))
    r = Q.query(T.sphere_points(spark, sf), T.sphere_fields(spark, sf), v, "trilinear")
    return rounded(r.filter("valid").select("field_id", "qid", "gap"), ["gap"])


@query("block_stats", S.with_(S.SPHERES, _band) + f"SELECT field_id, count(DISTINCT bi + 2*bj + 4*bk) AS active_blocks, count(*) AS stored_voxels, 8 AS total_blocks, {S.r6('count(DISTINCT bi + 2*bj + 4*bk)/8e0', 'active_share')} FROM svox GROUP BY field_id")
def block_stats(spark, sf):
    d = Q.block_stats(T.narrow_band(T.sphere_voxels(spark, sf, hess=False)), T.sphere_fields(spark, sf))
    return rounded(d.withColumn("total_blocks", F.col("total_blocks").cast("int")), ["active_share"])


_surf = f"""sp AS (SELECT o_orderkey AS qid, field_id, {S.cols(S.scatter('o_totalprice', '2e0', '-1e0'), 'u')} FROM orders
 JOIN (SELECT l_orderkey, min(l_suppkey) AS field_id FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
sq AS (SELECT sp.*, sqrt(ux*ux+uy*uy+uz*uz) AS ul, radius, cx, cy, cz FROM sp JOIN fields f ON sp.field_id = f.field_id),
spts AS (SELECT field_id, qid, ux/ul AS tnx, uy/ul AS tny, uz/ul AS tnz, cx+radius*ux/ul AS x, cy+radius*uy/ul AS y, cz+radius*uz/ul AS z FROM sq)"""
_acc = f"""acc AS (SELECT l.field_id, CASE WHEN p.tnz < -8e-1 THEN 'bottom' WHEN p.tnz > 8e-1 THEN 'top' ELSE 'wall' END AS face, gap,
 l.nx*p.tnx+l.ny*p.tny+l.nz*p.tnz AS dn, sqrt(gx*gx+gy*gy+gz*gz) AS gl FROM tl l JOIN spts p ON l.field_id = p.field_id AND l.qid = p.qid WHERE ok)"""
ACC = ["gap_rms", "gap_max", "align_mean", "align_std", "grad_mean", "grad_std"]


@query("surface_accuracy", S.with_(S.SPHERES, _surf, S.LOC, CORNERS, _cell(False, "tl"), _acc) + f"""SELECT field_id, coalesce(face, 'all') AS face, count(*) AS n, {S.r6('sqrt(avg(gap*gap))', 'gap_rms')}, {S.r6('max(abs(gap))', 'gap_max')},
 {S.r6('avg(dn)', 'align_mean')}, {S.r6('stddev_pop(dn)', 'align_std')}, {S.r6('avg(gl)', 'grad_mean')}, {S.r6('stddev_pop(gl)', 'grad_std')}
 FROM acc GROUP BY ROLLUP (field_id, face) HAVING field_id IS NOT NULL""")
def surface_accuracy(spark, sf):
    """Points on the spheres, asked of their own field, per face class and in total."""
    f = T.sphere_fields(spark, sf)
    low = T.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("field_id"))
    o = T.load(spark, sf, "orders").join(grown(low), "o_orderkey")
    p = o.select("field_id", F.col("o_orderkey").alias("qid"), *[c.alias(f"u{a}") for a, c in T.scatter("o_totalprice", 2.0, -1.0).items()])
    p = p.withColumn("_l", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz")))
    p = p.join(f.select("field_id", "radius", "cx", "cy", "cz"), "field_id").select(
        "field_id", "qid", *[(F.col(f"u{a}") / F.col("_l")).alias(f"tn{a}") for a in AXES],
        *[(F.col(f"c{a}") + F.col("radius") * F.col(f"u{a}") / F.col("_l")).alias(a) for a in AXES],
    )
    r = Q.query(p.select("field_id", "qid", *AXES), f, T.sphere_voxels(spark, sf, hess=False), "trilinear")
    d = Q.surface_accuracy(r, p, tol=0.2)
    return rounded(d.withColumn("face", F.coalesce("face", F.lit("all"))), ACC)


# ---- builds over the embedding meshes -------------------------------------------------------

P = build.BuildParams(padding=0.1, target=6, max_res=8, levels=1, block_dim=4, band=0.02, halo=0, tile=4)
_grid = f"""b AS (SELECT mesh_id, {", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in X)} FROM vert GROUP BY mesh_id),
p0 AS (SELECT *, 1e-1*{S.norm(S.sub(S.vec("hi"), S.vec("lo")))} AS pad FROM b),
p1 AS (SELECT *, {", ".join(f"lo{a}-pad AS bmin{a}, hi{a}-lo{a}+2e0*pad AS l{a}" for a in X)} FROM p0),
g AS (SELECT *, greatest(lx, ly, lz)/6 AS h FROM p1),
vx AS (SELECT mesh_id, i + 8*(j + 8*k) AS pid, i, j, k, h, bminx+(i+5e-1)*h AS x, bminy+(j+5e-1)*h AS y, bminz+(k+5e-1)*h AS z, bminx, bminy, bminz
 FROM g, range(8) a(i), range(8) bb(j), range(8) c(k))"""
FIELD = (S.TRI, S.VERT, S.TRIN, _grid)
_vnames = ["phi", "nx", "ny", "nz", "wx", "wy", "wz"]


def _specs(spark, sf, layout="dense", p=P):
    return build.field_specs(T.vertices_faces(spark, sf)[0], p, layout)


@query("build_dense", S.with_(*FIELD, S.signed("vx", "sd")) + f"SELECT v.mesh_id AS field_id, v.i, v.j, v.k, {S.r6s(_vnames)} FROM vx v JOIN sd ON v.mesh_id = sd.mesh_id AND v.pid = sd.pid")
def build_dense(spark, sf):
    """Dense signed distance fields of all ten meshes in one job."""
    v = build.build_dense(T.tris(spark, sf), _specs(spark, sf), build.replace(P, store_hessian=False))
    return rounded(v.select("field_id", "i", "j", "k", *_vnames), _vnames)


_hs = ", ".join(f"({_near[a].format(c=c)})/(2e0*h) AS d{c}{a}" for a in X for c in X)


@query("build_dense_hessian", S.with_(*FIELD, S.signed("vx", "sd"), "vf AS (SELECT v.mesh_id AS field_id, v.i, v.j, v.k, h, nx, ny, nz FROM vx v JOIN sd ON v.mesh_id = sd.mesh_id AND v.pid = sd.pid)", f"s AS (SELECT field_id, i, j, k, {_hs} FROM vf {_wins})") + "SELECT field_id, i, j, k, " + ", ".join(S.r6(f"(d{p}{q}+d{q}{p})*5e-1", f"h{p}{q}") for n, p in enumerate(X) for q in X[n:]) + " FROM s")
def build_dense_hessian(spark, sf):
    v = build.build_dense(T.tris(spark, sf), _specs(spark, sf), P)
    return rounded(v.select("field_id", "i", "j", "k", *HESS), HESS)


_blk = f"""bc AS (SELECT mesh_id, bi + 2*(bj + 2*bk) AS pid, bi, bj, bk, h, bminx+h*(4*bi+2) AS x, bminy+h*(4*bj+2) AS y, bminz+h*(4*bk+2) AS z
 FROM g, range(2) a(bi), range(2) bb(bj), range(2) c(bk))"""


# block centres need the distance alone, without signs
@query("build_sparse", S.materialized(S.with_(*FIELD, _blk, "bt AS (SELECT bc.*, t.* EXCLUDE (mesh_id) FROM bc JOIN trin t ON bc.mesh_id = t.mesh_id)", S.closest("bt", ["mesh_id", "bi", "bj", "bk", "h"], "bd"), "act AS (SELECT mesh_id, bi, bj, bk FROM bd GROUP BY mesh_id, bi, bj, bk, h HAVING min(dist) <= 2e-2 + 5e-1*sqrt(3e0)*4*h)", "av AS (SELECT v.* FROM vx v JOIN act a ON v.mesh_id = a.mesh_id AND v.i//4 = a.bi AND v.j//4 = a.bj AND v.k//4 = a.bk)", S.signed("av", "sd")), "trin", "vx", "act", "av", "sd_pair") + f"SELECT v.mesh_id AS field_id, v.i, v.j, v.k, {S.r6('CAST(CAST(phi AS FLOAT) AS DOUBLE)', 'phi', 5)}, {S.r6('CAST(CAST(nx AS FLOAT) AS DOUBLE)', 'nx', 5)} FROM av v JOIN sd ON v.mesh_id = sd.mesh_id AND v.pid = sd.pid")
def build_sparse(spark, sf):
    """Narrow-band fields: block centres first, then only the voxels of blocks near the surface."""
    v = build.build_sparse(T.tris(spark, sf), _specs(spark, sf, "sparse"), build.replace(P, store_hessian=False))
    return rounded(v.select("field_id", "i", "j", "k", "phi", "nx"), ["phi", "nx"], 5)


@query("sweep_dimensions", S.with_(S.TRI, "r AS (SELECT mesh_id, unnest([8, 20, 50, 600]) AS res FROM (SELECT DISTINCT mesh_id FROM tri))", S.VERT, f"""b AS (SELECT mesh_id, {", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in X)} FROM vert GROUP BY mesh_id),
p0 AS (SELECT b.*, res, 1e-1*{S.norm(S.sub(S.vec("hi"), S.vec("lo")))} AS pad FROM b JOIN r ON b.mesh_id = r.mesh_id),
p1 AS (SELECT *, {", ".join(f"hi{a}-lo{a}+2e0*pad AS l{a}" for a in X)} FROM p0), g AS (SELECT *, greatest(lx, ly, lz)/res AS h FROM p1),
d AS (SELECT mesh_id, {", ".join("least(500, CASE " + " ".join(f"WHEN ceil(l{a}/h) <= {s} THEN {s}" for s in (8, 16, 32, 64, 128, 256, 512, 1024)) + f" ELSE 2048 END) AS d{a}" for a in X)} FROM g)""") + """SELECT mesh_id, count(*) AS n_fields,
 bool_and(dx IN (8,16,32,64,128,256,512,1024,2048) AND dy IN (8,16,32,64,128,256,512,1024,2048) AND dz IN (8,16,32,64,128,256,512,1024,2048)) AS on_ladder, CAST(sum(CAST(dx AS BIGINT)*dy*dz) AS BIGINT) AS voxels FROM d GROUP BY mesh_id""")
def sweep_dimensions(spark, sf):
    """Every mesh at every resolution: a cap off the ladder shows up as off the ladder."""
    f = build.field_specs(T.vertices_faces(spark, sf)[0], build.BuildParams(max_res=500), resolutions=[8, 20, 50, 600])
    return build.dimension_check(f)


@query("lattice_points", S.with_(S.SPHERES) + f"""SELECT field_id, CAST(q AS BIGINT) AS qid, {S.r6('((q//25)*5e-1-1e0)*6e-1', 'x')}, {S.r6('(((q//5)%5)*5e-1-1e0)*6e-1', 'y')}, {S.r6('((q%5)*5e-1-1e0)*6e-1', 'z')} FROM fields, range(125) r(q)""")
def lattice_points(spark, sf):
    return rounded(points.lattice_points(T.sphere_fields(spark, sf)), ["x", "y", "z"])


@query("random_points", S.with_(S.SPHERES) + "SELECT field_id, CAST(q AS BIGINT) AS qid, " + ", ".join(S.r6(f"25e-2*(5e-2 + 69e-1*{S.unit('field_id', 'q', n, 7)} + 5e-1) - 1e0", a) for n, a in enumerate(X)) + " FROM fields, range(200) r(q)")
def random_points(spark, sf):
    return rounded(points.random_points(T.sphere_fields(spark, sf), 200, 7), ["x", "y", "z"])


_bp = """ab AS (SELECT field_id, bi, bj, bk, row_number() OVER (PARTITION BY field_id ORDER BY bk, bj, bi) - 1 AS pos, count(*) OVER (PARTITION BY field_id) AS m FROM act),
bq AS (SELECT field_id, bi, bj, bk, CAST(q AS BIGINT) AS qid FROM ab, range(100) r(q) WHERE q % m = pos)"""


@query("block_points", S.with_(S.SPHERES, _band, _bp) + "SELECT field_id, qid, " + ", ".join(S.r6(f"25e-2*(4*{b} + 4*{S.unit('field_id', 'qid', n, 0)}) - 1e0", a) for n, (a, b) in enumerate(zip(X, ("bi", "bj", "bk")))) + " FROM bq")
def block_points(spark, sf):
    v = T.narrow_band(T.sphere_voxels(spark, sf, hess=False))
    return rounded(points.block_points(v, T.sphere_fields(spark, sf), 100), ["x", "y", "z"])


@query("voxels_in_blocks", S.with_(S.SPHERES, _band) + f"SELECT v.field_id, i, j, k, {S.r6('phi')} FROM vox v JOIN act a ON v.field_id = a.field_id AND v.bi = a.bi AND v.bj = a.bj AND v.bk = a.bk")
def voxels_in_blocks(spark, sf):
    """The voxels of all active blocks."""
    v = T.sphere_voxels(spark, sf, hess=False)
    blocks = T.narrow_band(v).select("field_id", "bi", "bj", "bk").distinct()
    return rounded(Q.in_blocks(v, blocks).select("field_id", "i", "j", "k", "phi"), ["phi"])


@query("dropped_candidates", S.with_(S.SPHERES) + "SELECT field_id, i, j, k, 1 AS dropped FROM vox WHERE stride > 0 AND (i+j+k) % 3 <> 0")
def dropped_candidates(spark, sf):
    """Voxels with more candidates than two, as a defect table."""
    d = Q.dropped_candidates(T.sphere_candidates(spark, sf), most=2)
    return d.withColumn("dropped", F.col("dropped").cast("int"))
