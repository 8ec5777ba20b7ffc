"""Queries that are SQL text over the registered functions, and their plain SQL twins."""

from __future__ import annotations

from gapfield.functions import sql as functions

from . import sql as S
from . import tables as T
from .registry import query

X = S.X


def _run(spark, text: str, **views):
    functions.register(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


_SPEC = "named_struct('bmin', gf_vec(-0.5D, -0.5D, -0.5D), 'vox', gf_vec(0.04D, 0.04D, 0.04D), 'dims', named_struct('i', 24L, 'j', 20L, 'k', 16L))"


@query("sql_grid_index", S.with_(S.PTS, "u AS (SELECT qid, " + ", ".join(f"CAST(round(({a}+5e-1)/4e-2-5e-1) AS BIGINT) AS {i}" for a, i in zip(X, "ijk")) + " FROM pts)")
    + f"SELECT qid, i, j, k, i + 24*(j + 20*k) AS lin, (i//8) + (j//8)*2097152 + (k//8)*4398046511104 AS block_key, {S.r6('(i+5e-1)*4e-2-5e-1', 'x')} FROM u WHERE i >= 0 AND i < 24 AND j >= 0 AND j < 20 AND k >= 0 AND k < 16")
def sql_grid_index(spark, sf):
    """Voxel, linear index, block and centre of every point inside a grid, and back from the index."""
    return _run(spark, f"""WITH g AS (SELECT qid, {_SPEC} AS grid, gf_vec(x, y, z) AS p FROM gf_check_points),
        v AS (SELECT qid, grid, gf_grid_nearest(grid, p) AS at FROM g),
        n AS (SELECT qid, grid, gf_grid_lin(grid, at) AS lin, gf_block_key(at, 8L) AS block_key FROM v WHERE gf_grid_inside(grid, at, 0L)),
        b AS (SELECT *, gf_grid_from_lin(grid, lin) AS at FROM n)
        SELECT qid, at.i, at.j, at.k, lin, block_key, round(gf_grid_center(grid, at).x, 6) + 0D AS x FROM b""", gf_check_points=T.mesh_points(spark, sf))


_pair = "pair AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN orders o ON p.qid = o.o_orderkey JOIN tri t ON t.tri_id = o.o_custkey % (SELECT count(*) FROM tri))"


@query("sql_closest_point", S.with_(S.PTS, S.TRI, _pair, S.closest("pair", ["qid", "tri_id"], "c")) + f"SELECT qid, tri_id, {S.r6('cpx', 'cx')}, {S.r6('cpy', 'cy')}, {S.r6('cpz', 'cz')}, {S.r6('dist')} FROM c")
def sql_closest_point(spark, sf):
    """Closest point of a triangle per order."""
    return _run(spark, """WITH pair AS (SELECT qid, tri_id, gf_vec(x, y, z) AS p, gf_vec(ax, ay, az) AS a, gf_vec(bx, by, bz) AS b, gf_vec(cx, cy, cz) AS c
          FROM gf_check_points JOIN gf_check_orders ON qid = o_orderkey JOIN gf_check_triangles ON tri_id = o_custkey % (SELECT count(*) FROM gf_check_triangles)),
        c AS (SELECT qid, tri_id, p, gf_closest_point(p, a, b, c) AS q FROM pair)
        SELECT qid, tri_id, round(q.x, 6) + 0D AS cx, round(q.y, 6) + 0D AS cy, round(q.z, 6) + 0D AS cz, round(gf_norm(gf_minus(p, q)), 6) + 0D AS dist FROM c""",
        gf_check_points=T.mesh_points(spark, sf).drop("mesh_id"), gf_check_orders=T.load(spark, sf, "orders"), gf_check_triangles=T.tris(spark, sf))


_laws = f"""w AS (SELECT run_id, cp_id, gap, k*greatest(eps - gap, 0) AS lin, CASE WHEN gap < 0 THEN k*pow(-gap, ord) ELSE 0 END AS pw,
 CASE WHEN gap < 0 AND damping > 0 THEN -vax*damping ELSE 0 END AS d, gx, mu, sqrt(vax*vax+vay*vay+vaz*vaz + reg*reg) AS den, vax, vay, vaz FROM crows WHERE valid)"""


@query("sql_contact_laws", S.with_(S.CROWS, _laws) + f"SELECT run_id, CAST(cp_id AS BIGINT) AS cp_id, count(*) AS n, {S.r6('sum(lin)', 'linear', 4)}, {S.r6('sum(pw)', 'power', 4)}, {S.r6('sum(d*gx)', 'damping', 4)}, {S.r6('sum(-mu*pw*vaz/den)', 'friction', 4)} FROM w GROUP BY ALL")
def sql_contact_laws(spark, sf):
    """Both pressure laws, damping and friction summed per run and contact."""
    return _run(spark, """WITH r AS (SELECT *, gf_pressure_pow(gap, k, `order`) AS p FROM gf_check_contacts WHERE valid)
        SELECT run_id, CAST(cp_id AS BIGINT) AS cp_id, count(*) AS n, round(sum(gf_pressure(gap, k, eps)), 4) + 0D AS linear, round(sum(p), 4) + 0D AS power,
          round(sum(gf_damping(gap, damping, vax, gf_vec(gx, gy, gz)).x), 4) + 0D AS damping, round(sum(gf_friction(gf_vec(vax, vay, vaz), p, mu, reg).z), 4) + 0D AS friction
        FROM r GROUP BY run_id, cp_id""", gf_check_contacts=T.contact_rows(spark, sf))


@query("sql_voxels", S.with_(S.SPHERES) + f"SELECT field_id, i, j, k, {S.r6('(i+5e-1)*25e-2-1e0', 'x')}, {S.r6('(k+5e-1)*25e-2-1e0', 'z')} FROM vox")
def sql_voxels(spark, sf):
    """All voxels of all fields by the table function."""
    return _run(spark, """WITH f AS (SELECT field_id, named_struct('bmin', gf_vec(bminx, bminy, bminz), 'vox', gf_vec(voxx, voxy, voxz), 'dims', named_struct('i', CAST(dimx AS BIGINT), 'j', CAST(dimy AS BIGINT), 'k', CAST(dimz AS BIGINT))) AS grid FROM gf_check_fields)
        SELECT field_id, v.i, v.j, v.k, round(v.x, 6) + 0D AS x, round(v.z, 6) + 0D AS z FROM f, LATERAL gf_voxels(f.grid) v""",
        gf_check_fields=T.sphere_fields(spark, sf))
