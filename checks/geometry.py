"""Queries on meshes, nearest triangles and box joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfield.functions import grid
from gapfield.functions.triangle import RAY_DIR, branch_id, closest_point, edge_dots
from gapfield.functions.vec import AXES, V3, unit
from gapfield.operators import bins, candidates, mesh, nearest
from gapfield.session import spread
from gapfield.sources import model_text, obj

from . import sql as S
from . import tables as T
from .registry import query, rounded

X = S.X
ATTR = [f"{p}{a}" for p in ("n", "g", "bmin", "bmax") for a in X] + ["area"]
_tri_sql = ", ".join(
    [S.r6(f"n{a}", f"n{a}") for a in X]
    + [S.r6(f"(a{a}+e{a}+c{a})/3e0", f"g{a}") for a in X]
    + [S.r6(f"least(a{a}, e{a}, c{a})", f"bmin{a}") for a in X]
    + [S.r6(f"greatest(a{a}, e{a}, c{a})", f"bmax{a}") for a in X]
    + [S.r6("fl*5e-1", "area")]
)


@query("tri_attributes", S.with_(S.TRI, S.TRIN) + f"SELECT mesh_id, tri_id, {_tri_sql} FROM trin")
def tri_attributes(spark, sf):
    return rounded(mesh.triangles(*T.vertices_faces(spark, sf)).select("mesh_id", "tri_id", *ATTR), ATTR)


@query("surface_points", S.with_(S.TRI, S.TRIN) + f"""SELECT mesh_id, tri_id AS qid, {", ".join(S.r6(f"(a{a}+e{a}+c{a})/3e0 + {o}", a) for a, o in zip(X, ("1e0", "2e0", "3e0")))},
 {S.r6("fl*5e-1", "w")}, CASE WHEN nz < -99e-2 THEN 'bottom' WHEN nz > 99e-2 THEN 'top' ELSE 'wall' END AS face FROM trin""")
def surface_points(spark, sf):
    d = mesh.surface_points(T.tris(spark, sf), V3(1.0, 2.0, 3.0))
    return rounded(d.select("mesh_id", "qid", "x", "y", "z", "w", mesh.face_class(F.col("tnz")).alias("face")), ["x", "y", "z", "w"])


_ladder = "CASE " + " ".join(f"WHEN n <= {s} THEN {s}" for s in (8, 16, 32, 64, 128, 256, 512)) + " ELSE 512 END"
_dims = ", ".join(f"CAST({_ladder.replace('n <=', f'ceil(l{a}/h) <=')} AS INTEGER) AS dim{a}" for a in X)


@query("mesh_bounds_grid", S.with_(S.TRI, S.VERT, f"""b AS (SELECT mesh_id, {", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in X)} FROM vert GROUP BY mesh_id),
p AS (SELECT *, 1e-1*{S.norm(S.sub(S.vec("hi"), S.vec("lo")))} AS pad FROM b),
q AS (SELECT *, {", ".join(f"lo{a}-pad AS bmin{a}, hi{a}-lo{a}+2e0*pad AS l{a}" for a in X)} FROM p),
v AS (SELECT *, greatest(lx, ly, lz)/50 AS h FROM q), g AS (SELECT *, {_dims} FROM v)""") + f"""SELECT mesh_id, dimx, dimy, dimz, {S.r6("h", "voxx")},
 {S.r6s([f"bmin{a}" for a in X])}, {", ".join(S.r6(f"bmin{a} + dim{a}*h", f"bmax{a}") for a in X)} FROM g""")
def mesh_bounds_grid(spark, sf):
    v, _ = T.vertices_faces(spark, sf)
    names = ["voxx", *[f"{q}{a}" for q in ("bmin", "bmax") for a in X]]
    return rounded(mesh.grid_spec(v, target=50).select("mesh_id", "dimx", "dimy", "dimz", *names), names)


@query("mesh_max_edge", S.with_(S.TRI) + f"""SELECT mesh_id, {S.r6("max(e)", "max_edge")}, max(e) <= 5e-1 AS within_limit FROM
 (SELECT mesh_id, unnest([{S.norm(S.sub(S.vec("e"), S.vec("a")))}, {S.norm(S.sub(S.vec("c"), S.vec("e")))}, {S.norm(S.sub(S.vec("a"), S.vec("c")))}]) AS e FROM tri) GROUP BY mesh_id""")
def mesh_max_edge(spark, sf):
    return rounded(mesh.max_edge(T.tris(spark, sf), 0.5), ["max_edge"])


@query("coordinate_ranges", S.with_(S.TRI, S.VERT) + "SELECT mesh_id, " + ", ".join(S.r6(f"{f}({a})", f"{p}{a}") for a in X for f, p in (("min", "lo"), ("max", "hi"))) + " FROM vert GROUP BY mesh_id")
def coordinate_ranges(spark, sf):
    v, _ = T.vertices_faces(spark, sf)
    return rounded(mesh.bounds(v), [f"{p}{a}" for p in ("lo", "hi") for a in X])


_defect_tables = """v AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey % 7 AS DOUBLE) AS z FROM part
 UNION ALL SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE), 0e0 FROM supplier),
f AS (SELECT o_orderkey AS tri_id, o_custkey AS v0, o_orderkey AS v1, o_custkey // 2 AS v2 FROM orders),
c AS (SELECT tri_id, v0 AS vid FROM f UNION ALL SELECT tri_id, v1 FROM f UNION ALL SELECT tri_id, v2 FROM f),
one AS (SELECT vid, min(x) AS x, min(y) AS y, min(z) AS z FROM v GROUP BY vid)"""
_e0, _e1 = S.sub(S.vec("b."), S.vec("a.")), S.sub(S.vec("c."), S.vec("a."))


@query("mesh_defects", S.with_(_defect_tables) + f"""SELECT kind, coalesce(tri_id, -1) AS tri_id, coalesce(vid, -1) AS vid FROM (
SELECT 'bad_vertex_reference' AS kind, tri_id, vid FROM c WHERE vid NOT IN (SELECT vid FROM v)
UNION ALL SELECT 'duplicate_vertex_id', NULL, vid FROM v GROUP BY vid HAVING count(*) > 1
UNION ALL SELECT 'degenerate_triangle', tri_id, NULL FROM f JOIN one a ON v0 = a.vid JOIN one b ON v1 = b.vid JOIN one c ON v2 = c.vid
 WHERE {S.norm(S.cross(_e0, _e1))} <= 1e-15)""")
def mesh_defects(spark, sf):
    """Orders as faces over parts and suppliers as vertices: dangling, repeated and flat by nature."""
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z"))
    s = T.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    v = p.unionByName(s).withColumn("mesh_id", F.lit("all"))
    f = T.load(spark, sf, "orders").select(F.lit("all").alias("mesh_id"), F.col("o_orderkey").alias("tri_id"), F.col("o_custkey").alias("v0"), F.col("o_orderkey").alias("v1"), F.floor(F.col("o_custkey") / 2).alias("v2"))
    d = mesh.mesh_defects(v, f)
    return d.select("kind", *[F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("tri_id", "vid")])


@query("obj_roundtrip", S.with_(S.TRI) + "SELECT tri_id, " + ", ".join(S.r6(q, f'"{n}"') for q, n in zip(S.CORNERS, T.CORNERS)) + " FROM tri")
def obj_roundtrip(spark, sf):
    """Meshes to OBJ text, parsed again."""
    v, f = T.vertices_faces(spark, sf, by_label=False)
    text = obj.obj_lines(v, f)
    lines = text.select(
        F.lit("all.obj").alias("file"), (F.col("kind") * 1000000 + F.floor(F.col("id") / 500)).alias("block"),
        F.col("id").alias("pos"), F.col("value").alias("line"),
    )
    v2, f2 = obj.parse_obj(lines)
    return rounded(mesh.join_corners(f2, v2).drop("mesh_id"), T.CORNERS)


@query("entity_attrs", f"""SELECT p_partkey AS body_id, p_name AS name, {S.r6("p_retailprice", "mass")}, CAST(p_size AS DOUBLE) AS ixx, (p_size % 10 = 0) AS ground FROM part""")
def entity_attrs(spark, sf):
    """Parts written as model text, lexed, typed and read back."""
    p = spread(T.load(spark, sf, "part"), "p_partkey")
    text = F.array(
        F.concat(F.lit("PART / "), F.col("p_partkey"), F.when(F.col("p_size") % 10 == 0, ", GROUND").otherwise("")),
        F.lit("! comment"), F.concat(F.lit(", NAME = '"), F.col("p_name"), F.lit("'")),
        F.concat(F.lit(", MASS = "), F.col("p_retailprice").cast("string")),
        F.concat(F.lit(", IP = "), F.col("p_size"), F.lit(", 2, 3")), F.lit(", IP = 4, 5, 6"), F.lit(""), F.lit("stray text"),
    )
    lines = p.select(F.lit("m").alias("file"), F.floor(F.col("p_partkey") / 100).alias("block"), "p_partkey", F.posexplode(text).alias("n", "line"))
    lines = lines.select("file", "block", (F.col("p_partkey") * 16 + F.col("n")).alias("pos"), "line")
    t = model_text.entity_tables(*model_text.parse_entities(lines))["parts"]
    return rounded(t.select("body_id", "name", "mass", F.col("ip")[0].alias("ixx"), "ground"), ["mass", "ixx"])


@query("grid_index", S.with_(S.PTS, "u AS (SELECT qid, " + ", ".join(f"CAST(round(({a}+5e-1)/4e-2-5e-1) AS BIGINT) AS {i}" for a, i in zip(X, "ijk")) + " FROM pts)") + """SELECT qid, i, j, k, (i >= 0 AND i < 24 AND j >= 0 AND j < 20 AND k >= 0 AND k < 16) AS inside,
 i + 24*(j + 20*k) AS lin, (i//8) + (j//8)*2097152 + (k//8)*4398046511104 AS block_key FROM u""")
def grid_index(spark, sf):
    d = T.mesh_points(spark, sf)
    spec = {f"{q}{a}": F.lit(v) for q, v in (("bmin", -0.5), ("vox", 0.04)) for a in AXES} | {f"dim{a}": F.lit(n) for a, n in zip(AXES, (24, 20, 16))}
    d = d.withColumns(spec)
    d = d.withColumns(dict(zip("ijk", grid.nearest_index(V3.of()))))
    idx = [F.col(c) for c in "ijk"]
    return d.select("qid", *idx, grid.in_bounds(idx).alias("inside"), grid.lin(*idx).alias("lin"), grid.block_key(grid.block(idx, 8)).alias("block_key"))


_pair = "pair AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN orders o ON p.qid = o.o_orderkey JOIN tri t ON t.tri_id = o.o_custkey % (SELECT count(*) FROM tri))"


@query("closest_point", S.with_(S.PTS, S.TRI, _pair, S.closest("pair", ["qid", "tri_id"], "c")) + f"SELECT qid, tri_id, {S.r6('cpx', 'cx')}, {S.r6('cpy', 'cy')}, {S.r6('cpz', 'cz')}, {S.r6('dist')} FROM c")
def closest(spark, sf):
    many = T.load(spark, sf, "embeddings").agg(F.count("vec_id")).scalar()
    o = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % many).alias("tri_id"))
    d = T.mesh_points(spark, sf).drop("mesh_id").join(o, "qid").join(edge_dots(T.tris(spark, sf)), "tri_id")
    d = closest_point(d, V3.of())
    d = d.select("qid", "tri_id", F.col("c_x").alias("cx"), F.col("c_y").alias("cy"), F.col("c_z").alias("cz"), F.sqrt("d2").alias("dist"))
    return rounded(d, ["cx", "cy", "cz", "dist"])


def split_tris(spark, sf, n: int):
    """Every triangle cut into n * n equal ones: a fine mesh on the same surface."""
    d = T.tris(spark, sf).select("mesh_id", "tri_id", *[f"{k}{a}" for k in "abc" for a in AXES])
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2 * (n - 1)) - 2 * F.col("i"))))
    # row i of the triangle holds 2 * (n - i) - 1 small ones, every other one turned
    k, odd = F.floor(F.col("j") / 2), F.col("j") % 2 == 1
    corners = {"a": (F.when(odd, 1).otherwise(0), F.lit(0)), "b": (F.when(odd, 1).otherwise(1), F.when(odd, 1).otherwise(0)), "c": (F.lit(0), F.lit(1))}
    out = {}
    for c, (du, dv) in corners.items():
        u, v = (k + du) / float(n), (F.col("i") + dv) / float(n)
        for a in AXES:
            out[f"_{c}{a}"] = F.col(f"a{a}") + u * (F.col(f"b{a}") - F.col(f"a{a}")) + v * (F.col(f"c{a}") - F.col(f"a{a}"))
    d = d.select("mesh_id", (F.col("tri_id") * (2 * n * n) + F.col("i") * 2 * n + F.col("j")).alias("tri_id"), *[x.alias(c) for c, x in out.items()])
    return mesh.with_attributes(d.withColumnsRenamed({f"_{c}{a}": f"{c}{a}" for c in "abc" for a in AXES}))


@query("nearest_triangle_fine", S.with_(S.PTS, S.TRI, "pr AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN tri t ON p.mesh_id = t.mesh_id)", S.closest("pr", ["qid", "tri_id"], "c")) + f"SELECT qid, {S.r6('min(dist)', 'dist')} FROM c GROUP BY qid")
def nearest_fine(spark, sf):
    """The same surfaces cut 144 times finer and searched through four levels: distances must not change."""
    r = nearest.nearest_triangle(T.mesh_points(spark, sf), split_tris(spark, sf, 12), levels=4)
    return rounded(r.select("qid", F.sqrt("d2").alias("dist")), ["dist"])


_all = "pp AS (SELECT mesh_id, qid AS pid, x, y, z FROM pts)"


@query("nearest_triangle", S.with_(S.PTS, S.TRI, "pr AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN tri t ON p.mesh_id = t.mesh_id)", S.closest("pr", ["qid", "tri_id"], "c")) + f"SELECT qid, arg_min(tri_id, dist) AS tri_id, {S.r6('min(dist)', 'dist')} FROM c GROUP BY qid")
def nearest_tri(spark, sf):
    r = nearest.nearest_triangle(T.mesh_points(spark, sf), T.tris(spark, sf))
    return rounded(r.select("qid", "tri_id", F.sqrt("d2").alias("dist")), ["dist"])


@query("signed_distance", S.with_(S.PTS, S.TRI, S.TRIN, _all, S.signed("pp", "sd")) + f"SELECT pid AS qid, tri_id, hits, {S.r6s(['phi', 'nx', 'ny', 'nz', 'wx', 'wy', 'wz'])} FROM sd")
def signed_distance(spark, sf):
    r = nearest.signed_distance(T.mesh_points(spark, sf), T.tris(spark, sf))
    names = ["phi", "nx", "ny", "nz", "wx", "wy", "wz"]
    return rounded(r.select("qid", "tri_id", "hits", *names), names)


_half = S.frac("s_acctbal", "7.7e-1") + "*1e-1 + 1e-2"
_box = f"box AS (SELECT s_suppkey AS box_id, {S.cols(S.scatter('s_acctbal', '8e-1', '-4e-1'), 'c')}, {_half} AS half FROM supplier)"


def supplier_boxes(spark, sf):
    s = T.load(spark, sf, "supplier")
    half = T.frac("s_acctbal", 0.77) * 0.1 + 0.01
    return s.select(F.col("s_suppkey").alias("box_id"), *[c.alias(f"c{a}") for a, c in T.scatter("s_acctbal", 0.8, -0.4).items()], half.alias("half"))


@query("point_in_box", S.with_(S.PTS, _box) + "SELECT qid, box_id FROM pts JOIN box ON " + " AND ".join(f"{a} >= c{a}-half AND {a} <= c{a}+half" for a in X))
def point_in_box(spark, sf):
    p = T.mesh_points(spark, sf).select("qid", *AXES)
    c, h = V3.of("c"), F.col("half")
    return bins.points_in_boxes(p, supplier_boxes(spark, sf), [], list(V3.of()), [q - h for q in c], [q + h for q in c]).select("qid", "box_id")


@query("points_in_radius", S.with_(S.PTS, _box) + f"SELECT qid, box_id, {S.r6('(x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)', 'd2')} FROM pts JOIN box ON (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) <= half*half")
def points_in_radius(spark, sf):
    p = T.mesh_points(spark, sf).select("qid", *AXES)
    r = bins.points_within(p, supplier_boxes(spark, sf), [], V3.of(), V3.of("c"), F.col("half"))
    return rounded(r.select("qid", "box_id", "d2"), ["d2"])


_pbox = f"pbox AS (SELECT p_partkey AS part_id, {S.cols([S.frac('p_retailprice*(p_size+1)', m) + '*8e-1-4e-1' for m in S.FR], 'd')}, p_size*2e-3 AS hp FROM part)"


@query("box_overlap_pairs", S.with_(_box, _pbox) + "SELECT box_id, part_id FROM box JOIN pbox ON " + " AND ".join(f"c{a}-half <= d{a}+hp AND d{a}-hp <= c{a}+half" for a in X))
def box_overlap_pairs(spark, sf):
    s = F.col("p_retailprice") * (F.col("p_size") + 1)
    p = T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), *[(T.frac(s, m) * 0.8 - 0.4).alias(f"d{a}") for a, m in zip(AXES, (T.GOLD, T.ROOT2, T.ROOT3))], (F.col("p_size") * 0.002).alias("hp")
    )
    c, h, d, q = V3.of("c"), F.col("half"), V3.of("d"), F.col("hp")
    r = bins.overlapping_boxes(supplier_boxes(spark, sf), p, [], [x - h for x in c], [x + h for x in c], [x - q for x in d], [x + q for x in d])
    return r.select("box_id", "part_id")


_q = "CAST(round(greatest(-1e0, least(1e0, n{a}))*4095e0) AS BIGINT) & 4294967295"
_h1 = f"((xor(2166136261, {_q.format(a='x')})) * 16777619) & 4294967295"


@query("branch_ids", S.with_(S.TRI, S.TRIN, f"h1 AS (SELECT *, {_h1} AS h FROM trin)", f"h2 AS (SELECT * EXCLUDE (h), (xor(h, {_q.format(a='y')}) * 16777619) & 4294967295 AS h FROM h1)", f"h3 AS (SELECT * EXCLUDE (h), (xor(h, {_q.format(a='z')}) * 16777619) & 4294967295 AS h FROM h2)") + "SELECT tri_id, (h & 1073741823) + 1 AS branch_id FROM h3")
def branch_ids(spark, sf):
    return T.tris(spark, sf).select("tri_id", branch_id(V3.of("n")).alias("branch_id"))


_REACH = "25e-2"


@query("candidate_topk", S.with_(S.PTS, S.TRI, S.TRIN, "pr AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN trin t ON p.mesh_id = t.mesh_id)",
    S.closest("pr", ["qid", "tri_id", "x", "y", "z", "nx", "ny", "nz"], "c"),
    "w AS (SELECT *, min(dist) OVER (PARTITION BY qid) AS md FROM c)") + f"""SELECT qid, CAST(rank AS INTEGER) AS rank, tri_id, {S.r6s(['phi', 'dist'])} FROM (
 SELECT qid, tri_id, dist, (x-cpx)*nx+(y-cpy)*ny+(z-cpz)*nz AS phi, row_number() OVER (PARTITION BY qid ORDER BY abs((x-cpx)*nx+(y-cpy)*ny+(z-cpz)*nz), tri_id) - 1 AS rank
 FROM w WHERE md <= {_REACH} AND dist <= {_REACH} AND dist <= md + 5e-2) WHERE rank < 3""")
def candidate_topk(spark, sf):
    """Triangles within reach of a point, those near the closest kept, the best three by plane offset."""
    d = candidates.pairs_within(T.mesh_points(spark, sf), T.tris(spark, sf), F.lit(0.05), 0.25)
    d = candidates.top_candidates(d, 3, ["mesh_id", "qid"])
    return rounded(d.select("qid", "rank", "tri_id", "phi", "dist"), ["phi", "dist"])


@query("merge_surfaces", S.with_(S.TRI, "n AS (SELECT mesh_id, count(*) AS c FROM tri GROUP BY mesh_id)", "o AS (SELECT mesh_id, COALESCE(sum(c) OVER (ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n)", "r AS (SELECT t.*, row_number() OVER (PARTITION BY t.mesh_id ORDER BY tri_id) - 1 AS l FROM tri t)") + f"SELECT CAST(o + l AS BIGINT) AS tri_id, CAST(3*(o+l) AS BIGINT) AS v0, {S.r6('ax')}, {S.r6('ey', '"by"')}, {S.r6('cz')} FROM r JOIN o ON r.mesh_id = o.mesh_id")
def merge_surfaces(spark, sf):
    """Ten surfaces of one file become one mesh with global ids."""
    from gapfield.operators.ordered import running

    t = T.tris(spark, sf).select("mesh_id", "tri_id", *T.CORNERS)
    t = running(t, ["mesh_id"], ["tri_id"], F.floor(F.col("tri_id") / 100), sums={"_l": F.lit(1).cast("bigint")})
    t = t.withColumns({"file": F.lit("f"), "surface_no": F.col("mesh_id"), "tri_id": F.col("_l") - 1})
    corner = F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"{c}{a}").alias(a) for a in X]) for n, c in enumerate("abc")])
    v = t.select("file", "surface_no", "tri_id", F.explode(corner).alias("c")).select("file", "surface_no", (F.col("tri_id") * 3 + F.col("c.n")).alias("vid"), *[F.col(f"c.{a}").alias(a) for a in X])
    f = t.select("file", "surface_no", "tri_id", *[(F.col("tri_id") * 3 + n).alias(f"v{n}") for n in range(3)])
    mv, mf = mesh.merge_surfaces(v, f)
    d = mesh.join_corners(mf, mv).join(mf.select("tri_id", "v0"), "tri_id")
    return rounded(d.select("tri_id", "v0", "ax", "by", "cz"), ["ax", "by", "cz"])


@query("candidate_normals", S.with_(S.TRI, S.TRIN) + f"SELECT tri_id, {S.r6s(['nx', 'ny', 'nz'])} FROM trin")
def candidate_normals(spark, sf):
    """Unit normals with the fallback, from raw corner products."""
    t = T.tris(spark, sf).select("tri_id", *T.CORNERS)
    a, b, c = V3.of("a"), V3.of("b"), V3.of("c")
    t = t.withColumns((b - a).cross(c - a).named("f"))
    t = t.withColumn("fl", V3.of("f").norm())
    return rounded(t.select("tri_id", *unit(V3.of("f"), F.col("fl"), V3(0.0, 0.0, 1.0)).cols("n")), ["nx", "ny", "nz"])


@query("grid_inverse", S.with_(S.PTS, "u AS (SELECT qid, " + ", ".join(f"CAST(round(({a}+5e-1)/4e-2-5e-1) AS BIGINT) AS {i}" for a, i in zip(X, "ijk")) + " FROM pts)") + """SELECT qid, i, j, k, i%8 AS li, j%8 AS lj, k%8 AS lk, i%8 + 8*(j%8 + 8*(k%8)) AS local FROM u WHERE i BETWEEN 0 AND 23 AND j BETWEEN 0 AND 19 AND k BETWEEN 0 AND 15""")
def grid_inverse(spark, sf):
    """Linear indices back to voxels, and the place of a voxel in its block."""
    spec = {f"{q}{a}": F.lit(v) for q, v in (("bmin", -0.5), ("vox", 0.04)) for a in AXES} | {f"dim{a}": F.lit(n) for a, n in zip(AXES, (24, 20, 16))}
    d = T.mesh_points(spark, sf).withColumns(spec)
    d = d.withColumns(dict(zip(("_i", "_j", "_k"), grid.nearest_index(V3.of()))))
    at = [F.col(c) for c in ("_i", "_j", "_k")]
    d = d.filter(grid.in_bounds(at)).withColumn("lin", grid.lin(*at))
    d = d.withColumns(dict(zip("ijk", grid.from_lin(F.col("lin")))))
    idx = [F.col(c) for c in "ijk"]
    local = grid.block_local(idx, 8)
    return d.select("qid", *idx, *[c.alias(n) for c, n in zip(local, ("li", "lj", "lk"))], grid.local_index(local, 8).alias("local"))


_slab = " ".join(f", (lo{a}-{a})/{d!r}e0 AS s{a}, (hi{a}-{a})/{d!r}e0 AS e{a}" for a, d in zip(X, RAY_DIR))


@query("box_rays", S.with_(S.PTS, S.TRI, f"""bx AS (SELECT mesh_id, tri_id, {", ".join(f"least(a{a}, e{a}, c{a}) AS lo{a}, greatest(a{a}, e{a}, c{a}) AS hi{a}" for a in X)} FROM tri),
t AS (SELECT qid, x, y, z{_slab} FROM pts p JOIN bx b ON p.mesh_id = b.mesh_id),
h AS (SELECT qid, greatest(0e0, {", ".join(f"least(s{a}, e{a})" for a in X)}) AS t0, least({", ".join(f"greatest(s{a}, e{a})" for a in X)}) AS t1 FROM t)""") + "SELECT qid, CAST(count(*) FILTER (WHERE t0 <= t1) AS BIGINT) AS boxes FROM h GROUP BY qid")
def box_rays(spark, sf):
    """How many triangle boxes of its mesh the ray of every point enters."""
    b = T.tris(spark, sf).select("mesh_id", *[f"{q}{a}" for q in ("bmin", "bmax") for a in AXES])
    p = T.mesh_points(spark, sf)
    d = p.select("mesh_id", "qid").join(nearest.ray_boxes(p, b), ["mesh_id", "qid"], "left")
    return d.select("qid", F.coalesce("boxes", F.lit(0)).cast("bigint").alias("boxes"))
