"""Sources that are read from text or parameters made of table rows."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from gapfield.functions.triangle import barycentric, closest_point, edge_dots
from gapfield.functions.vec import AXES, V3
from gapfield.operators import mesh
from gapfield.sources import model_text, shapes, signal_files, surface

from . import sql as S
from . import tables as T
from .evaluation import shared_folder
from .registry import query, rounded

X = S.X

# ---- corner-normal surfaces: one per supplier, moved and stretched; every fifth nation's names a vertex that is not there


def _surface_lines(spark, sf):
    s = T.load(spark, sf, "supplier")
    x, y, z = T.scatter("s_acctbal", 2.0, -1.0).values()
    text = lambda *parts: F.concat_ws(" ", *[p if not isinstance(p, str | float | int) else F.lit(str(p)) for p in parts])
    far = F.when(F.col("s_nationkey") % 5 == 0, "9").otherwise("3")
    lines = F.array(
        text("surface", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))), text("transform", 2, 0, 0, F.col("s_nationkey"), 0, 1, 0, 0, 0, 0, 0.5, 0, 0, 0, 0, 1),
        F.lit("vertices 3"), text("v", 1, x, y, z), text("v", 2, x + 1.0, y, z), text("v", 3, x, y + 1.0, z + 0.5), F.lit("# a comment"),
        F.lit("triangles 1"), text("tri", 1, 1, 2, far, 1, 0, 0, 0, 1, 0, 1, 1, 1), text("end", "surface"),
    )
    rows = s.select(F.lit("s.txt").alias("file"), F.col("s_suppkey").alias("block"), F.posexplode(lines).alias("pos", "line"))
    first = s.agg((F.min("s_suppkey") - 1).alias("block")).select(F.lit("s.txt").alias("file"), "block", F.lit(0).alias("pos"), F.lit("GAP_CONTACT_AWARE_SURFACE 1").alias("line"))
    return first.unionByName(rows)


_SURF = f"""s0 AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS rn, {S.cols(S.scatter('s_acctbal', '2e0', '-1e0'), 'p')} FROM supplier)"""


@query("surface_faces", S.with_(_SURF) + f"""SELECT CAST(rn + 1 AS BIGINT) AS surface_no, 's' || s_suppkey AS surface, CAST(rn AS BIGINT) AS tri_id, CAST(3*rn AS BIGINT) AS v0, CAST(3*rn + 2 AS BIGINT) AS v2,
 {S.r6('2e0*px + s_nationkey', 'x0')}, {S.r6('2e0*(px+1e0) + s_nationkey', 'x1')}, {S.r6('(pz+5e-1)*5e-1', 'z2')}, {S.r6('1e0', 'n0x')}, {S.r6('2e0/sqrt(525e-2)', 'n2z')} FROM s0 WHERE s_nationkey % 5 <> 0""")
def surface_faces(spark, sf):
    """Faces of all surfaces with their moved corners and normals turned by the inverse transpose."""
    v, f, _ = surface.parse_surfaces(_surface_lines(spark, sf))
    p = v.select("file", "vid", F.struct(*AXES).alias("p"))
    d = f
    for c in range(3):
        d = d.join(p.withColumnsRenamed({"vid": f"v{c}", "p": f"p{c}"}), ["file", f"v{c}"])
    d = d.select("surface_no", "surface", "tri_id", "v0", "v2", F.col("p0.x").alias("x0"), F.col("p1.x").alias("x1"), F.col("p2.z").alias("z2"), F.col("n0.x").alias("n0x"), F.col("n2.z").alias("n2z"))
    return rounded(d, ["x0", "x1", "z2", "n0x", "n2z"])


@query("surface_defects", S.with_(_SURF) + "SELECT CAST(10*rn + 10 AS BIGINT) AS line_no, 'unknown_vertex' AS kind, '9' AS detail FROM s0 WHERE s_nationkey % 5 = 0")
def surface_defects(spark, sf):
    return surface.parse_surfaces(_surface_lines(spark, sf))[2].select("line_no", "kind", "detail")


# ---- surfaces inside model entities ------------------------------------------------------------------


@query("entity_meshes", f"""WITH s0 AS (SELECT *, {S.cols(S.scatter('s_acctbal', '2e0', '-1e0'), 'p')} FROM supplier WHERE s_nationkey % 4 <> 0)
 SELECT 'm.rmd#' || s_suppkey AS mesh_id, CAST(0 AS BIGINT) AS tri_id, {S.r6('px', 'ax')}, {S.r6('py + 1e0', 'bey')}, {S.r6('pz', 'cz')} FROM s0""")
def entity_meshes(spark, sf):
    """One triangle per supplier as node and patch lines; an entity without patches has no mesh."""
    s = T.load(spark, sf, "supplier")
    x, y, z = T.scatter("s_acctbal", 2.0, -1.0).values()
    row = lambda *p: F.concat_ws(", ", F.lit(""), *[c.cast("string") for c in p])
    patches = F.when(F.col("s_nationkey") % 4 == 0, F.array()).otherwise(F.array(F.lit(", PATCHES = 1"), F.lit("3, 1, 2, 3")))
    lines = F.concat(F.array(F.lit(", NODES = 3"), row(x, y, z), row(x, y + 1.0, z), row(x + 1.0, y, z)), patches)
    d = s.select(F.lit("m.rmd").alias("file"), F.col("s_suppkey").cast("string").alias("ent_id"), F.lit("GGEOM").alias("kind"), (F.col("s_suppkey") * 100).alias("line_start"), F.posexplode(lines).alias("n", "line"))
    v, f = model_text.entity_meshes(d.withColumn("line_no", F.col("line_start") + F.col("n")).drop("n"))
    d = mesh.join_corners(f, v).select("mesh_id", "tri_id", "ax", F.col("by").alias("bey"), "cz")
    return rounded(d, ["ax", "bey", "cz"])


# ---- signal files named by category, entity and component --------------------------------------------


@query("signal_scan", "SELECT 'run' AS scenario, 'Event' AS category, event_type || '_of_users' AS entity, 'value' AS component, count(*) AS n, " + S.r6("sum(value)", "total", 4) + f" FROM events GROUP BY event_type")
def signal_scan(spark, sf):
    """One file per event type, scanned by its name."""
    base = shared_folder(spark)
    folder = base if ":" in base else f"file://{base}"

    def one(pdf):
        kind = pdf["event_type"].iloc[0]
        system, root = fs.FileSystem.from_uri(folder)
        with system.open_output_stream(f"{root}/run/.{kind}.part") as out:
            out.write(pdf.sort_values("t")[["t", "value"]].to_csv(index=False, header=["time", "value"]).encode())
        system.move(f"{root}/run/.{kind}.part", f"{root}/run/Event_{kind}_of_users_value.csv")
        return pdf[["event_type"]].head(1)

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/run", recursive=True)
    T.events(spark, sf).select("event_type", "t", "value").groupBy("event_type").applyInPandas(one, "event_type string").count()
    d = signal_files.read_signals(spark, folder).groupBy("scenario", "category", "entity", "component").agg(F.count("t").alias("n"), F.sum("value").alias("total"))
    return rounded(d, ["total"], 4)


# ---- parametric meshes --------------------------------------------------------------------------------


@query("shape_volumes", f"""WITH p AS (SELECT 1e0 + avg({S.frac('s_acctbal', S.FR[0])}) AS hw, 2e-1 + avg({S.frac('s_acctbal', S.FR[1])}) AS ri FROM supplier)
 SELECT 'cube' AS mesh_id, {S.r6('6e0*4e0*hw*hw', 'area')}, {S.r6('8e0*hw*hw*hw/3e0', 'volume')} FROM p
 UNION ALL SELECT 'hollow_cylinder', round({{area}}, 6) + 0.0, round({{volume}}, 6) + 0.0 FROM p""".format(
     area="2e0*20*sin(pi()/20)*5e-1*(2e0*ri + 5e-1) + 20*sin(2e0*pi()/20)*((ri+5e-1)*(ri+5e-1) - ri*ri)", volume="10*sin(2e0*pi()/20)*((ri+5e-1)*(ri+5e-1) - ri*ri)*5e-1"))
def shape_volumes(spark, sf):
    """Area and enclosed volume, by the winding of the faces, of meshes whose sizes come from the suppliers.

    The cube's sides across y are wound inwards, by the rule that makes it, and count as negative: a third of its volume is left.
    """
    s = T.load(spark, sf, "supplier")
    hw, ri = s.agg(F.avg(T.frac("s_acctbal", T.GOLD)) + 1.0, F.avg(T.frac("s_acctbal", T.ROOT2)) + 0.2).first()
    parts = []
    for v, f in (shapes.cube_mesh(spark, hw, 0.4), shapes.hollow_cylinder_mesh(spark, ri, ri + 0.5, 0.5, 20, 2, 3)):
        parts.append(mesh.join_corners(f, v))
    d = parts[0].unionByName(parts[1])
    a, b, c = (V3.of(k) for k in "abc")
    d = d.withColumns((b - a).cross(c - a).named("_f"))
    d = d.groupBy("mesh_id").agg((F.sum(V3.of("_f").norm()) * 0.5).alias("area"), F.abs(F.sum(a.dot(V3.of("_f"))) / 6.0).alias("volume"))
    return rounded(d, ["area", "volume"])


_pair = "pair AS (SELECT p.qid, p.x, p.y, p.z, t.* FROM pts p JOIN orders o ON p.qid = o.o_orderkey JOIN tri t ON t.tri_id = o.o_custkey % (SELECT count(*) FROM tri))"


@query("barycentric", S.with_(S.PTS, S.TRI, _pair, S.closest("pair", ["qid", *S.CORNERS], "c"),
    f"b0 AS (SELECT qid, {S.cols(S.sub(S.vec('e'), S.vec('a')), 'u')}, {S.cols(S.sub(S.vec('c'), S.vec('a')), 'w')}, {S.cols(S.sub(S.vec('cp'), S.vec('a')), 'q')} FROM c)",
    f"b1 AS (SELECT qid, {S.norm(S.cross(S.vec('q'), S.vec('w')))} AS ub, {S.norm(S.cross(S.vec('u'), S.vec('q')))} AS uc, {S.norm(S.cross(S.vec('u'), S.vec('w')))} AS whole FROM b0)")
    + f"SELECT qid, {S.r6('1e0 - ub/whole - uc/whole', 'b0', 5)}, {S.r6('ub/whole', 'b1', 5)}, {S.r6('uc/whole', 'b2', 5)} FROM b1")
def barycentric_weights(spark, sf):
    """Weights of the closest point of a triangle per order, against ratios of areas."""
    many = T.load(spark, sf, "embeddings").agg(F.count("vec_id")).scalar()
    o = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % many).alias("tri_id"))
    d = T.mesh_points(spark, sf).drop("mesh_id").join(o, "qid").join(edge_dots(T.tris(spark, sf)), "tri_id")
    d = barycentric(closest_point(d, V3.of()), V3.of("c_"))
    return rounded(d.select("qid", "b0", "b1", "b2"), ["b0", "b1", "b2"], 5)
