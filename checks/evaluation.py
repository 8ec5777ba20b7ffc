"""Queries that run whole evaluations: moving bodies against stored fields, sweeps, model import."""

from __future__ import annotations

import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from gapfield import session
from gapfield.functions import pose
from gapfield.operators import contact, mesh
from gapfield.operators import query as Q
from gapfield.plans import evaluate
from gapfield.operators.ordered import running
from gapfield.plans.model_import import import_models
from gapfield.sources import field_files, manifest, obj, signal_files, store
from gapfield.sources.lines import read_lines
from gapfield.sources.shapes import annular_sectors

from . import contacts as C
from . import sql as S
from . import tables as T
from .fields import CORNERS, _cell
from .registry import query, rounded

X = S.X
FT = [*C.FT, *C.FTB]


def shared_folder(spark) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{session.shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


# ---- bodies moving over five times -----------------------------------------------------------

_a = C._sql_euler("a1", "a2", "a3")
_b = C._sql_euler("1e-1*n_nationkey", "2e-1", "3e-1")
_poses = f"""pa0 AS (SELECT s_suppkey AS cp_id, s_nationkey, tt AS t, {S.frac('s_acctbal', S.FR[0])}*6e0 AS a1, {S.frac('s_acctbal', S.FR[1])}*3e0 AS a2, {S.frac('s_acctbal', S.FR[2])}*6e0 AS a3,
 {S.cols([f"{q} + {k}*tt" for q, k in zip(S.scatter('s_acctbal', '6e-1', '-3e-1'), ('0e0', '1e-2', '5e-2'))], 'ra')} FROM supplier, (SELECT unnest([0e0, 1e0, 2e0, 3e0, 4e0]) AS tt)),
pa AS (SELECT *, {S.mcols(_a, 'u')} FROM pa0),
pb AS (SELECT n_nationkey, n_nationkey*1e-2 - 1e-1 AS rbx, 2e-2 AS rby, 0e0 AS rbz, {S.mcols(_b, 'b')} FROM nation),
pp AS (SELECT * FROM pa JOIN pb ON s_nationkey = n_nationkey)"""
_mm = S.mat("b")
_world = S.add(S.vec("ra"), S.matvec(S.mat("u"), S.vec("c")))
_eval = f"""tc0 AS (SELECT mesh_id, tri_id, (ax+ex+cx)/3e0 AS cx, (ay+ey+cy)/3e0 AS cy, (az+ez+cz)/3e0 AS cz, fl*5e-1/sum(fl*5e-1) OVER (PARTITION BY mesh_id) AS w FROM tril),
ep AS (SELECT p.*, c.tri_id, c.w, CAST(t AS BIGINT)*100000 + c.tri_id AS qid, {S.cols(_world, 'p')} FROM pp p JOIN tc0 c ON c.mesh_id = CAST(cp_id % 10 AS VARCHAR)),
el AS (SELECT *, CASE WHEN s_nationkey % 5 = 0 THEN -cp_id ELSE cp_id END AS fid, {S.cols(S.matvec(S.transpose(_mm), S.sub(S.vec('p'), S.vec('rb'))), 'l')} FROM ep),
spts AS (SELECT fid AS field_id, qid, lx AS x, ly AS y, lz AS z FROM el)"""
_world_grad = S.matvec(_mm, [f"(CASE WHEN fid < 0 THEN {d} ELSE g.g{a} END)" for a, d in zip(X, ("0e0", "0e0", "1e0"))])
_rows = f"""crows AS (SELECT 'r' AS run_id, e.t, e.cp_id, e.qid, CASE WHEN fid < 0 THEN lz ELSE g.gap END AS gap, e.w, {S.cols(_world_grad, 'g')}, px, py, pz, rax, ray, raz, rbx, rby, rbz,
 1e-1 AS vax, 2e-1 AS vay, -3e-1 AS vaz, 3e-1 AS oax, -1e-1 AS oay, 2e-1 AS oaz, 0e0 AS vbx, 0e0 AS vby, 0e0 AS vbz, 0e0 AS obx, 1e-1 AS oby, 0e0 AS obz,
 TRUE AS valid, 1e4 AS k, 3e-1 AS mu, 1e0 + e.cp_id % 2 AS ord, 5e1 AS damping, 1e-4 AS reg, 0e0 AS eps FROM el e JOIN tl g ON e.fid = g.field_id AND e.qid = g.qid WHERE g.ok OR fid < 0)"""


def moving_bodies(spark, sf):
    s, n = T.load(spark, sf, "supplier"), T.load(spark, sf, "nation")
    f = [T.frac("s_acctbal", m) for m in (T.GOLD, T.ROOT2, T.ROOT3)]
    rot = pose.euler313(f[0] * 6.0, f[1] * 3.0, f[2] * 6.0)
    r = T.scatter("s_acctbal", 0.6, -0.3)
    t = F.col("t")
    a = s.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in range(5)]))).select(
        F.lit("r").alias("run_id"), "t", F.col("s_suppkey").alias("body_id"),
        *[(r[x] + t * k).alias(f"r{x}") for x, k in zip(X, (0.0, 0.01, 0.05))], *[c.alias(q) for q, c in rot.named("r").items()],
        *[F.lit(v).alias(q) for q, v in zip(("vx", "vy", "vz", "ox", "oy", "oz"), (0.1, 0.2, -0.3, 0.3, -0.1, 0.2))],
    )
    rb = pose.euler313(F.col("n_nationkey") * 0.1, F.lit(0.2), F.lit(0.3))
    b = n.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in range(5)]))).select(
        F.lit("r").alias("run_id"), "t", (F.col("n_nationkey") + 1000000).cast("bigint").alias("body_id"),
        (F.col("n_nationkey") * 0.01 - 0.1).alias("rx"), F.lit(0.02).alias("ry"), F.lit(0.0).alias("rz"), *[c.alias(q) for q, c in rb.named("r").items()],
        *[F.lit(v).alias(q) for q, v in zip(("vx", "vy", "vz", "ox", "oy", "oz"), (0.0, 0.0, 0.0, 0.0, 0.1, 0.0))],
    )
    contacts = s.select(
        F.col("s_suppkey").alias("cp_id"), F.col("s_suppkey").alias("body_a"), (F.col("s_nationkey") + 1000000).cast("bigint").alias("body_b"),
        (F.col("s_suppkey") % 10).cast("string").alias("mesh_id"), F.when(F.col("s_nationkey") % 5 == 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("field_id"), F.lit(1e4).alias("k"), F.lit(0.3).alias("mu"),
        (F.lit(1.0) + F.col("s_suppkey") % 2).alias("k_order"), F.lit(50.0).alias("damping"), F.lit(1e-4).alias("regularizer"),
    )
    return a.unionByName(b), contacts


_ctes = (S.TRI, S.TRIN, _poses, _eval, S.SPHERES, S.LOC, CORNERS, _cell(False, "tl"), _rows, C._forces(True))
_evaluated = S.materialized(S.with_(*_ctes), "el", "tl", "crows", "f5")


def _evaluate(spark, sf, plan):
    poses, contacts = moving_bodies(spark, sf)
    q = mesh.surface_points(T.tris(spark, sf)).select("mesh_id", "qid", "x", "y", "z", "w")
    cells = Q.cell_table(T.sphere_voxels(spark, sf, hess=False), cubic=False)
    return plan(poses, contacts, q, T.sphere_fields(spark, sf), cells)


@query("evaluate_contacts", _evaluated + f"SELECT pp.t, pp.cp_id, {', '.join(S.r6(f'coalesce({c}, 0e0)', c, 4) for c in FT)} FROM pp LEFT JOIN wb ON pp.t = wb.t AND pp.cp_id = wb.cp_id")
def evaluate_contacts(spark, sf):
    """Meshes moving through sphere fields and planes: broad phase, field query, law, wrench, all times in one job."""
    return rounded(_evaluate(spark, sf, evaluate.evaluate_contacts).select("t", "cp_id", *FT), FT, 4)


_meas = """me AS (SELECT t, cp_id, arg_min(struct_pack(gap := gap, vn := un), gap) AS m, count(*) AS valid_count, count(*) FILTER (WHERE gap < 0) AS active_count FROM f5 GROUP BY ALL)"""


@query("evaluate_measures", _evaluated.rstrip() + ",\n" + _meas + f""" SELECT pp.t, pp.cp_id, {S.r6('coalesce(m.gap, 1e9)', 'gap')}, {S.r6('greatest(0e0, coalesce(-m.gap, 0e0))', 'penetration')},
 coalesce(active_count, 0) AS active_count, coalesce(valid_count, 0) AS valid_count, {S.r6('coalesce(m.vn, 0e0)', 'normal_velocity', 5)} FROM pp LEFT JOIN me ON pp.t = me.t AND pp.cp_id = me.cp_id""")
def evaluate_measures(spark, sf):
    """The measures of the same contacts; an infinite gap is written as 1e9."""
    d = _evaluate(spark, sf, evaluate.evaluate_measures)
    d = d.withColumn("gap", F.when(F.col("gap") == float("inf"), 1e9).otherwise(F.col("gap")))
    d = d.select("t", "cp_id", "gap", "penetration", "active_count", "valid_count", "normal_velocity")
    return rounded(rounded(d, ["gap", "penetration"]), ["normal_velocity"], 5)


# ---- sweep of rings over fields -----------------------------------------------------------------

_dens = ((4, 16), (8, 32))
_sw = "sw0 AS (" + " UNION ALL ".join(f"SELECT {n} AS nr, {m} AS na, i, j FROM range({n}) a(i), range({m}) b(j)" for n, m in _dens) + f"""),
sw AS (SELECT s_suppkey AS cp_id, 'ring_' || nr AS run_id, {S.frac('s_acctbal', S.FR[0])}*1e-2 AS tilt, 3e-1 + i*3e-1/nr AS a, 3e-1 + (i+1)*3e-1/nr AS b, (j+5e-1)*(2e0*pi()/na) AS th, na FROM supplier, sw0),
crows AS (SELECT run_id, 0e0 AS t, cp_id, -1e-2 + tilt*5e-1*(a+b)*cos(th) AS gap, (b*b-a*a)*5e-1*(2e0*pi()/na) AS w, tilt AS gx, 0e0 AS gy, 1e0 AS gz, 5e-1*(a+b)*cos(th) AS px, 5e-1*(a+b)*sin(th) AS py, -1e-2 AS pz,
 0e0 AS rax, 0e0 AS ray, -1e-2 AS raz, 0e0 AS rbx, 0e0 AS rby, 0e0 AS rbz, 0e0 AS vax, 0e0 AS vay, 0e0 AS vaz, 0e0 AS oax, 0e0 AS oay, 1e0 AS oaz, 0e0 AS vbx, 0e0 AS vby, 0e0 AS vbz, 0e0 AS obx, 0e0 AS oby, 0e0 AS obz,
 TRUE AS valid, 1e6 AS k, 5e-1 AS mu, 1e0 AS ord, 0e0 AS damping, 0e0 AS reg, 0e0 AS eps FROM sw)"""


@query("contact_sweep", S.with_(_sw, C._forces(False), "sx AS (SELECT run_id, cp_id, count(*) AS n_points, count(*) FILTER (WHERE pe > 0) AS n_active, sum(w*pe) AS nf, sum(w*pe*sqrt(px*px+py*py))/sum(w*pe) AS sr FROM f5 GROUP BY ALL)") + f"""SELECT run_id AS label, cp_id AS field_id, n_points, n_active, {S.r6('nf', 'normal_force', 3)}, {S.r6('tz', 'torque', 3)}, {S.r6('sr', 'spin_radius')} FROM sx JOIN wb USING (run_id, cp_id)""")
def contact_sweep(spark, sf):
    """Every ring density on every field: one job, one diagnostics row per case."""
    s = T.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("field_id"), (T.frac("s_acctbal", T.GOLD) * 0.01).alias("tilt"))
    one = {f"{q}{a}": F.lit(v) for q, v in (("bmin", -1.0), ("bmax", 1.0), ("vox", 0.25)) for a in X} | {f"dim{a}": F.lit(8) for a in X}
    fields = s.withColumns(one)
    v = session.spread(fields.select("field_id", "tilt"), "field_id")
    for i in "ijk":
        v = v.withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    v = v.withColumn("phi", (F.col("k") + 0.5) * 0.25 - 1.0 + F.col("tilt") * ((F.col("i") + 0.5) * 0.25 - 1.0))
    cells = Q.cell_table(v, cubic=False)
    base = session.spread(s, "field_id").select("field_id", F.lit(0.01).alias("depth"), F.lit(0.5).alias("mu"), F.lit(1.0).alias("spin"), F.lit(1e6).alias("k"), F.lit(0.3).alias("ri"), F.lit(0.6).alias("ro"))
    rings = [annular_sectors(base.withColumn("label", F.lit(f"ring_{n}")), F.col("ri"), F.col("ro"), n, m) for n, m in _dens]
    pts = rings[0].unionByName(rings[1])
    d = contact.torsion_diagnostics(contact.point_forces(evaluate.sweep_contacts(pts, fields, cells), "linear"), ["label", "field_id"])
    d = d.select("label", "field_id", "n_points", "n_active", "normal_force", "torque", "spin_radius")
    return rounded(rounded(d, ["spin_radius"]), ["normal_force", "torque"], 3)


# ---- model import ---------------------------------------------------------------------------------


@query("import_models", f"""SELECT s_suppkey AS contact_id, s_suppkey*10 + 2 AS body_a, s_suppkey*10 + 1 AS body_b, {S.r6('(s_nationkey + 1)*1e3/1e-6', 'k', 1)}, {S.r6('(abs(s_acctbal) + 1e0)/1e-3', 'damping', 1)},
 {S.r6('s_nationkey*1e-2', 'mu')}, 1e-5 AS activation, {S.r6('s_nationkey*1e-3', 'frame_x')}, 'linear' AS drive, {S.r6('s_nationkey*1e0', 'rate')}, -98e-1 AS gz FROM supplier""")
def model_import(spark, sf):
    """One model text file per hundred suppliers, written, imported and converted to SI."""
    s = T.load(spark, sf, "supplier")
    i = F.col("s_suppkey").cast("bigint")

    def ln(*parts):
        return F.concat(*[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts])

    def cid(n):
        return (i * 10 + n).cast("string")

    text = F.array(
        ln("PART / ", cid(1), ", GROUND"), ln(", NAME = 'G'"), F.lit(""),
        ln("PART / ", cid(2)), ln(", NAME = '", F.col("s_name"), "'"), ln(", MASS = 2.5"), F.lit(""),
        ln("MARKER / ", cid(3)), ln(", NAME = 'G.M'"), ln(", PART = ", cid(1)), ln(", QP = ", F.col("s_nationkey").cast("string"), ", 0, 0"), F.lit(""),
        ln("MARKER / ", cid(4)), ln(", NAME = 'B.M'"), ln(", PART = ", cid(2)), ln(", QP = 0, 1, 0"), F.lit(""),
        ln("JOINT / ", cid(5)), ln(", I = ", cid(3)), ln(", J = ", cid(4)), ln(", REVOLUTE"), F.lit(""),
        ln("MOTION / ", cid(6)), ln(", JOINT = ", cid(5)), ln(", VELOCITY = T"), ln(", FUNCTION = ", F.col("s_nationkey").cast("string"), " \\"), F.lit(""),
        ln("GGEOM / ", cid(7)), ln(", RM = ", cid(3)), F.lit(""), ln("GGEOM / ", cid(8)), ln(", RM = ", cid(4)), F.lit(""),
        ln("GGEOMCONTACT / ", i.cast("string")), ln(", IGGEOMID = ", cid(8)), ln(", JGGEOMID = ", cid(7)), ln(", KORDER = 2"),
        ln(", K = ", ((F.col("s_nationkey") + 1) * 1000).cast("string")), ln(", C = ", (F.abs("s_acctbal") + 1.0).cast("string")),
        ln(", D_F_C = ", (F.col("s_nationkey") * 0.01).cast("string")), F.lit(""),
    )
    head = F.array(F.lit("UNITS / 1"), F.lit(", LENGTH = 'MM'"), F.lit(""), F.lit("ACCGRAV / 1"), F.lit(", KGRAV = -9800"), F.lit(""))
    rows = s.select(F.floor(i / 100).alias("grp"), i.alias("id"), F.posexplode(text).alias("n", "value"))
    heads = s.select(F.floor(i / 100).alias("grp")).distinct().select("grp", F.lit(-1).cast("bigint").alias("id"), F.posexplode(head).alias("n", "value"))
    root = shared_folder(spark)
    rows.unionByName(heads).repartition("grp").sortWithinPartitions("grp", "id", "n").select("grp", "value").write.mode("overwrite").partitionBy("grp").text(root + "/m")
    m = import_models(spark, root + "/m/*")
    fr = m["frames"].select("file", F.col("frame_id").alias("base_frame"), F.col("px").alias("frame_x"))
    j = m["joints"].select("file", "frame_i", "joint_id")
    dr = m["drives"].join(m["functions"], ["file", "fn_id"]).select("file", "joint_id", F.col("kind").alias("drive"), F.col("b").alias("rate"))
    d = m["contacts"].join(fr, ["file", "base_frame"]).join(j, [m["contacts"]["file"] == j["file"], F.col("base_frame") == F.col("frame_i")]).drop(j["file"])
    d = d.join(dr, ["file", "joint_id"]).join(m["gravity"].select("file", "gz"), "file")
    d = d.select(F.col("cp_id").alias("contact_id"), "body_a", "body_b", "k", "damping", "mu", F.round("activation", 9).alias("activation"), "frame_x", "drive", "rate", F.round("gz", 6).alias("gz"))
    return rounded(rounded(d, ["k", "damping"], 1), ["mu", "frame_x", "rate"])


# ---- sinks read back -------------------------------------------------------------------------------


@query("field_store", S.with_(S.SPHERES) + f"SELECT field_id, i, j, k, {S.r6s(['phi', 'nx', 'ny', 'nz'])} FROM vox WHERE bk = 1")
def field_store(spark, sf):
    """Fields written in block order and read back with a filter on the block."""
    root = shared_folder(spark)
    store.write_field(T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf, hess=False), root, mode="overwrite")
    _, v = store.read_field(spark, root)
    return rounded(v.filter("bk = 1").select("field_id", "i", "j", "k", "phi", "nx", "ny", "nz"), ["phi", "nx", "ny", "nz"])


@query("field_store_candidates", S.with_(S.SPHERES) + f"SELECT field_id, i, j, k, r AS rank, {S.r6('phi - r*5e-2', 'phi')} FROM vox, range(3) g(r) WHERE stride > 0 AND (i+j+k) % 3 <> 0")
def field_store_candidates(spark, sf):
    """Candidates written beside their fields and read back."""
    root = shared_folder(spark)
    store.write_field(T.sphere_fields(spark, sf), T.sphere_voxels(spark, sf, hess=False), root, T.sphere_candidates(spark, sf), mode="overwrite")
    c = store.read_candidates(spark, root).select("field_id", "i", "j", "k", F.col("rank").cast("bigint").alias("rank"), "phi")
    return rounded(c, ["phi"])


@query("signal_files", S.with_(S.EV) + f"SELECT 'run' AS scenario, 'Event_' || event_type || '_value' AS signal, {S.r6('t', 'time', 4)}, {S.r6('value')} FROM ev")
def signal_file_round_trip(spark, sf):
    """One file set per event type, written in time order and read back."""
    root = shared_folder(spark)
    e = T.events(spark, sf)
    q = e.select(F.lit("run").alias("scenario"), F.lit("Event").alias("category"), F.col("event_type").alias("entity"), F.lit("value").alias("component"), "t", "value")
    signal_files.write_signals(q, root)
    d = signal_files.read_written_signals(spark, root).select("scenario", "signal", "time", "value")
    return rounded(rounded(d, ["value"]), ["time"], 4)


@query("obj_files", S.with_(S.TRI) + "SELECT mesh_id, count(*) AS n, " + ", ".join(S.r6(f"sum({c})", n, 5) for c, n in (("ax", "sx"), ("ey", "sy"), ("cz", "sz"))) + " FROM tri GROUP BY mesh_id")
def obj_files(spark, sf):
    """Ten meshes written as OBJ text, one folder each, and read in bulk."""
    root = shared_folder(spark)
    v, f = T.vertices_faces(spark, sf)
    # ids dense per mesh, as a file needs them
    t = running(T.tris(spark, sf).select("mesh_id", "tri_id"), ["mesh_id"], ["tri_id"], F.floor(F.col("tri_id") / 100), sums={"n": F.lit(1).cast("bigint")}).select("mesh_id", "tri_id", (F.col("n") - 1).alias("n"))
    v = v.withColumn("tri_id", F.floor(F.col("vid") / 3)).join(t, ["mesh_id", "tri_id"]).withColumn("vid", F.col("n") * 3 + F.col("vid") % 3)
    f = f.join(t, ["mesh_id", "tri_id"]).select("mesh_id", F.col("n").alias("tri_id"), *[(F.col("n") * 3 + c).alias(f"v{c}") for c in range(3)])
    obj.write_obj(v, f, root)
    lines = read_lines(spark, root + "/*/*.txt")
    # a folder is one mesh: its part files follow each other by name
    lines = lines.withColumns({"part": F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint"), "file": F.regexp_extract("file", r"mesh_id=([^/]+)/", 1)})
    lines = lines.withColumn("block", F.shiftleft("part", 40) + F.col("block"))
    v2, f2 = obj.parse_obj(lines)
    d = mesh.join_corners(f2, v2).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ax").alias("sx"), F.sum("by").alias("sy"), F.sum("cz").alias("sz"))
    return rounded(d, ["sx", "sy", "sz"], 5)


# ---- binary field files ---------------------------------------------------------------------------


def write_field_files(voxels, folder: str) -> int:
    """One dense file per field of 8 voxels along each axis, written by the tasks; the number of files."""
    columns = [["phi"], ["nx", "ny", "nz"], ["wx", "wy", "wz"]]

    head = field_files.HEADER.pack(field_files.MAGIC, field_files.VERSION, 8, 8, 8, *[-1.0] * 3, *[1.0] * 3, *[0.25] * 3, 0, (1).to_bytes(4, "little").ljust(32, b"\0"))

    def several(pdf):
        system, base = fs.FileSystem.from_uri(folder)
        written = pdf.sort_values(["field_id", "k", "j", "i"]).groupby("field_id")
        for key, one in written:
            with system.open_output_stream(f"{base}/{key}.sdf") as f:
                f.write(head + b"".join(one[c].to_numpy("<f8").tobytes() for c in columns))
        return pd.DataFrame({"field_id": list(written.groups)})

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    # neighbours by key share a group of rows
    return voxels.groupBy(F.floor(F.col("field_id") / 32)).applyInPandas(several, "field_id bigint").count()


@query("field_file_import", S.with_(S.SPHERES) + "SELECT field_id, i, j, k, " + ", ".join(S.r6(c) for c in ("phi", "nx", "ny", "nz")) + ", " + S.r6("(i+5e-1)*25e-2-1e0 - phi*nx", "wx") + " FROM vox")
def field_file_import(spark, sf):
    """Sphere fields written as binary files, one per supplier, and imported by byte ranges."""
    v = T.sphere_voxels(spark, sf, hess=False)
    w = {f"w{a}": (F.col(c) + 0.5) * 0.25 - 1.0 - F.col("phi") * F.col(f"n{a}") for a, c in zip(X, "ijk")}
    base = shared_folder(spark)
    folder = base if ":" in base else f"file://{base}"
    write_field_files(v.withColumns(w), folder)
    r = field_files.import_field_files(spark, f"{folder}/*.sdf")["voxels"]
    out = r.select(F.col("field_id").cast("bigint").alias("field_id"), *[F.col(c).cast("bigint").alias(c) for c in "ijk"], "phi", "nx", "ny", "nz", "wx")
    return rounded(out, ["phi", "nx", "ny", "nz", "wx"])


@query("manifest_text", "SELECT s_name AS name, CAST(s_suppkey AS BIGINT) AS body_id, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'mesh ' || s_nationkey || '.obj' END AS mesh_id, CASE WHEN s_nationkey % 2 = 0 THEN 'sdf' ELSE 'quadrature_and_sdf' END AS surface_role FROM supplier ")
def manifest_text(spark, sf):
    """Manifest text of all suppliers, parsed and joined to the bodies."""
    s = T.load(spark, sf, "supplier")
    n = F.col("s_nationkey")
    text = F.array(
        F.lit("# made by hand"), F.concat(F.lit("  '"), F.col("s_name"), F.lit("':")),
        F.when(n % 3 == 0, "    mesh: null").otherwise(F.concat(F.lit("    mesh: \"mesh "), n.cast("string"), F.lit(".obj\"  # file"))),
        F.when(n % 2 == 0, "    surface_role: sdf").otherwise(""), F.concat(F.lit("    body_id: "), F.col("s_suppkey").cast("string")),
    )
    rows = s.select(F.lit("m.yaml").alias("file"), F.col("s_suppkey").alias("block"), F.posexplode(text).alias("pos", "line"))
    first = s.agg((F.min("s_suppkey") - 1).alias("block")).select(F.lit("m.yaml").alias("file"), "block", F.lit(0).alias("pos"), F.lit("bodies:").alias("line"))
    m = manifest.parse_manifest(first.unionByName(rows))
    bodies = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("bigint").alias("body_id"))
    return manifest.resolve(bodies, m).select("name", "body_id", "mesh_id", "surface_role")
