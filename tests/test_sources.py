import json
import os
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import sphere_mesh
from gapfield.functions.vec import AXES
from gapfield.operators import mesh
from gapfield.sources import field_files, manifest, model_text, obj, points, shapes, signal_files, store, surface

def write_sphere(path, n_lat=30, n_lon=40):
    v, f = sphere_mesh(n_lat, n_lon)
    with open(path, "w") as out:
        out.write("# a comment\no sphere\n")
        out.writelines(f"v {x!r} {y!r} {z!r}\n" for x, y, z in v.tolist())
        out.writelines(f"f {i + 1} {j + 1}/7 {k + 1}//3\n" for i, j, k in f.tolist())
    return v, f


def test_obj_counts_and_order(spark, scratch):
    big, small = write_sphere(f"{scratch}/big.obj"), write_sphere(f"{scratch}/small.obj", 6, 8)
    v, f = obj.read_obj(spark, f"{scratch}/*.obj")
    for name, (wv, wf) in (("big", big), ("small", small)):
        got = np.array([list(r) for r in v.filter(F.col("mesh_id") == name).orderBy("vid").select(*AXES).collect()])
        tri = np.array([list(r) for r in f.filter(F.col("mesh_id") == name).orderBy("tri_id").select("v0", "v1", "v2").collect()])
        assert np.array_equal(wv, got) and np.array_equal(wf, tri)
    assert mesh.dangling(f, v).count() == 0


def test_obj_split_reading_keeps_ids(spark, scratch):
    """A file cut into many input splits gets the same ids as one read whole."""
    wv, wf = write_sphere(f"{scratch}/big.obj")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        v, f = obj.read_obj(spark, f"{scratch}/big.obj")
        assert v.select("vid").distinct().count() == len(wv)
        tri = [list(r) for r in f.orderBy("tri_id").select("v0", "v1", "v2").collect()]
        assert np.array_equal(wf, np.array(tri))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_obj_longer_faces(spark, scratch):
    open(f"{scratch}/q.obj", "w").write("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/2/3 2 3 4\nf 1 2//7 3\n")
    v, f = obj.read_obj(spark, f"{scratch}/q.obj")
    assert [tuple(r) for r in f.orderBy("tri_id").select("v0", "v1", "v2").collect()] == [(0, 1, 2), (0, 1, 2)]
    assert obj.read_obj(spark, f"{scratch}/q.obj", "drop")[1].count() == 1


def test_obj_round_trip(spark, scratch):
    v, f = shapes.hollow_cylinder_mesh(spark, n_az=12, n_rad=1, n_vert=2, mesh_id="ring")
    obj.write_obj(v, f, scratch + "/o")
    v2, f2 = obj.read_obj(spark, scratch + "/o/mesh_id=ring/*.txt")
    # several part files of one mesh are one text; here a single task wrote it
    assert v2.count() == v.count() and f2.count() == f.count()


CYLINDERS = {"coarse": (120, 144), "medium": (280, 400), "fine": (432, 648), "dense": (880, 1440), "very_dense": (1920, 3360)}


@pytest.mark.parametrize("name", list(CYLINDERS))
def test_cylinder(spark, name):
    n_az, n_rad, n_vert = shapes.CYLINDER_PRESETS[name]
    v, f = shapes.hollow_cylinder_mesh(spark, n_az=n_az, n_rad=n_rad, n_vert=n_vert, mesh_id="m")
    assert (v.count(), f.count()) == CYLINDERS[name]
    assert mesh.dangling(f, v).count() == 0
    t = mesh.triangles(v, f)
    chord, step = 2 * np.sin(np.pi / n_az), 2 * np.pi / n_az
    walls, ends = n_az * chord * (0.4 + 0.6) * 0.5, n_az * np.sin(step) * (0.36 - 0.16)
    assert t.agg(F.sum("area")).first()[0] == pytest.approx(walls + ends, rel=1e-9)
    # the ends face away from each other
    face = t.groupBy(mesh.face_class(F.col("nz")).alias("c"), "gz").agg(F.sum("area").alias("a")).filter("c != 'wall'").collect()
    assert {(r.c, round(r.gz, 9)) for r in face} == {("bottom", 0.0), ("top", 0.5)}
    assert all(r.a == pytest.approx(ends / 2, rel=1e-9) for r in face)


def test_cube(spark):
    v, f = shapes.cube_mesh(spark)
    assert (v.count(), f.count()) == (5400, 10092) and mesh.dangling(f, v).count() == 0
    t = mesh.triangles(v, f)
    assert t.agg(F.sum("area")).first()[0] == pytest.approx(6 * 16.0, rel=1e-9)
    r = mesh.max_edge(t, 0.201).first()
    assert r.within_limit and r.max_edge <= 0.2
    b = mesh.bounds(v).first()
    assert (b.lox, b.hix, b.loz, b.hiz) == (-2.0, 2.0, -4.0, 0.0)


def test_point_sources(spark):
    p = shapes.annular_points(spark, 0.4, 0.6, 40, 128)
    assert p.count() == 5120
    assert p.agg(F.sum("w")).first()[0] == pytest.approx(np.pi * (0.36 - 0.16), rel=1e-12)
    r = shapes.ring_points(spark, 0.4, 0.6, 0.024, 4, 12, 3)
    assert r.select("qid").distinct().count() == 4 * 12 + 2 * 3 * 12
    assert shapes.square_points(spark, 0.5, 7).agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    fields = spark.createDataFrame(
        [("f", 0.0, 0.0, 0.0, 1.6, 1.6, 1.6, 0.1, 0.1, 0.1, 16, 16, 16, 8)],
        "field_id string, bminx double, bminy double, bminz double, bmaxx double, bmaxy double, bmaxz double, "
        "voxx double, voxy double, voxz double, dimx int, dimy int, dimz int, block_dim int",
    )
    lat = points.lattice_points(fields)
    assert lat.count() == 125
    lo, hi = lat.agg(F.min("x"), F.max("x")).first()
    assert (lo, hi) == (pytest.approx(0.32), pytest.approx(1.28))
    rnd = points.random_points(fields, 5000, 3)
    assert rnd.count() == 5000 and rnd.select("qid").distinct().count() == 5000
    lo, hi, mean = rnd.agg(F.min("y"), F.max("y"), F.avg("y")).first()
    assert lo >= 0.055 and hi <= 0.1 * (16 - 1.05 + 0.5) and abs(mean - 0.8) < 0.03
    vox = spark.createDataFrame([("f", b, 0, 0) for b in (0, 1)], "field_id string, bi long, bj long, bk long")
    bp = points.block_points(vox, fields, 50).toPandas().sort_values("qid")
    assert bp.qid.tolist() == list(range(50))
    # points alternate between the two blocks and lie inside the one they belong to
    side = (bp.qid % 2).values
    assert ((bp.x >= 0.8 * side) & (bp.x <= 0.8 * (side + 1))).all() and bp[["y", "z"]].max().max() <= 0.8


GOOD = """# made by hand
ACME_CONTACT_AWARE_SURFACE 1

surface one
transform 2 0 0 1  0 1 0 0  0 0 1 0  0 0 0 1
vertices 3
v 10 0 0 0
v 11 1 0 0
v 12 0 1 0
triangles 1
tri 0 10 11 12 1 0 1 0 0 2 0 0 1
end
surface two
vertices 4
v 1 0 0 0
v 2 0 1 0
v 3 0 0 1
v 4 1 1 1
triangles 2
tri 0 1 2 3 1 0 0 1 0 0 1 0 0
tri 1 2 3 4 1 0 0 1 0 0 1 0 0
end
"""
DEFECTS = {
    "vertex_count_mismatch": GOOD.replace("vertices 3", "vertices 5"),
    "triangle_count_mismatch": GOOD.replace("triangles 1", "triangles 2"),
    "duplicate_vertex_id": GOOD.replace("v 11 1 0 0", "v 10 1 0 0"),
    "unknown_vertex": GOOD.replace("tri 1 2 3 4", "tri 1 2 3 9"),
    "degenerate_triangle": GOOD.replace("tri 1 2 3 4", "tri 1 2 3 2"),
    "zero_normal": GOOD.replace("tri 0 1 2 3 1 0 0", "tri 0 1 2 3 0 0 0"),
    "bad_header": GOOD.replace("SURFACE 1", "SURFACE 2"),
    "unknown_token": GOOD.replace("triangles 2\n", "triangles 2\nnonsense 4\n"),
    "singular_transform": GOOD.replace("transform 2 0", "transform 0 0"),
    "missing_vertex_count": GOOD.replace("vertices 4\n", ""),
    "outside_surface": GOOD + "v 1 2 3 4\n",
}


def test_surface_text(spark, scratch):
    open(f"{scratch}/good.txt", "w").write(GOOD)
    for k, text in DEFECTS.items():
        open(f"{scratch}/{k}.txt", "w").write(text)
    v, f, d = surface.read_surfaces(spark, scratch)
    found = {}
    for r in d.collect():
        found.setdefault(r.file.rsplit("/", 1)[1][:-4], set()).add(r.kind)
    assert "good" not in found
    for k in DEFECTS:
        assert k in found[k], (k, found.get(k))
    good = F.col("file").endswith("good.txt")
    rows = v.filter(good).orderBy("vid").collect()
    assert [r.vid for r in rows] == list(range(7)) and (rows[1].x, rows[0].x) == (3.0, 1.0)
    t = f.filter(good).orderBy("tri_id").collect()
    assert [(r.v0, r.v1, r.v2) for r in t] == [(0, 1, 2), (3, 4, 5), (4, 5, 6)]
    # inverse transpose of diag(2,1,1) on (1,0,1)
    n = np.array([t[0].n0.x, t[0].n0.y, t[0].n0.z])
    want = np.array([0.5, 0, 1.0])
    assert np.allclose(n, want / np.linalg.norm(want))


def _dense(stride=0, n=8, magic=b"SDFO", version=100):
    tot = n**3
    flags = 1 | (4 if stride else 0)
    res = struct.pack("<II", 3 if stride else 1, stride).ljust(32, b"\0")
    head = struct.pack("<4sI3I3d3d3dI32s", magic, version, n, n, n, 0, 0, 0, 1, 1, 1, 1 / n, 1 / n, 1 / n, flags, res)
    phi = np.arange(tot, dtype="<f8")
    nrm = np.arange(3 * tot, dtype="<f8")
    hess = np.arange(6 * tot, dtype="<f8")
    wit = -np.arange(3 * tot, dtype="<f8")
    out = head + phi.tobytes() + nrm.tobytes() + hess.tobytes() + wit.tobytes()
    if stride:
        out += (np.arange(tot, dtype="<u4") % (stride + 1)).tobytes() + np.arange(tot * stride, dtype="<f8").tobytes()
        out += np.arange(3 * tot * stride, dtype="<f8").tobytes() + np.arange(tot * stride, dtype="<i4").tobytes()
    return out


def _sparse(stride=0, n=10, block=8):
    flags = 2 | (4 if stride else 0)
    res = struct.pack("<IIIIdI", 4 if stride else 2, block, 2, 2, 0.5, stride).ljust(32, b"\0")
    head = struct.pack("<4sI3I3d3d3dI32s", b"SDFO", 100, n, n, n, 0, 0, 0, 1, 1, 1, 0.1, 0.1, 0.1, flags, res)
    c = block**3
    out = head
    for b in ((0, 0, 0), (1, 0, 0)):
        out += struct.pack("<3iI", *b, 0) + np.arange(c, dtype="<f4").tobytes() + np.arange(3 * c, dtype="<f4").tobytes()
        if stride:
            out += (np.arange(c) % (stride + 1)).astype("u1").tobytes() + np.zeros(c * stride, "<f4").tobytes()
            out += np.zeros(3 * c * stride, "<f4").tobytes() + np.arange(c * stride, dtype="<i4").tobytes()
    return out


@pytest.mark.parametrize("step", [65536, 100])
def test_field_files(spark, scratch, step, monkeypatch):
    monkeypatch.setattr(field_files, "SLICE", step)
    files = {
        "dense": _dense(), "cand": _dense(2), "sparse": _sparse(), "spcand": _sparse(3),
        "magic": _dense(magic=b"XXXX"), "version": _dense(version=99), "short": _dense()[:5000], "tiny": b"SDFO",
    }
    for k, b in files.items():
        open(f"{scratch}/{k}.sdf", "wb").write(b)
    r = field_files.import_field_files(spark, f"{scratch}/*.sdf")
    bad = {x.field_id: x.kind for x in r["defects"].collect()}
    assert bad == {"magic": "bad_magic", "version": "bad_version", "short": "short_payload", "tiny": "short_header"}
    f = {x.field_id: x for x in r["fields"].collect()}
    assert {k: x.layout for k, x in f.items()} == {
        "dense": "dense", "cand": "dense_candidates", "sparse": "sparse", "spcand": "sparse_candidates"
    }
    assert (f["sparse"].block_dim, f["sparse"].halo, f["sparse"].band, f["spcand"].stride) == (8, 2, 0.5, 3)
    n = {x[0]: x[1] for x in r["voxels"].groupBy("field_id").count().collect()}
    assert n == {"dense": 512, "cand": 512, "sparse": 512 + 2 * 64, "spcand": 512 + 128}
    x = r["voxels"].filter("field_id = 'dense' and i = 3 and j = 2 and k = 1").first()
    lin = 3 + 8 * (2 + 8 * 1)
    assert (x.phi, x.ny, x.hyz, x.wz) == (lin, 3 * lin + 1, 6 * lin + 4, -(3 * lin + 2))
    c = {k: v for k, v in r["candidates"].groupBy("field_id").count().collect()}
    assert c["cand"] == sum(i % 3 for i in range(512))
    x = r["candidates"].filter("field_id = 'cand' and i = 5 and j = 0 and k = 0 and rank = 1").first()
    assert (x.phi, x.ny, x.branch_id) == (11.0, 3 * 11 + 1, 11)
    assert r["voxels"].filter("field_id = 'sparse' and (hxx is not null or wx is not null)").count() == 0


def test_store(spark, scratch):
    fields = spark.createDataFrame([("a", 8), ("b", 8)], "field_id string, dimx int")
    vox = spark.range(1024).select(
        F.when(F.col("id") < 512, "a").otherwise("b").alias("field_id"), *[F.pmod("id", F.lit(8)).cast("int").alias(c) for c in "ijk"],
        *[F.lit(0).cast("int").alias(c) for c in ("bi", "bj", "bk")], F.col("id").cast("double").alias("phi"),
    )
    store.write_field(fields, vox, scratch + "/s")
    f, v = store.read_field(spark, scratch + "/s", "a")
    assert f.count() == 1 and v.count() == 512 and v.agg(F.max("phi")).first()[0] == 511
    assert "PartitionFilters: [isnotnull(field_folder" in v._jdf.queryExecution().executedPlan().toString()
    for fmt in ("parquet", "json", "csv"):
        store.append_rows(fields, f"{scratch}/{fmt}", fmt)
        store.append_rows(fields, f"{scratch}/{fmt}", fmt)
        r = spark.read.format(fmt).option("header", True).load(f"{scratch}/{fmt}")
        assert r.count() == 4


def test_signal_files(spark, scratch):
    rows = [("case/1", "Joints", "Rev_1", "Tq", t / 10, float(t)) for t in range(20)] + [("s2", "Body", "B", "X (mm)", 0.5, 1.5)]
    q = spark.createDataFrame(rows, "scenario string, category string, entity string, component string, t double, value double")
    signal_files.write_signals(q.filter("scenario = 's2'"), scratch + "/w")
    got = signal_files.read_written_signals(spark, scratch + "/w").collect()
    assert [(r.scenario, r.signal, r.time, r.value) for r in got] == [("s2", "Body_B_X__mm_", 0.5, 1.5)]
    import os
    os.makedirs(scratch + "/r/fall")
    open(scratch + "/r/fall/Joints_Rev_1_Torque.csv", "w").write("time,value\n0,1\n0.5,2\n")
    r = signal_files.read_signals(spark, scratch + "/r").orderBy("t").collect()
    assert [tuple(x) for x in r] == [("fall", "Joints", "Rev_1", "Torque", 0.0, 1.0), ("fall", "Joints", "Rev_1", "Torque", 0.5, 2.0)]


def test_manifest(spark, scratch):
    doc = {"bodies": {"ring": {"mesh": "ring", "sdf": None, "body_id": 2}, "cube": {"mesh": "cube", "sdf": "c", "surface_role": "sdf"}}}
    json.dump(doc, open(scratch + "/m.json", "w"))
    m = manifest.read_manifest(spark, scratch + "/m.json")
    r = {x.body_name: x for x in m.collect()}
    assert r["ring"].surface_role == "quadrature_and_sdf" and r["cube"].field_id == "c"
    b = spark.createDataFrame([(2, "ring"), (3, "none")], "body_id int, name string")
    assert {x.name: x.mesh_id for x in manifest.resolve(b, m).collect()} == {"ring": "ring", "none": None}


MODEL = """! header comment
UNITS / 1
, LENGTH = 'MILLIMETER'
, FORCE = 'NEWTON'

ACCGRAV / 1
, IGRAV = 0
, KGRAV = -9806.65D

PART / 1, GROUND
, NAME = 'Ground'

PART / 2
, NAME = 'Ring'
, MASS = 2.5
, CM = 21, IP = 9
, IP = 1, 2, 3
, IP = 4, 5, 6
, QG = 10, 20, 30

MARKER / 11
, NAME = 'Ground.M1'
, PART = 1
, QP = 1, 2, 3

MARKER / 21
, NAME = 'Ring.CM'
, PART = 2
, QP = 5, 6, 7

MARKER / 22
, NAME = 'Ring.M1'
, PART = 2
, QP = 6, 6, 7
, REULER = 1.5707963267948966, 0, 0
! a comment inside
JOINT / 31
, NAME = 'J'
, I = 11
, J = 22
, REVOLUTE

MOTION / 41
, NAME = 'Drive'
, JOINT = 31
, ROTATION
, VELOCITY = TRUE
, FUNCTION = 2*PI \\

AXIAL_FORCE / 51
, I = 11
, J = 22
, FUNCTION = 12.5

GGEOM / 61
, NAME = 'Plate'
, RM = 11
, NO_PATCH = 1
, NO_NODE = 3
, NODES
, 0, 0, 0
, 1, 0, 0
, 0, 1, 0
, PATCHES = 1
3, 1, 2, 3

odd / line inside patches
3, 2, 3, 1
GGEOM / 62
, NAME = 'Other'
, RM = 22

GGEOMCONTACT / 71
, NAME = 'C'
, IGGEOMID = 62
, JGGEOMID = 61
, KORDER = 2
, D_F_C = 0.3

WEIRD / 5
, A = 1

OUTPUT / 1
, STEPS = 100
loose line
, IGNORED = 1
END
PART / 99
"""


def test_model_text(spark, scratch):
    open(scratch + "/a.rmd", "w").write(MODEL)
    ent, lines = model_text.read_entities(spark, scratch)
    e = ent.orderBy("ent_no").collect()
    assert [(r.kind, r.ent_id) for r in e][:4] == [("UNITS", 1), ("ACCGRAV", 1), ("PART", 1), ("PART", 2)]
    assert [r.ent_no for r in e] == list(range(1, len(e) + 1))
    assert [r.kind for r in e].count("ODD") == 0 and all(r.ent_id != 99 for r in e)
    assert e[0].line_start == 1
    part = next(r for r in e if (r.kind, r.ent_id) == ("PART", 2))
    assert part.attrs["IP"] == "1, 2, 3 4, 5, 6" and part.attrs["CM"] == "21, IP = 9"
    assert next(r for r in e if r.kind == "OUTPUT").attrs == {"STEPS": "100"}
    patch = [r.line for r in lines.filter("ent_id = 61").orderBy("line_no").collect()]
    assert "odd / line inside patches" in patch and patch[-1] == "3, 2, 3, 1"

    t = model_text.entity_tables(ent, lines)
    assert [r.type for r in t["joints"].collect()] == ["revolute"]
    c = t["contacts"].first()
    assert (c.k, c.korder, c.c, c.bpen, c.s_t_v, c.iggeom) == (100000.0, 2, 10.0, 0.01, 0.1, 62)
    assert [r.kind for r in t["unknown"].collect()] == ["WEIRD"]
    assert {r.body_id: r.ground for r in t["parts"].collect()} == {1: True, 2: False}
    v, f = model_text.entity_meshes(lines)
    assert v.count() == 3 and [tuple(r) for r in f.orderBy("tri_id").select("v0", "v1", "v2").collect()] == [(0, 1, 2), (1, 2, 0)]

    from gapfield.operators.model import assemble_model
    m = assemble_model(t)
    b = {r.body_id: r for r in m["bodies"].collect()}
    # CM reads "21, IP = 9" and is no number, so the part keeps its own position
    assert b[2].rx == pytest.approx(0.010) and b[1].fixed and b[2].i00 == pytest.approx(1e-6) and b[2].i01 == pytest.approx(4e-6)
    fr = {r.frame_id: r for r in m["frames"].collect()}
    assert set(fr) == {11, 21, 22} and fr[22].o01 == pytest.approx(-1.0)
    k = m["contacts"].first()
    assert (k.k, k.damping, k.activation, k.mu) == (pytest.approx(1e11), pytest.approx(1e4), pytest.approx(1e-5), 0.3)
    assert (k.body_a, k.body_b, k.action_frame, k.base_frame) == (2, 1, 22, 11)
    assert m["gravity"].first().gz == pytest.approx(-9.80665)
    d = m["drives"].first()
    fn = m["functions"].first()
    assert d.fn_id == fn.fn_id and (fn.kind, fn.b) == ("linear", pytest.approx(2 * np.pi))
    assert m["forces"].first().a == 12.5 and m["joints"].count() == 1


def test_model_text_is_read_once(spark, scratch):
    def seen(batches):
        for b in batches:
            with open(f"{scratch}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield b

    text = ["PART / 7, GROUND", ", MASS = 2", "", "PART / 8", ", NAME = 'b'", "stray"]
    d = spark.createDataFrame([("m", 0, n, x) for n, x in enumerate(text)], "file string, block bigint, pos bigint, line string").coalesce(1)
    entities, lines = model_text.parse_entities(d.mapInArrow(seen, d.schema))
    assert [(r.ent_id, r.attrs) for r in entities.orderBy("ent_no").collect()] == [(7, {"MASS": "2"}), (8, {"NAME": "'b'"})]
    assert lines.count() == 4
    assert sum(int(open(f"{scratch}/{p}").read()) for p in os.listdir(scratch)) == len(text)


def test_model_cm_marker(spark, scratch):
    open(scratch + "/b.rmd", "w").write(MODEL.replace(", CM = 21, IP = 9", ", CM = 21"))
    from gapfield.plans.model_import import import_models
    m = import_models(spark, scratch)
    b = {r.body_id: r for r in m["bodies"].collect()}
    assert (b[2].rx, b[2].rz) == (pytest.approx(0.005), pytest.approx(0.007))
    fr = {r.frame_id: r for r in m["frames"].collect()}
    assert set(fr) == {11, 22} and fr[22].px == pytest.approx(0.001)
