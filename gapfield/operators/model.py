"""Model assembly from typed entity tables, SI conversion, and merging of rigidly tied bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pose, timefn
from ..functions.vec import AXES, M3, V3
from ..session import cut_lineage

ROT = [f"{r}{c}" for r in range(3) for c in range(3)]
# Joint types of the text format and what they become; others are not imported.
JOINT_KINDS = {"fixed": "FIXED", "revolute": "REVOLUTE", "cylindrical": "REVOLUTE"}
DEFAULT_GRAVITY = -9.81
REGULARIZER = 1e-4


def length_scale(entities: DataFrame, units: DataFrame) -> DataFrame:
    """``(file, ls)``: 0.001 for millimetre files, else 1."""
    u = units.filter(F.col("key") == "LENGTH").select("file", F.upper("value").alias("_u"))
    d = entities.select("file").distinct().join(u, "file", "left")
    return d.select("file", F.when(F.col("_u").isin("MILLIMETER", "MM"), 0.001).otherwise(1.0).alias("ls"))


def _rotation(angles: Column) -> M3:
    m = pose.euler313(angles[0], angles[1], angles[2])
    eye = M3.eye()
    return M3([[F.when(angles.isNull(), eye.rows[r][c]).otherwise(m.rows[r][c]) for c in range(3)] for r in range(3)])


def _vector(arr: Column) -> V3:
    return V3(*(F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)) for i in range(3)))


def assemble_model(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bodies, frames, surfaces, contacts, joints, drives, functions, forces and gravity in SI.

    Everything is keyed by ``(file, id)``, so any number of files is one job. Frames keep their
    marker id. Lengths scale by ``ls``, stiffness by ``ls^-order``, damping by ``1/ls``,
    inertia by ``ls^2``.
    """
    ls = length_scale(tables["entities"], tables["units"])
    cm = tables["markers"].select("file", F.col("marker_id").alias("cm_marker_id"), F.col("qp").alias("_cm"))
    parts = tables["parts"].join(cm, ["file", "cm_marker_id"], "left").join(ls, "file")
    scale = F.col("ls")
    # inertia text order: xx yy zz xy xz yz
    where = [[0, 3, 4], [3, 1, 5], [4, 5, 2]]
    ip = F.col("ip")
    inertia = M3(
        [[F.when(ip.isNull(), float(r == c)).otherwise(F.get(ip, F.lit(where[r][c])) * scale * scale) for c in range(3)] for r in range(3)]
    )
    bodies = parts.select(
        "file", "body_id", "name", "mass", F.coalesce("ground", F.lit(False)).alias("fixed"),
        *(_vector(F.coalesce("_cm", "qg")) * scale).cols("r"),
        *[c.alias(n) for n, c in _rotation(F.col("reuler")).named("r").items()],
        *[c.alias(n) for n, c in inertia.named("i").items()],
    )
    offset = parts.select("file", F.col("body_id").alias("part_id"), F.col("_cm"), "ls")
    fr = tables["markers"].join(offset, ["file", "part_id"])
    local = (_vector(F.col("qp")) - _vector(F.col("_cm"))) * scale
    fr = fr.withColumns(local.named("p"))
    at_cm = (V3.of("p").norm() < 1e-30) & F.element_at(F.split("name", r"\."), -1).contains("CM")
    frames = fr.filter(~F.coalesce(at_cm, F.lit(False))).select(
        "file", F.col("marker_id").alias("frame_id"),
        F.when(F.col("name") == "", F.concat(F.lit("frame_"), "marker_id")).otherwise(F.col("name")).alias("name"),
        F.col("part_id").alias("body_id"), *V3.of("p").cols("p"),
        *[c.alias(n) for n, c in _rotation(F.col("reuler")).named("o").items()],
    )
    known = frames.select("file", "frame_id", "body_id")

    def frame_ref(df, col, body=None):
        """Left join to an existing frame: the id becomes NULL when there is none."""
        k = known.select("file", F.col("frame_id").alias(col), F.lit(True).alias("_ok"), F.col("body_id").alias(body or "_b"))
        d = df.join(k, ["file", col], "left")
        d = d.withColumn(col, F.when(F.col("_ok"), F.col(col))).drop("_ok")
        return d if body else d.drop("_b")

    surfaces = frame_ref(tables["surfaces"].withColumnRenamed("rm_marker_id", "rm_frame"), "rm_frame", "body_id")

    def surface_ref(tag, col):
        return surfaces.select(
            "file", F.col("surface_id").alias(col), F.col("rm_frame").alias(f"{tag}_frame"), F.col("body_id").alias(f"body_{tag[0]}")
        )

    ct = tables["contacts"].join(ls, "file")
    ct = ct.join(surface_ref("action", "iggeom"), ["file", "iggeom"], "left").withColumnRenamed("body_a", "_ba")
    base = surface_ref("base", "jggeom").withColumnRenamed("body_b", "_bb")
    ct = ct.join(base, ["file", "jggeom"], "left")
    contacts = ct.select(
        "file", F.col("contact_id").alias("cp_id"),
        F.when(F.col("name") == "", F.concat(F.lit("contact_"), "contact_id")).otherwise(F.col("name")).alias("name"),
        F.col("_ba").alias("body_a"), F.col("_bb").alias("body_b"),
        (F.col("k") / F.pow(scale, F.col("korder"))).alias("k"), F.col("d_f_c").alias("mu"),
        (F.col("bpen") * scale).alias("activation"), F.col("korder").alias("k_order"),
        (F.col("c") / scale).alias("damping"), F.lit(REGULARIZER).alias("regularizer"),
        "action_frame", "base_frame", F.col("iggeom").alias("surface_a"), F.col("jggeom").alias("surface_b"),
    )
    kind = F.lit(None).cast("string")
    for text, name in JOINT_KINDS.items():
        kind = F.when(F.col("type") == text, name).otherwise(kind)
    jt = tables["joints"].withColumn("type", kind).filter(F.col("type").isNotNull())
    jt = frame_ref(frame_ref(jt.withColumnsRenamed({"marker_i": "frame_i", "marker_j": "frame_j"}), "frame_i"), "frame_j")
    joints = jt.filter(F.col("frame_i").isNotNull() & F.col("frame_j").isNotNull()).select(
        "file", "joint_id", "name", "type", "frame_i", "frame_j", F.lit("z").alias("axis")
    )
    mo = tables["motions"].join(joints.select("file", "joint_id"), ["file", "joint_id"], "left_semi")
    mo = mo.withColumn("_fn", timefn.parse_drive(F.col("function_expr"), F.col("motion_type") == "velocity"))
    fn_id = F.concat(F.lit("motion_fn_"), "motion_id")
    drives = mo.select(
        "file", F.col("motion_id").alias("drive_id"), "name", "joint_id", F.lit("MOTION").alias("mode"),
        F.when(F.col("_fn").isNotNull(), fn_id).otherwise(F.col("function_expr")).alias("fn_id"),
    )
    zero = F.lit(None).cast("double")
    functions = mo.filter(F.col("_fn").isNotNull()).select("file", fn_id.alias("fn_id"), "_fn.*", zero.alias("omega"), zero.alias("phase"))
    af = tables["axial_forces"].withColumnsRenamed({"marker_i": "frame_i", "marker_j": "frame_j"})
    af = frame_ref(frame_ref(af, "frame_i"), "frame_j").filter(F.col("frame_i").isNotNull() & F.col("frame_j").isNotNull())
    fn = timefn.parse_drive(F.col("function_expr"), F.lit(False))
    none = F.struct(F.lit("constant").alias("kind"), F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("b"))
    af = af.withColumn("_fn", F.coalesce(fn, none))
    forces = af.select("file", "force_id", "name", "frame_i", "frame_j", "_fn.*", zero.alias("omega"), zero.alias("phase"))
    g = ls.join(tables["gravity"], "file", "left")
    gravity = g.select(
        "file", F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.coalesce(F.col("g") * scale, F.lit(DEFAULT_GRAVITY)).alias("gz")
    )
    return {
        "bodies": bodies, "frames": frames, "surfaces": surfaces, "contacts": contacts, "joints": joints,
        "drives": drives, "functions": functions, "forces": forces, "gravity": gravity,
    }


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, node, component)``: the smallest node reachable over undirected ``edges(a, b)``.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so long chains shrink by doubling. A reliable checkpoint closes every round.
    """
    keys = keys or []
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.filter(F.col("a") != F.col("b")).distinct())
    lab = nodes.select(*keys, "node", F.col("node").alias("component"))
    while True:
        near = (
            both.join(lab.withColumnRenamed("node", "b"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("component").alias("_m"))
        )
        nxt = lab.join(near, [*keys, "node"], "left").withColumn("_new", F.least("component", "_m"))
        # the label's own label: follow the pointer once more
        up = nxt.select(*keys, F.col("node").alias("_new"), F.col("_new").alias("_up"))
        nxt = nxt.join(up, [*keys, "_new"], "left")
        nxt = nxt.select(*keys, "node", F.least("_new", "_up").alias("_c"), F.col("component").alias("_old"))
        nxt = cut_lineage(nxt)
        moved = nxt.filter(F.col("_c") != F.col("_old")).limit(1).count()
        lab = nxt.select(*keys, "node", F.col("_c").alias("component"))
        if not moved:
            return lab


def merge_fixed(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bodies tied by fixed joints become one: mass sum, centre of mass, parallel-axis inertia.

    The lowest body id of a component is kept. Frames of merged bodies move to the kept body's
    axes, using the merged body's own pose; contacts and surfaces are renamed and the fixed
    joints inside a component are dropped.
    """
    bodies, frames, joints = model["bodies"], model["frames"], model["joints"]
    fb = frames.select("file", "frame_id", "body_id")
    tied = (
        joints.filter(F.col("type") == "FIXED")
        .join(fb.select("file", F.col("frame_id").alias("frame_i"), F.col("body_id").alias("a")), ["file", "frame_i"])
        .join(fb.select("file", F.col("frame_id").alias("frame_j"), F.col("body_id").alias("b")), ["file", "frame_j"])
    )
    comp = connected_components(bodies.select("file", F.col("body_id").alias("node")), tied.select("file", "a", "b"), ["file"])
    comp = comp.select("file", F.col("node").alias("body_id"), F.col("component").alias("keep_id"))
    b = bodies.join(comp, ["file", "body_id"])
    m = F.col("mass")
    com = b.groupBy("file", "keep_id").agg(
        F.sum("mass").alias("_mt"), F.count(F.lit(1)).alias("_size"), *[F.sum(m * F.col(f"r{a}")).alias(f"_s{a}") for a in AXES]
    )
    com = com.select("file", "keep_id", "_mt", "_size", *V3.of("_s").over(F.col("_mt")).cols("_c"))
    b = b.join(com, ["file", "keep_id"])
    d = V3.of("r") - V3.of("_c")
    rot = M3.of("r")
    world = rot @ M3.of("i") @ rot.t
    dv = [d.x, d.y, d.z]
    steiner = [[world.rows[r][c] + m * ((d.norm2() if r == c else F.lit(0.0)) - dv[r] * dv[c]) for c in range(3)] for r in range(3)]
    total = b.withColumns(M3(steiner).named("_w")).groupBy("file", "keep_id").agg(*[F.sum(f"_w{q}").alias(f"_w{q}") for q in ROT])
    kept = b.filter(F.col("body_id") == F.col("keep_id")).join(total, ["file", "keep_id"])
    kept = kept.withColumns((rot.t @ M3.of("_w") @ rot).named("_i"))
    several = F.col("_size") > 1

    def pick(new, old):
        return F.when(several, F.col(new)).otherwise(F.col(old)).alias(old)

    new_bodies = kept.select(
        "file", "body_id", "name", pick("_mt", "mass"), "fixed", *[pick(f"_c{a}", f"r{a}") for a in AXES],
        *[f"r{q}" for q in ROT], *[pick(f"_i{q}", f"i{q}") for q in ROT],
    )
    pose_of = b.select("file", "body_id", "keep_id", "_size", *[F.col(f"r{a}").alias(f"m{a}") for a in AXES], *[F.col(f"r{q}").alias(f"m{q}") for q in ROT], *[f"_c{a}" for a in AXES])
    keep_of = kept.select("file", "keep_id", *[F.col(f"r{q}").alias(f"k{q}") for q in ROT])
    f = frames.join(pose_of, ["file", "body_id"]).join(keep_of, ["file", "keep_id"])
    world_p = pose.to_world(V3.of("p"), V3.of("m"), M3.of("m"))
    kt = M3.of("k").t
    p_new, o_new = kt @ (world_p - V3.of("_c")), kt @ (M3.of("m") @ M3.of("o"))
    f = f.withColumns({**p_new.named("_p"), **o_new.named("_o")})
    new_frames = f.select(
        "file", "frame_id", "name", F.col("keep_id").alias("body_id"), *[pick(f"_p{a}", f"p{a}") for a in AXES], *[pick(f"_o{q}", f"o{q}") for q in ROT]
    )

    def renamed(df, col):
        c = comp.select("file", F.col("body_id").alias(col), "keep_id")
        return df.join(c, ["file", col], "left").withColumn(col, F.coalesce("keep_id", col)).drop("keep_id")

    inner = tied.join(comp.select("file", F.col("body_id").alias("a"), F.col("keep_id").alias("_ka")), ["file", "a"])
    gone = inner.filter(F.col("a") != F.col("b")).select("file", "joint_id")
    return model | {
        "bodies": new_bodies, "frames": new_frames,
        "joints": joints.join(gone, ["file", "joint_id"], "left_anti"),
        "contacts": renamed(renamed(model["contacts"], "body_a"), "body_b").select(*model["contacts"].columns),
        "surfaces": renamed(model["surfaces"], "body_id").select(*model["surfaces"].columns),
    }



