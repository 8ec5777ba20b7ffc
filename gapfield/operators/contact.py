"""Contact points to loads: per-point forces, wrenches, measures, events and diagnostics.

A *contact point row* carries, besides its keys, the gap, the raw gradient in world axes
``gx gy gz``, the weight ``w``, the world position ``px py pz``, the poses and velocities of
both bodies (``ra va oa`` and ``rb vb ob`` with suffixes x, y, z) and the law parameters
``k mu order damping reg``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import law, pose, timefn
from ..functions.vec import AXES, M3, V3, ratio, where
from .ordered import running

WRENCH = ["fx", "fy", "fz", "tx", "ty", "tz"]


def normalize_weights(qpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights that sum to 1 per key, left alone when the sum vanishes.

    The sum is aggregated with map-side combine and joined back, so a huge key is never sorted
    into one window task.
    """
    keys = list(keys)
    total = qpoints.groupBy(*keys).agg(F.sum("w").alias("_sum"))
    d = qpoints.join(total, keys)
    return d.withColumn("w", F.when(F.col("_sum") > 1e-30, ratio(F.col("w"), F.col("_sum"))).otherwise(F.col("w"))).drop("_sum")


def narrow(points: DataFrame, margin: float) -> DataFrame:
    """Points close to the plane z = 0 of the field's frame."""
    return points.filter(F.abs("z") < margin)


def penetrating(points: DataFrame, pressure: str = "p") -> DataFrame:
    return points.filter(F.coalesce(F.col("valid"), F.lit(False)) & (F.col(pressure) > 1e-30))


def above_share(q: DataFrame, col: str, share: float, keys: Sequence[str]) -> DataFrame:
    """Rows whose value exceeds a share of their key's maximum."""
    keys = list(keys)
    top = q.groupBy(*keys).agg(F.max(col).alias("_top"))
    return q.join(top, keys).filter(F.col(col) > F.col("_top") * share).drop("_top")


def movable(bodies: DataFrame) -> DataFrame:
    return bodies.filter(~F.col("fixed"))


def restrict(q: DataFrame, ids: DataFrame, keys: Sequence[str] = ("cp_id",)) -> DataFrame:
    """Rows of the listed contacts (or of active phases, when ``ids`` is a filtered phase table)."""
    return q.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def point_forces(points: DataFrame, kind: str = "power") -> DataFrame:
    """Weighted force and torque about body A at every contact point.

    ``kind='power'`` is the engine law ``k*max(-g,0)^order`` with damping; ``kind='linear'``
    the plain integrator law ``k*max(eps-g,0)`` without. A point that is not valid adds nothing.
    """
    g, grad, p = F.col("gap"), V3.of("g"), V3.of("p")
    off = p - V3.of("ra")
    ua = pose.velocity_at(p, V3.of("ra"), V3.of("va"), V3.of("oa"))
    ub = pose.velocity_at(p, V3.of("rb"), V3.of("vb"), V3.of("ob"))
    pr = law.pressure_pow(g, F.col("k"), F.col("order")) if kind == "power" else law.pressure(g, F.col("k"), F.col("eps"))
    d = points.withColumns({"p": pr, "_gl": grad.norm(), **(ua - ub).named("_u"), **off.named("_o")})
    u = V3.of("_u")
    n = V3(*(F.when(F.col("_gl") > 1e-30, ratio(c, F.col("_gl"))).otherwise(0.0) for c in grad))
    d = d.withColumns({"p_eff": F.col("p") * F.col("_gl"), "_un": u.dot(n), "_vn": u.dot(grad), **n.named("_n")})
    d = d.withColumns((u - V3.of("_n") * F.col("_un")).named("_t"))
    ft = law.friction(V3.of("_t"), F.col("p_eff"), F.col("mu"), F.col("reg"))
    d = d.withColumns(ft.named("_ft"))
    fn = grad * F.col("p")
    if kind == "power":
        fn = fn + law.damping(g, F.col("damping"), F.col("_vn"), grad)
        live = F.coalesce(F.col("valid"), F.lit(False)) & (F.col("p") > 1e-30)
    else:
        live = F.coalesce(F.col("valid"), F.lit(False))
    zero = V3(0.0, 0.0, 0.0)
    f = where(live, (fn + V3.of("_ft")) * F.col("w"), zero)
    d = d.withColumns(f.named("f"))
    d = d.withColumns({**V3.of("_o").cross(V3.of("f")).named("t"), "vn": F.col("_un")})
    drop = ["_gl", "_un", "_vn", *[f"{q}{a}" for q in ("_u", "_o", "_n", "_t", "_ft") for a in AXES]]
    return d.drop(*drop)


def wrench(points: DataFrame, keys: Sequence[str] = ("run_id", "t", "cp_id")) -> DataFrame:
    """Force and torque on A and the reaction on B per key: six sums, combined map-side."""
    ra, rb = V3.of("ra"), V3.of("rb")
    d = points.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in WRENCH],
        *[F.first(f"{b}{a}").alias(f"{b}{a}") for b in ("ra", "rb") for a in AXES],
    )
    f, t = V3.of("f"), V3.of("t")
    fb = -f
    tb = -(t + (ra - rb).cross(f))
    return d.select(*keys, *WRENCH, *fb.cols("fb"), *tb.cols("tb"))


def measure(points: DataFrame, keys: Sequence[str] = ("run_id", "t", "cp_id")) -> DataFrame:
    """Contact measure per key: smallest gap and where, penetration, counts, normal velocity."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    d = points.groupBy(*keys).agg(
        F.min(F.when(ok, F.struct("gap", "qid", "vn"))).alias("_m"),
        F.count_if(ok).alias("valid_count"),
        F.count_if(ok & (F.col("gap") < 0)).alias("active_count"),
    )
    gap = F.coalesce(F.col("_m.gap"), F.lit(float("inf")))
    return d.select(
        *keys, gap.alias("gap"), F.greatest(F.lit(0.0), -gap).alias("penetration"),
        "active_count", "valid_count",
        F.coalesce(F.col("_m.vn"), F.lit(0.0)).alias("normal_velocity"),
        F.coalesce(F.col("_m.qid"), F.lit(-1)).cast("bigint").alias("min_qid"),
    )


def min_gap(measures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return measures.groupBy(*keys).agg(F.min("gap").alias("min_gap"))


# ---- loads per body ------------------------------------------------------------------


def wrench_loads(wrenches: DataFrame, contacts: DataFrame, keys: Sequence[str] = ("run_id", "t")) -> DataFrame:
    """Both sides of every contact as load rows ``(keys, body_id, f, t)``."""
    d = wrenches.join(contacts.select("cp_id", "body_a", "body_b"), "cp_id")
    a = d.select(*keys, F.col("body_a").alias("body_id"), *WRENCH)
    b = d.select(
        *keys, F.col("body_b").alias("body_id"), *V3.of("fb").cols("f"), *V3.of("tb").cols("t")
    )
    return a.unionByName(b)


def stack_loads(*loads: DataFrame) -> DataFrame:
    out = loads[0]
    for d in loads[1:]:
        out = out.unionByName(d)
    return out


def body_loads(loads: DataFrame, bodies: DataFrame, keys: Sequence[str] = ("run_id", "t")) -> DataFrame:
    """Generalized load per movable body."""
    live = loads.join(movable(bodies).select("body_id"), "body_id", "left_semi")
    return live.groupBy(*keys, "body_id").agg(*[F.sum(c).alias(c) for c in WRENCH])


def _posed_frames(rows: DataFrame, frames: DataFrame, poses: DataFrame, col: str, tag: str) -> DataFrame:
    """Add world origin ``p{tag}`` and body origin ``r{tag}`` of the frame named by ``col``."""
    fr = frames.select(F.col("frame_id").alias(col), "body_id", *[f"p{a}" for a in AXES])
    po = poses.select("run_id", "t", "body_id", *[f"r{a}" for a in AXES], *[f"r{r}{c}" for r in range(3) for c in range(3)])
    d = rows.join(fr, col).join(po, "body_id" if "t" not in rows.columns else ["run_id", "t", "body_id"])
    w = pose.to_world(V3.of("p"), V3.of("r"), M3.of("r"))
    keep = [c for c in rows.columns] + [c for c in ("run_id", "t") if c not in rows.columns]
    return d.select(*keep, F.col("body_id").alias(f"body_{tag}"), *w.cols(f"p{tag}"), *V3.of("r").cols(f"r{tag}"))


def axial_loads(forces: DataFrame, frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Equal and opposite forces along the line between two frames.

    ``forces(force_id, frame_i, frame_j, kind, a, b, omega, phase)``; one row per time and body.
    """
    d = _posed_frames(forces, frames, poses, "frame_i", "i")
    d = _posed_frames(d, frames, poses, "frame_j", "j")
    gap = V3.of("pj") - V3.of("pi")
    d = d.withColumns({"_len": gap.norm(), "_mag": timefn.value(F.col("t"))})
    f = V3(*(F.when(F.col("_len") > 1e-30, ratio(c, F.col("_len")) * F.col("_mag")).otherwise(0.0) for c in gap))
    d = d.withColumns(f.named("f"))

    def side(tag, force):
        tau = (V3.of(f"p{tag}") - V3.of(f"r{tag}")).cross(force)
        return d.select("run_id", "t", F.col(f"body_{tag}").alias("body_id"), *force.cols("f"), *tau.cols("t"))

    return side("i", V3.of("f")).unionByName(side("j", -V3.of("f")))


def torque_loads(torques: DataFrame, poses: DataFrame) -> DataFrame:
    """``torques(body_id, axis ux uy uz, kind, a, b, omega, phase)`` turned to world axes."""
    d = torques.join(poses, "body_id")
    tau = (M3.of("r") @ V3.of("u")) * timefn.value(F.col("t"))
    zero = [F.lit(0.0).alias(f"f{a}") for a in AXES]
    return d.select("run_id", "t", "body_id", *zero, *tau.cols("t"))


def gravity_loads(bodies: DataFrame, times: DataFrame, gravity: Sequence[float] = (0.0, 0.0, -9.81)) -> DataFrame:
    """Weight of every movable body at every pose row ``(run_id, t, body_id)``."""
    d = times.select("run_id", "t", "body_id").join(movable(bodies).select("body_id", "mass"), "body_id")
    f = [(F.col("mass") * F.lit(float(g))).alias(f"f{a}") for a, g in zip(AXES, gravity)]
    return d.select("run_id", "t", "body_id", *f, *[F.lit(0.0).alias(f"t{a}") for a in AXES])


def shift_gap(results: DataFrame, shifts: DataFrame, keys: Sequence[str] = ("cp_id",)) -> DataFrame:
    """First-order update of a stored gap for a small shift ``dx dy dz`` per contact."""
    d = results.join(shifts.select(*keys, "dx", "dy", "dz"), list(keys))
    return d.withColumn("gap", F.col("gap") + V3.of("g").dot(V3.of("d"))).drop("dx", "dy", "dz")


# ---- frames and joints -----------------------------------------------------------------


def frame_poses(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """World pose of every marker at every time: ``px.., r00..``."""
    po = poses.select("run_id", "t", "body_id", *[f"r{a}" for a in AXES], *[F.col(f"r{r}{c}").alias(f"b{r}{c}") for r in range(3) for c in range(3)])
    d = frames.join(po, "body_id")
    p, rot = pose.frame_world(V3.of("p"), M3.of("o"), V3.of("r"), M3.of("b"))
    return d.select("run_id", "t", "frame_id", *p.cols("p"), *[c.alias(n) for n, c in rot.named("r").items()])


def _joint_rows(joints: DataFrame, frames: DataFrame, poses: DataFrame) -> DataFrame:
    w = frame_poses(frames, poses)

    def side(tag):
        return w.select(
            "run_id", "t", F.col("frame_id").alias(f"frame_{tag}"),
            *[F.col(f"p{a}").alias(f"{tag}p{a}") for a in AXES],
            *[F.col(f"r{r}{c}").alias(f"{tag}r{r}{c}") for r in range(3) for c in range(3)],
        )

    return joints.join(side("i"), "frame_i").join(side("j"), ["run_id", "t", "frame_j"])


def joint_angles(joints: DataFrame, frames: DataFrame, poses: DataFrame) -> DataFrame:
    d = _joint_rows(joints, frames, poses)
    return d.select("run_id", "t", "joint_id", pose.joint_angle(M3.of("ir"), M3.of("jr")).alias("angle"))


def joint_residual(joints: DataFrame, frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Audit of recorded poses: position gap, then axis dots (revolute) or rotation log (fixed)."""
    d = _joint_rows(joints, frames, poses)
    ri, rj = M3.of("ir"), M3.of("jr")
    log = pose.log_map(rj.t @ ri)
    rev = F.upper("type") == "REVOLUTE"
    fix = F.upper("type") == "FIXED"
    zj = rj.column(2)
    rx = F.when(rev, ri.column(0).dot(zj)).when(fix, log.x)
    ry = F.when(rev, ri.column(1).dot(zj)).when(fix, log.y)
    rz = F.when(fix, log.z)
    return d.select(
        "run_id", "t", "joint_id", "type", *(V3.of("ip") - V3.of("jp")).cols("d"),
        rx.alias("rot_x"), ry.alias("rot_y"), rz.alias("rot_z"),
    )


def drive_error(drives: DataFrame, functions: DataFrame, angles: DataFrame) -> DataFrame:
    """Joint angle minus the drive function at every recorded time."""
    d = drives.join(functions, "fn_id").join(angles, "joint_id")
    return d.select("drive_id", "run_id", "t", (F.col("angle") - timefn.value(F.col("t"))).alias("error"))


# ---- events ----------------------------------------------------------------------------


def crossings(measures: DataFrame, depth: float, bucket: Column, keys: Sequence[str] = ("run_id", "cp_id")) -> DataFrame:
    """Steps in which a contact is first touched: gap was positive and is no longer, or the new
    row is deeper than ``depth``. The time is interpolated linearly between the two rows."""
    d = running(measures, keys, ["t"], bucket, prev={"_t0": F.col("t"), "_g0": F.col("gap")})
    hit = (F.col("_g0") > 0) & ((F.col("gap") <= 0) | (F.col("penetration") > depth))
    toi = F.col("_t0") + (F.col("t") - F.col("_t0")) * ratio(F.col("_g0"), F.col("_g0") - F.col("gap"))
    return d.filter(hit).select(*keys, F.col("_t0").alias("t_before"), F.col("t").alias("t_after"), toi.alias("toi"), "penetration")


def earliest(events: DataFrame, keys: Sequence[str] = (), id_col: str = "cp_id") -> DataFrame:
    """Earliest event of all pairs, ties to the lowest id."""
    m = F.min(F.struct("toi", id_col))
    return events.groupBy(*keys).agg(m.alias("_e")).select(*keys, "_e.*")


def contact_status(measures: DataFrame, phases: DataFrame, keys: Sequence[str] = ("run_id", "cp_id")) -> DataFrame:
    """Latest gap, normal velocity, penetration and phase per contact."""
    keys = list(keys)
    last = measures.groupBy(*keys).agg(
        F.max(F.struct("t", "gap", "normal_velocity", "penetration")).alias("_l")
    ).select(*keys, "_l.*")
    ph = phases.groupBy(*keys).agg(F.max_by("phase", "t").alias("phase"))
    return last.join(ph, keys, "left")


def vertical_gap(qpoints: DataFrame, pairs: DataFrame, poses: DataFrame, tops: DataFrame) -> DataFrame:
    """Lowest point of A minus top of B per time and pair (no rotation, an estimate).

    ``pairs(cp_id, mesh_id, body_a, body_b)``, ``tops(cp_id, z_top)``.
    """
    low = qpoints.groupBy("mesh_id").agg(F.min("z").alias("_low"))
    za = poses.select("run_id", "t", F.col("body_id").alias("body_a"), F.col("rz").alias("_za"))
    zb = poses.select("run_id", "t", F.col("body_id").alias("body_b"), F.col("rz").alias("_zb"))
    d = pairs.join(low, "mesh_id").join(tops, "cp_id").join(za, "body_a").join(zb, ["run_id", "t", "body_b"])
    gap = F.col("_za") + F.col("_low") - (F.col("_zb") + F.col("z_top"))
    return d.select("run_id", "t", "cp_id", gap.alias("gap"))


# ---- torsion diagnostics ---------------------------------------------------------------


def torsion_diagnostics(points: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Sums of a torsion case next to its closed forms.

    ``points`` come from :func:`point_forces` and also hold ``depth ri ro spin`` and the local
    ``x y`` of each point.
    """
    from ..functions import analytic

    ra, rb = V3.of("ra"), V3.of("rb")
    wp = F.col("w") * F.col("p_eff")
    d = points.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in WRENCH],
        F.sum(wp).alias("normal_force"),
        F.sum(wp * F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("_wr"),
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col("p_eff") > 0).alias("n_active"),
        *[F.first(c).alias(c) for c in ("mu", "k", "depth", "ri", "ro", "spin")],
        *[F.first(f"{b}{a}").alias(f"{b}{a}") for b in ("ra", "rb") for a in AXES],
    )
    n_exact = analytic.annulus_normal_force(F.col("k"), F.col("depth"), F.col("ri"), F.col("ro"))
    r_exact = analytic.annulus_radius(F.col("ri"), F.col("ro"))
    d = d.withColumns({"normal_exact": n_exact, "radius_exact": r_exact})
    d = d.withColumn(
        "torque_exact", analytic.torsion_torque(F.col("mu"), F.col("normal_exact"), F.col("radius_exact"), F.col("spin"))
    )
    side = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    fb = -V3.of("f")
    return d.select(
        *keys, "n_points", "n_active", "normal_force", "normal_exact",
        F.col("tz").alias("torque"), "torque_exact",
        F.coalesce(ratio(F.abs(F.col("tz") - F.col("torque_exact")), F.abs("torque_exact")), F.lit(0.0)).alias("torque_error"),
        ratio(F.col("_wr"), F.col("normal_force")).alias("spin_radius"), "radius_exact",
        side.alias("tangential_residual"),
        F.when(F.col("normal_force") > 0, ratio(side, F.col("mu") * F.col("normal_force"))).otherwise(0.0).alias("tangential_ratio"),
        (V3.of("f") + fb).norm().alias("balance_error"),
    )


def convergence(diagnostics: DataFrame, size: Column, series: Sequence[str] = ()) -> DataFrame:
    """Errors by size with a first-order reference line through the smallest size.

    The anchor is one row per series, found by aggregation; without series it is a scalar subquery.
    """
    d = diagnostics.withColumn("size", size.cast("double"))
    first = d.groupBy(*series).agg(F.min(F.struct("size", "torque_error")).alias("_a"))
    radius_error = ratio(F.abs(F.col("spin_radius") - F.col("radius_exact")), F.col("radius_exact"))
    j = d.join(first, list(series)) if series else d.withColumn("_a", first.select("_a").scalar())
    ref = F.col("_a.torque_error") * ratio(F.col("_a.size"), F.col("size"))
    return j.withColumns({"radius_error": radius_error, "reference": ref}).drop("_a")


def by_resolution(diagnostics: DataFrame, label: str = "label") -> DataFrame:
    """Ordered by the number in the label."""
    d = diagnostics.withColumn("resolution", F.regexp_extract(label, r"(\d+)\s*$", 1).try_cast("int"))
    return d.orderBy("resolution", label)
