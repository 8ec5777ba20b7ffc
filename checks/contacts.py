"""Queries on contact points, wrenches, events, phases, frames and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfield.functions import analytic, pose, timefn
from gapfield.functions.vec import AXES, M3, V3
from gapfield.operators import contact, mesh, model, phases, signals
from gapfield.operators.ordered import bucket_of, running
from gapfield.plans import evaluate
from gapfield.session import spread
from gapfield.sources.shapes import annular_sectors

from . import sql as S
from . import tables as T
from .registry import query, rounded

X = S.X
KEYS = ("run_id", "t", "cp_id")
FT = ["fx", "fy", "fz", "tx", "ty", "tz"]
FTB = ["fbx", "fby", "fbz", "tbx", "tby", "tbz"]


def _forces(power: bool) -> str:
    """CTE text: weighted point forces under either law, from the crows rows."""
    p = "CASE WHEN gap < 0 THEN k*pow(-gap, ord) ELSE 0e0 END" if power else "k*greatest(eps - gap, 0e0)"
    damp = "CASE WHEN gap < 0 THEN -vng*damping ELSE 0e0 END" if power else "0e0"
    live = "valid AND p > 1e-30" if power else "valid"
    ua = S.add(S.vec("va"), S.cross(S.vec("oa"), S.sub(S.vec("p"), S.vec("ra"))))
    ub = S.add(S.vec("vb"), S.cross(S.vec("ob"), S.sub(S.vec("p"), S.vec("rb"))))
    return f"""f0 AS (SELECT *, {p} AS p, {S.norm(S.vec("g"))} AS gl, {S.cols(S.sub(ua, ub), "u")} FROM crows),
f1 AS (SELECT *, p*gl AS pe, {S.dot(S.vec("u"), S.vec("g"))}/gl AS un, {S.dot(S.vec("u"), S.vec("g"))} AS vng FROM f0),
f2 AS (SELECT *, {S.cols(S.sub(S.vec("u"), S.mul(S.vec("g"), "un/gl")), "ut")} FROM f1),
f3 AS (SELECT *, sqrt({S.dot(S.vec("ut"), S.vec("ut"))} + reg*reg) AS den, {damp} AS dmp FROM f2),
f4 AS (SELECT *, {S.cols([f"CASE WHEN {live} THEN (p*g{a} + dmp*g{a} - mu*pe*ut{a}/den)*w ELSE 0e0 END" for a in X], "f")} FROM f3),
f5 AS (SELECT *, {S.cols(S.cross(S.sub(S.vec("p"), S.vec("ra")), S.vec("f")), "to")} FROM f4),
wr AS (SELECT run_id, t, cp_id, {", ".join(f"sum(f{a}) AS f{a}" for a in X)}, {", ".join(f"sum(to{a}) AS t{a}" for a in X)},
 {", ".join(f"any_value({b}{a}) AS {b}{a}" for b in ("ra", "rb") for a in X)} FROM f5 GROUP BY ALL),
wb AS (SELECT *, -fx AS fbx, -fy AS fby, -fz AS fbz, {S.cols([f"-({q})" for q in S.add(S.vec("t"), S.cross(S.sub(S.vec("ra"), S.vec("rb")), S.vec("f")))], "tb")} FROM wr)"""


@query("contact_wrench", S.with_(S.CROWS, _forces(True)) + f"SELECT run_id, t, cp_id, {S.r6s(FT + FTB, 4)} FROM wb")
def contact_wrench(spark, sf):
    """Power law with damping and friction: forces and torques on both bodies."""
    w = contact.wrench(contact.point_forces(T.contact_rows(spark, sf)))
    return rounded(w, FT + FTB, 4)


@query("contact_wrench_linear", S.with_(S.CROWS, _forces(False)) + f"SELECT run_id, t, cp_id, {S.r6s(FT + FTB, 4)} FROM wb")
def contact_wrench_linear(spark, sf):
    return rounded(contact.wrench(contact.point_forces(T.contact_rows(spark, sf), "linear")), FT + FTB, 4)


@query("body_loads", S.with_(S.CROWS, _forces(True), """ld AS (SELECT run_id, t, cp_id AS body_id, fx, fy, fz, tx, ty, tz FROM wb
 UNION ALL SELECT run_id, t, s_nationkey + 1000000, fbx, fby, fbz, tbx, tby, tbz FROM wb JOIN supplier ON cp_id = s_suppkey
 UNION ALL SELECT run_id, t, cp_id, 0e0, 0e0, -981e-2*s_acctbal, 0e0, 0e0, 0e0 FROM wb JOIN supplier ON cp_id = s_suppkey)""") + f"""SELECT run_id, t, CAST(body_id AS BIGINT) AS body_id, {", ".join(S.r6(f"sum({c})", c, 3) for c in FT)} FROM ld WHERE body_id <> 1000000 GROUP BY run_id, t, body_id""")
def body_loads(spark, sf):
    """Both sides of every contact plus gravity, summed per movable body."""
    w = contact.wrench(contact.point_forces(T.contact_rows(spark, sf)))
    b = T.bodies(spark, sf)
    g = contact.gravity_loads(b, w.select("run_id", "t", F.col("cp_id").alias("body_id")))
    loads = contact.stack_loads(contact.wrench_loads(w, T.contact_pairs(spark, sf)), g)
    return rounded(contact.body_loads(loads, b), FT, 3)


_meas = "ms AS (SELECT run_id, t, cp_id, min(gap) FILTER (WHERE valid) AS gap, arg_min(qid, (gap, qid)) FILTER (WHERE valid) AS min_qid, count(*) FILTER (WHERE valid) AS valid_count, count(*) FILTER (WHERE valid AND gap < 0) AS active_count FROM crows GROUP BY ALL)"


@query("contact_measure", S.with_(S.CROWS, _meas) + f"""SELECT run_id, t, cp_id, CASE WHEN gap IS NULL THEN 999 ELSE round(gap, 6) + 0.0 END AS gap, round(greatest(0e0, -coalesce(gap, 0)), 6) + 0.0 AS penetration,
 active_count, valid_count, coalesce(min_qid, -1) AS min_qid FROM ms""")
def contact_measure(spark, sf):
    d = contact.point_forces(T.contact_rows(spark, sf))
    m = contact.measure(d).withColumn("gap", F.when(F.col("gap") == float("inf"), 999.0).otherwise(F.col("gap")))
    return rounded(m.drop("normal_velocity"), ["gap", "penetration"])


@query("min_gap", S.with_(S.CROWS) + f"SELECT run_id, {S.r6('min(gap)', 'min_gap')} FROM crows WHERE valid GROUP BY run_id")
def min_gap(spark, sf):
    m = contact.measure(contact.point_forces(T.contact_rows(spark, sf)))
    return rounded(contact.min_gap(m, ["run_id"]), ["min_gap"])


@query("normalized_weights", "SELECT l_orderkey AS qid, l_linenumber, l_suppkey AS cp_id, round(l_quantity/sum(l_quantity) OVER (PARTITION BY l_suppkey), 9) + 0.0 AS w FROM lineitem")
def normalized_weights(spark, sf):
    l = T.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_linenumber", F.col("l_suppkey").alias("cp_id"), F.col("l_quantity").alias("w"))
    return rounded(contact.normalize_weights(l, ["cp_id"]).select("qid", "l_linenumber", "cp_id", "w"), ["w"], 9)


@query("pressure_above_share", "SELECT l_orderkey AS qid, l_suppkey AS cp_id, l_extendedprice AS p FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE l_extendedprice > m*1e-2")
def pressure_above_share(spark, sf):
    l = T.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("cp_id"), F.col("l_extendedprice").alias("p"))
    return contact.above_share(l, "p", 0.01, ["cp_id"]).select("qid", "cp_id", "p")


@query("penetrating_points", S.with_(S.CROWS) + "SELECT run_id, t, cp_id, qid, count(*) AS n FROM crows WHERE valid AND gap < 0 AND k*pow(-gap, ord) > 1e-30 AND abs(pz) < 8e-1 AND cp_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY ALL")
def penetrating_points(spark, sf):
    """Narrow filter, restriction to a set of contacts, then the points under pressure."""
    d = contact.point_forces(T.contact_rows(spark, sf)).withColumn("z", F.col("pz"))
    ids = T.load(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("cp_id"))
    d = contact.penetrating(contact.restrict(contact.narrow(d, 0.8), ids))
    return d.groupBy("run_id", "t", "cp_id", "qid").agg(F.count(F.lit(1)).alias("n"))


# ---- torsion ---------------------------------------------------------------------------------

N_RAD, N_AZ = 20, 64
_ring = f"""pt AS (SELECT p_partkey AS part_id, p_size*1e-2 AS ri, p_size*1e-2 + {S.frac('p_retailprice', S.FR[0])}*5e-1 + 1e-1 AS ro, 1e-3 + p_size*1e-4 AS depth, 1e-1 + (p_size%5)*1e-1 AS mu,
 CASE WHEN p_size % 2 = 0 THEN 1e0 ELSE -1e0 END AS spin FROM part),
rg AS (SELECT *, ri + i*(ro-ri)/{N_RAD} AS a, ri + (i+1)*(ro-ri)/{N_RAD} AS b, (j+5e-1)*(2e0*pi()/{N_AZ}) AS th FROM pt, range({N_RAD}) r(i), range({N_AZ}) s(j)),
rq AS (SELECT *, 5e-1*(a+b)*cos(th) AS x, 5e-1*(a+b)*sin(th) AS y, (b*b-a*a)*5e-1*(2e0*pi()/{N_AZ}) AS w, 1e6*depth AS pe FROM rg),
ru AS (SELECT *, sqrt(x*x+y*y) AS rad, mu*pe*w AS s FROM rq),
rs AS (SELECT part_id, any_value(ri) AS ri, any_value(ro) AS ro, any_value(depth) AS depth, any_value(mu) AS mu, any_value(spin) AS spin, count(*) AS n_points,
 sum(w*pe) AS nf, sum(w*pe*rad) AS wr, sum(-s*rad)*any_value(spin) AS tq FROM ru GROUP BY part_id),
rt AS (SELECT *, 1e6*depth*pi()*(ro*ro-ri*ri) AS ne, (2e0/3e0)*(ro*ro*ro-ri*ri*ri)/(ro*ro-ri*ri) AS re FROM rs)"""


def part_rings(spark, sf, n_rad=N_RAD, n_az=N_AZ):
    """One ring per part; its points and exact sector weights."""
    p = T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), (F.col("p_size") * 0.01).alias("ri"),
        (F.col("p_size") * 0.01 + T.frac("p_retailprice", T.GOLD) * 0.5 + 0.1).alias("ro"),
        (F.col("p_size") * 0.0001 + 0.001).alias("depth"), ((F.col("p_size") % 5) * 0.1 + 0.1).alias("mu"),
        F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(-1.0).alias("spin"), F.lit(1e6).alias("k"),
    )
    return annular_sectors(spread(p, "part_id"), F.col("ri"), F.col("ro"), n_rad, n_az)


TORS = ["normal_force", "normal_exact", "torque", "torque_exact"]
TOR9 = ["torque_error", "spin_radius", "radius_exact", "tangential_ratio", "balance_error"]


@query("torsion_plane", S.with_(_ring) + f"""SELECT part_id, n_points, n_points AS n_active, {S.r6('nf', 'normal_force', 3)}, {S.r6('ne', 'normal_exact', 3)}, {S.r6('tq', 'torque', 3)}, {S.r6('-mu*ne*re*spin', 'torque_exact', 3)},
 {S.r6('abs(tq + mu*ne*re*spin)/abs(mu*ne*re)', 'torque_error')}, {S.r6('wr/nf', 'spin_radius')}, {S.r6('re', 'radius_exact')}, 0e0 AS tangential_ratio, 0e0 AS balance_error FROM rt""")
def torsion_plane(spark, sf):
    """A ring per part pressed into a plane and spun: numeric sums against the closed forms."""
    pts = evaluate.torsion_points(part_rings(spark, sf))
    d = contact.torsion_diagnostics(contact.point_forces(pts, "linear"), ["part_id"])
    return rounded(rounded(d.drop("tangential_residual"), TORS, 3), TOR9)


@query("convergence_table", S.with_(_ring, f"""e AS (SELECT p_type AS series, CAST(p_size AS DOUBLE) AS size, avg(abs(tq + mu*ne*re*spin)/abs(mu*ne*re)) AS torque_error, avg(wr/nf) AS sr, avg(re) AS re FROM rt JOIN part ON part_id = p_partkey GROUP BY 1, 2)""") + f"""SELECT series, size, {S.r6('torque_error', 'torque_error', 8)}, {S.r6('abs(sr-re)/re', 'radius_error', 8)},
 {S.r6('first_value(torque_error) OVER w * first_value(size) OVER w / size', 'reference', 8)} FROM e WINDOW w AS (PARTITION BY series ORDER BY size)""")
def convergence_table(spark, sf):
    pts = evaluate.torsion_points(part_rings(spark, sf))
    d = contact.torsion_diagnostics(contact.point_forces(pts, "linear"), ["part_id"])
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("series"), "p_size")
    d = d.join(p, "part_id").groupBy("series", "p_size").agg(*[F.avg(c).alias(c) for c in ("torque_error", "spin_radius", "radius_exact")])
    c = contact.convergence(d, F.col("p_size"), ["series"])
    names = ["torque_error", "radius_error", "reference"]
    return rounded(c.select("series", "size", *names), names, 8)


@query("results_by_resolution", "SELECT 'field_res' || p_size AS label, p_size AS resolution, count(*) AS n FROM part GROUP BY ALL ORDER BY p_size")
def results_by_resolution(spark, sf):
    d = T.load(spark, sf, "part").groupBy(F.concat(F.lit("field_res"), F.col("p_size").cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return contact.by_resolution(d).select("label", "resolution", "n")


@query("closed_forms", f"""SELECT p_partkey AS part_id, {S.r6('p_retailprice - p_size', 'plane_gap')}, {S.r6('1e3*2e-3*pi()*(pow(p_size+1,2)-pow(p_size,2))', 'normal_force')},
 {S.r6('(2e0/3e0)*(pow(p_size+1,3)-pow(p_size,3))/(pow(p_size+1,2)-pow(p_size,2))', 'radius')}, {S.r6('p_retailprice/(16e-2*5e1)', 'effective_radius')} FROM part""")
def closed_forms(spark, sf):
    p = T.load(spark, sf, "part")
    s = F.col("p_size").cast("double")
    d = p.select(
        F.col("p_partkey").alias("part_id"), analytic.plane_gap(V3(0.0, 0.0, F.col("p_retailprice")), s).alias("plane_gap"),
        analytic.annulus_normal_force(1e3, 2e-3, s, s + 1.0).alias("normal_force"), analytic.annulus_radius(s, s + 1.0).alias("radius"),
        analytic.effective_radius(F.col("p_retailprice"), 0.16, 50.0).alias("effective_radius"),
    )
    return rounded(d, ["plane_gap", "normal_force", "radius", "effective_radius"])


# ---- events and phases -------------------------------------------------------------------------

BUCKET = 4 * 86400.0
_cross = "cr AS (SELECT *, lag(t) OVER w AS t0, lag(gap) OVER w AS g0 FROM meas WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)), hit AS (SELECT *, t0 + (t-t0)*g0/(g0-gap) AS toi FROM cr WHERE g0 > 0 AND (gap <= 0 OR penetration > 15e0))"


def _crossings(spark, sf):
    return contact.crossings(T.measures(spark, sf), 15.0, bucket_of("t", BUCKET), ("user_id", "event_type"))


@query("crossings", S.with_(S.EV, S.MEAS, _cross) + f"SELECT user_id, event_type, {S.r6('t0', 't_before', 4)}, {S.r6('t', 't_after', 4)}, {S.r6('toi', 'toi', 4)} FROM hit")
def crossings(spark, sf):
    names = ["t_before", "t_after", "toi"]
    return rounded(_crossings(spark, sf).select("user_id", "event_type", *names), names, 4)


@query("earliest_event", S.with_(S.EV, S.MEAS, _cross) + f"SELECT user_id, {S.r6('min(toi)', 'toi', 4)}, arg_min(event_type, (toi, event_type)) AS event_type FROM hit GROUP BY user_id")
def earliest_event(spark, sf):
    return rounded(contact.earliest(_crossings(spark, sf), ["user_id"], "event_type"), ["toi"], 4)


PP = phases.PhaseParams(penetration_tol=5.0, vn_tol=2.0, stable_steps=2, release_steps=2)
_step = """st0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS rn FROM meas),
st AS (SELECT user_id, event_type, rn, t, CASE WHEN gap <= 0 THEN 'IMPACTING' ELSE 'INACTIVE' END AS phase, 0 AS stable, 0 AS release, penetration AS pen FROM st0 WHERE rn = 1
UNION ALL SELECT user_id, event_type, rn, t, CASE WHEN ph1 = 'INACTIVE' AND gap <= 0 THEN 'IMPACTING' ELSE ph1 END, stable, release, pen FROM (
 SELECT *, CASE WHEN phase = 'INACTIVE' OR kill THEN 'INACTIVE' WHEN sep THEN 'LEAVING' WHEN phase = 'IMPACTING' THEN 'ACTIVE' WHEN stable >= 2 THEN 'STABLE' ELSE 'ACTIVE' END AS ph1 FROM (
 SELECT user_id, event_type, rn, t, gap, phase, pen, sep, kill,
  CASE WHEN kill THEN 0 WHEN phase NOT IN ('INACTIVE', 'IMPACTING') AND NOT sep THEN CASE WHEN good THEN stable0 + 1 ELSE 0 END ELSE stable0 END AS stable,
  CASE WHEN phase = 'INACTIVE' THEN release0 WHEN kill OR NOT sep THEN 0 ELSE release0 + 1 END AS release FROM (
 SELECT m.user_id, m.event_type, m.rn, m.t, m.gap, m.penetration AS pen, s.phase, s.stable AS stable0, s.release AS release0,
  (m.gap > 25e0 AND m.normal_velocity >= -2e0) AS sep,
  (s.phase <> 'INACTIVE' AND m.gap > 25e0 AND m.normal_velocity >= -2e0 AND s.release + 1 >= 2) AS kill,
  (m.active_count > 0 AND (abs(m.penetration - s.pen) <= 5e0 OR abs(m.penetration - s.pen)/greatest(abs(s.pen), 5e0) <= 5e-2) AND abs(m.normal_velocity) <= 2e0) AS good
 FROM st s JOIN st0 m ON m.user_id = s.user_id AND m.event_type = s.event_type AND m.rn = s.rn + 1))))"""


def _phases(spark, sf):
    return phases.phases(T.measures(spark, sf), bucket_of("t", BUCKET), PP, ("user_id", "event_type"))


@query("contact_phases", S.with_(S.EV, S.MEAS, _step, recursive=True) + f"SELECT user_id, event_type, {S.r6('t', 't', 4)}, phase, CAST(stable AS INTEGER) AS stable_count, CAST(release AS INTEGER) AS release_count FROM st")
def contact_phases(spark, sf):
    """The phase state machine as running values, against a row-by-row recursion."""
    d = _phases(spark, sf).select("user_id", "event_type", "t", "phase", "stable_count", "release_count")
    return rounded(d, ["t"], 4)


@query("contact_status", S.with_(S.EV, S.MEAS, _step, "l AS (SELECT user_id, event_type, arg_max(gap, t) AS gap, arg_max(penetration, t) AS pen, arg_max(normal_velocity, t) AS vn FROM meas GROUP BY ALL)", "p AS (SELECT user_id, event_type, arg_max(phase, t) AS phase FROM st GROUP BY ALL)", recursive=True) + f"SELECT user_id, event_type, {S.r6('gap')}, {S.r6('pen', 'penetration')}, {S.r6('vn', 'normal_velocity')}, phase FROM l JOIN p USING (user_id, event_type)")
def contact_status(spark, sf):
    d = contact.contact_status(T.measures(spark, sf), _phases(spark, sf), ("user_id", "event_type"))
    names = ["gap", "penetration", "normal_velocity"]
    return rounded(d.select("user_id", "event_type", *names, "phase"), names)


@query("settling_time", S.with_(S.EV, "a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn, (value < 1e2) AS ok FROM ev)", "g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, ok ORDER BY t) AS grp FROM a)", "h AS (SELECT *, row_number() OVER (PARTITION BY user_id, ok, grp ORDER BY t) AS held FROM g)") + "SELECT user_id, coalesce(round(min(t) FILTER (WHERE ok AND held > 5), 4), -1) + 0.0 AS settled_at FROM h GROUP BY user_id")
def settling_time(spark, sf):
    d = phases.settling_time(T.events(spark, sf), F.col("value") < 100.0, 5, bucket_of("t", BUCKET), ["user_id"])
    return d.select("user_id", (F.coalesce(F.round("settled_at", 4), F.lit(-1.0)) + F.lit(0.0)).alias("settled_at"))


@query("shifted_gaps", S.with_(S.CROWS) + f"SELECT run_id, t, cp_id, qid, {S.r6('sum(gap + gx*s_acctbal*1e-6 + gy*2e-3 - gz*s_nationkey*1e-4)', 'gap')} FROM crows JOIN supplier ON cp_id = s_suppkey GROUP BY ALL")
def shifted_gaps(spark, sf):
    """First-order update of stored gaps by a small shift per contact."""
    s = T.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("cp_id"), (F.col("s_acctbal") * 1e-6).alias("dx"), F.lit(2e-3).alias("dy"), (F.col("s_nationkey") * -1e-4).alias("dz"))
    d = contact.shift_gap(T.contact_rows(spark, sf), s).groupBy("run_id", "t", "cp_id", "qid").agg(F.sum("gap").alias("gap"))
    return rounded(d, ["gap"])


# ---- boxes, frames, joints -------------------------------------------------------------------

_pb = "pb AS (SELECT mesh_id, " + ", ".join(f"(min({a})+max({a}))*5e-1 AS c{a}, (max({a})-min({a}))*5e-1 AS h{a}" for a in X) + " FROM vert GROUP BY mesh_id)"


@query("point_boxes", S.with_(S.TRI, S.VERT, _pb) + f"SELECT mesh_id, {S.r6s([f'{q}{a}' for q in 'ch' for a in X])} FROM pb")
def point_boxes(spark, sf):
    v, _ = T.vertices_faces(spark, sf)
    return rounded(mesh.point_boxes(v, ["mesh_id"]), [f"{q}{a}" for q in "ch" for a in X])


def _sql_euler(a, b, c):
    def rz(t):
        return [[f"cos({t})", f"(-sin({t}))", "0e0"], [f"sin({t})", f"cos({t})", "0e0"], ["0e0", "0e0", "1e0"]]

    rx = [["1e0", "0e0", "0e0"], ["0e0", f"cos({b})", f"(-sin({b}))"], ["0e0", f"sin({b})", f"cos({b})"]]
    return S.matmul(S.matmul(rz(a), rx), rz(c))


_ang = [S.frac("c_acctbal", m) for m in S.FR]
# one pose and one marker per customer
_cust = f"""cu AS (SELECT c_custkey, {_ang[0]}*6e0 AS a1, {_ang[1]}*3e0 AS a2, {_ang[2]}*6e0 AS a3, {S.cols([f"{q}*2e0-1e0" for q in _ang], "r")}, {S.cols([f"{q}*5e-1" for q in _ang[::-1]], "p")} FROM customer),
cr AS (SELECT *, {S.mcols(_sql_euler("a1", "a2", "a3"), "r")}, {S.mcols(_sql_euler("a3", "a1", "a2"), "o")} FROM cu),
fw AS (SELECT c_custkey, {S.cols(S.add(S.vec("r"), S.matvec(S.mat("r"), S.vec("p"))), "w")}, {S.mcols(S.matmul(S.mat("r"), S.mat("o")), "m")}, rx, ry, rz FROM cr)"""
_joint = f"""jt AS (SELECT o_orderkey AS joint_id, CASE WHEN o_orderstatus = 'F' THEN 'FIXED' ELSE 'REVOLUTE' END AS type, {", ".join(f"i.w{a} AS iw{a}, j.w{a} AS jw{a}" for a in X)},
 {", ".join(f"i.m{r}{c} AS i{r}{c}, j.m{r}{c} AS j{r}{c}" for r in range(3) for c in range(3))} FROM orders JOIN fw i ON o_custkey = i.c_custkey JOIN fw j ON o_orderkey // 10 = j.c_custkey)"""


def customer_frames(spark, sf):
    c = T.load(spark, sf, "customer")
    f = [T.frac("c_acctbal", m) for m in (T.GOLD, T.ROOT2, T.ROOT3)]
    a = [f[0] * 6.0, f[1] * 3.0, f[2] * 6.0]
    r, o = pose.euler313(*a), pose.euler313(a[2], a[0], a[1])
    vel = [F.lit(0.0).alias(f"{q}{x}") for q in "vo" for x in AXES]
    poses = c.select(F.lit("r").alias("run_id"), F.lit(0.5).alias("t"), F.col("c_custkey").alias("body_id"), *[(q * 2.0 - 1.0).alias(f"r{x}") for x, q in zip(AXES, f)], *[e.alias(n) for n, e in r.named("r").items()])
    frames = c.select(F.col("c_custkey").alias("frame_id"), F.col("c_custkey").alias("body_id"), *[(q * 0.5).alias(f"p{x}") for x, q in zip(AXES, f[::-1])], *[e.alias(n) for n, e in o.named("o").items()])
    joints = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("joint_id"), F.when(F.col("o_orderstatus") == "F", "FIXED").otherwise("REVOLUTE").alias("type"), F.col("o_custkey").alias("frame_i"), F.floor(F.col("o_orderkey") / 10).alias("frame_j"))
    return poses, frames, joints, vel


@query("frame_poses", S.with_(_cust) + "SELECT c_custkey AS frame_id, " + ", ".join([S.r6(f"w{a}", f"p{a}") for a in X] + [S.r6(f"m{r}{c}", f"r{r}{c}") for r in range(3) for c in range(3)]) + " FROM fw")
def frame_poses(spark, sf):
    poses, frames, _, _ = customer_frames(spark, sf)
    d = contact.frame_poses(frames, poses)
    names = [f"p{a}" for a in X] + [f"r{r}{c}" for r in range(3) for c in range(3)]
    return rounded(d.select("frame_id", *names), names)


_jang = f"atan2({S.dot(['i00', 'i10', 'i20'], ['j01', 'j11', 'j21'])}, {S.dot(['i00', 'i10', 'i20'], ['j00', 'j10', 'j20'])})"


@query("joint_angles", S.with_(_cust, _joint) + f"SELECT joint_id, {S.r6(_jang, 'angle')} FROM jt")
def joint_angles(spark, sf):
    poses, frames, joints, _ = customer_frames(spark, sf)
    return rounded(contact.joint_angles(joints, frames, poses).select("joint_id", "angle"), ["angle"])


_rel = S.matmul(S.transpose(S.mat("j")), S.mat("i"))
_jres = f"""jr AS (SELECT *, {S.mcols(_rel, "e")}, {S.dot(['i00', 'i10', 'i20'], ['j02', 'j12', 'j22'])} AS xz, {S.dot(['i01', 'i11', 'i21'], ['j02', 'j12', 'j22'])} AS yz FROM jt),
ja AS (SELECT *, acos(greatest(-1e0, least(1e0, (e00+e11+e22-1e0)/2e0))) AS th FROM jr),
jb AS (SELECT *, CASE WHEN th < 1e-10 THEN 0e0 ELSE th/(2e0*sin(th)) END AS sc FROM ja)"""


@query("joint_residual", S.with_(_cust, _joint, _jres) + f"""SELECT joint_id, type, {", ".join(S.r6(f"iw{a}-jw{a}", f"d{a}") for a in X)},
 {S.r6("CASE WHEN type='FIXED' THEN sc*(e21-e12) ELSE xz END", "rot_x", 5)}, {S.r6("CASE WHEN type='FIXED' THEN sc*(e02-e20) ELSE yz END", "rot_y", 5)}, coalesce({S.r6("CASE WHEN type='FIXED' THEN sc*(e10-e01) END", "rot_z", 5).replace(" AS rot_z", "")}, -9e0) AS rot_z FROM jb""")
def joint_residual(spark, sf):
    poses, frames, joints, _ = customer_frames(spark, sf)
    d = contact.joint_residual(joints, frames, poses).select("joint_id", "type", "dx", "dy", "dz", "rot_x", "rot_y", "rot_z")
    d = rounded(rounded(d, ["dx", "dy", "dz"]), ["rot_x", "rot_y", "rot_z"], 5)
    return d.withColumn("rot_z", F.coalesce("rot_z", F.lit(-9.0)))


@query("drive_error", S.with_(_cust, _joint) + f"SELECT joint_id AS drive_id, {S.r6(_jang + ' - (1e-1 + (joint_id % 7)*2e-1*5e-1)', 'error')} FROM jt")
def drive_error(spark, sf):
    poses, frames, joints, _ = customer_frames(spark, sf)
    drives = joints.select(F.col("joint_id").alias("drive_id"), "joint_id", (F.col("joint_id") % 7).cast("string").alias("fn_id"))
    fns = joints.select((F.col("joint_id") % 7).alias("n")).distinct().select(F.col("n").cast("string").alias("fn_id"), F.lit("linear").alias("kind"), F.lit(0.1).alias("a"), (F.col("n") * 0.2).alias("b"), F.lit(0.0).alias("omega"), F.lit(0.0).alias("phase"))
    d = contact.drive_error(drives, fns, contact.joint_angles(joints, frames, poses))
    return rounded(d.select("drive_id", "error"), ["error"])


_axl = """ax0 AS (SELECT o_orderkey AS force_id, 1e-3*(o_orderkey % 13) AS mag, i.c_custkey AS bi, j.c_custkey AS bj, j.wx-i.wx AS gx, j.wy-i.wy AS gy, j.wz-i.wz AS gz,
 i.wx-i.rx AS ix, i.wy-i.ry AS iy, i.wz-i.rz AS iz, j.wx-j.rx AS jx, j.wy-j.ry AS jy, j.wz-j.rz AS jz FROM orders JOIN fw i ON o_custkey = i.c_custkey JOIN fw j ON o_orderkey // 10 = j.c_custkey),
ax1 AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) AS ln FROM ax0),
ax2 AS (SELECT *, CASE WHEN ln > 1e-30 THEN mag*gx/ln ELSE 0e0 END AS fx, CASE WHEN ln > 1e-30 THEN mag*gy/ln ELSE 0e0 END AS fy, CASE WHEN ln > 1e-30 THEN mag*gz/ln ELSE 0e0 END AS fz FROM ax1),
axl AS (SELECT bi AS body_id, fx, fy, fz, iy*fz-iz*fy AS tx, iz*fx-ix*fz AS ty, ix*fy-iy*fx AS tz FROM ax2
 UNION ALL SELECT bj, -fx, -fy, -fz, -(jy*fz-jz*fy), -(jz*fx-jx*fz), -(jx*fy-jy*fx) FROM ax2)"""


@query("axial_loads", S.with_(_cust, _axl) + f"SELECT body_id, {', '.join(S.r6(f'sum({c})', c) for c in FT)} FROM axl GROUP BY body_id")
def axial_loads(spark, sf):
    """Equal and opposite forces between two markers per order, summed per body."""
    poses, frames, joints, _ = customer_frames(spark, sf)
    forces = joints.select(
        F.col("joint_id").alias("force_id"), "frame_i", "frame_j", F.lit("constant").alias("kind"), ((F.col("joint_id") % 13) * 1e-3).alias("a"),
        *[F.lit(0.0).alias(c) for c in ("b", "omega", "phase")],
    )
    d = contact.axial_loads(forces, frames, poses)
    return rounded(d.groupBy("body_id").agg(*[F.sum(c).alias(c) for c in FT]), FT)


@query("torque_loads", S.with_(_cust) + f"SELECT c_custkey AS body_id, {', '.join(S.r6(f'r{r}2*(2e0+5e-1*3e0)', f't{a}') for r, a in enumerate(X))} FROM cr")
def torque_loads(spark, sf):
    poses, _, _, _ = customer_frames(spark, sf)
    q = poses.select("body_id", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"), F.lit("linear").alias("kind"), F.lit(2.0).alias("a"), F.lit(3.0).alias("b"), F.lit(0.0).alias("omega"), F.lit(0.0).alias("phase"))
    return rounded(contact.torque_loads(q, poses).select("body_id", "tx", "ty", "tz"), ["tx", "ty", "tz"])


@query("rotated_boxes", S.with_(_cust, f"rb AS (SELECT c_custkey, {S.cols(S.add(S.vec('r'), S.matvec(S.mat('r'), S.vec('p'))), 'c')}, {S.cols([f'abs(r{r}0)*px + abs(r{r}1)*py + abs(r{r}2)*pz' for r in range(3)], 'h')} FROM cr)") + f"SELECT c_custkey AS body_id, {S.r6s([f'{q}{a}' for q in 'ch' for a in X])} FROM rb")
def rotated_boxes(spark, sf):
    poses, frames, _, _ = customer_frames(spark, sf)
    d = poses.join(frames.select("body_id", *[F.col(f"p{a}").alias(f"{q}{a}") for q in "ch" for a in X]), "body_id")
    c, h = mesh.rotated_box(M3.of("r"), V3.of("r"))
    return rounded(d.select("body_id", *c.cols("c"), *h.cols("h")), [f"{q}{a}" for q in "ch" for a in X])


@query("vertical_gap", S.with_(S.TRI, S.VERT, _cust, "lo AS (SELECT mesh_id, min(z) AS low FROM vert GROUP BY mesh_id)") + f"""SELECT o_orderkey AS cp_id, {S.r6('i.rz + low - (j.rz + o_totalprice*1e-6)', 'gap')} FROM orders JOIN lo ON CAST(o_orderkey % 10 AS VARCHAR) = mesh_id
 JOIN fw i ON o_custkey = i.c_custkey JOIN fw j ON o_orderkey // 10 = j.c_custkey""")
def vertical_gap(spark, sf):
    poses, _, joints, _ = customer_frames(spark, sf)
    v, _ = T.vertices_faces(spark, sf)
    pairs = joints.select(F.col("joint_id").alias("cp_id"), (F.col("joint_id") % 10).cast("string").alias("mesh_id"), F.col("frame_i").alias("body_a"), F.col("frame_j").alias("body_b"))
    tops = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("cp_id"), (F.col("o_totalprice") * 1e-6).alias("z_top"))
    return rounded(contact.vertical_gap(v, pairs, poses, tops).select("cp_id", "gap"), ["gap"])


@query("function_values", """SELECT p_partkey AS part_id, round(v, 6) + 0.0 AS v, round(d1, 6) + 0.0 AS d1, round(d2, 6) + 0.0 AS d2 FROM (SELECT p_partkey, t, p_partkey % 4 AS kd, p_size*1e0 AS a, 3e-1 AS b, p_size*1e-1 AS om, 2e-1 AS ph,
 CASE p_partkey % 4 WHEN 0 THEN p_size*1e0 WHEN 1 THEN p_size + 3e-1*t WHEN 2 THEN p_size*sin(p_size*1e-1*t + 2e-1) ELSE p_size*cos(p_size*1e-1*t + 2e-1) END AS v,
 CASE p_partkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 3e-1 WHEN 2 THEN p_size*p_size*1e-1*cos(p_size*1e-1*t + 2e-1) ELSE -p_size*p_size*1e-1*sin(p_size*1e-1*t + 2e-1) END AS d1,
 CASE p_partkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN -p_size*p_size*p_size*1e-2*sin(p_size*1e-1*t + 2e-1) ELSE -p_size*p_size*p_size*1e-2*cos(p_size*1e-1*t + 2e-1) END AS d2
 FROM (SELECT *, p_retailprice*1e-2 AS t FROM part))""")
def function_values(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in timefn.KINDS]), (F.col("p_partkey") % 4 + 1).cast("int"))
    d = T.load(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), kind.alias("kind"), F.col("p_size").cast("double").alias("a"), F.lit(0.3).alias("b"), (F.col("p_size") * 0.1).alias("omega"), F.lit(0.2).alias("phase"), (F.col("p_retailprice") * 0.01).alias("t"))
    t = F.col("t")
    return rounded(d.select("part_id", timefn.value(t).alias("v"), timefn.d1(t).alias("d1"), timefn.d2(t).alias("d2")), ["v", "d1", "d2"])


@query("drive_texts", f"""SELECT p_partkey AS part_id, CASE p_partkey % 4 WHEN 0 THEN (CASE WHEN p_size % 2 = 0 THEN 'linear' ELSE 'constant' END) WHEN 1 THEN (CASE WHEN p_size % 2 = 0 THEN 'linear' ELSE 'constant' END) WHEN 2 THEN 'linear' ELSE 'none' END AS kind,
 round(CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN 2*pi() WHEN 2 THEN p_size*pi()/180 ELSE 0 END, 6) + 0.0 AS coefficient FROM part""")
def drive_texts(spark, sf):
    """Drive expressions composed from part rows and parsed to coefficients."""
    m = F.col("p_partkey") % 4
    text = F.when(m == 0, F.col("p_retailprice").cast("string")).when(m == 1, "2*PI").when(m == 2, F.concat(F.col("p_size").cast("string"), F.lit("*time*PI/180"))).otherwise(F.col("p_name"))
    d = T.load(spark, sf, "part").withColumn("f", timefn.parse_drive(text, F.col("p_size") % 2 == 0))
    co = F.coalesce(F.when(F.col("f.kind") == "constant", F.col("f.a")).otherwise(F.col("f.b")), F.lit(0.0))
    return rounded(d.select(F.col("p_partkey").alias("part_id"), F.coalesce("f.kind", F.lit("none")).alias("kind"), co.alias("coefficient")), ["coefficient"])


# ---- merged bodies -----------------------------------------------------------------------------

_mb = f"""s0 AS (SELECT s_suppkey AS id, s_nationkey AS nat, abs(s_acctbal) + 1e0 AS m, {S.cols(S.scatter('s_acctbal', '2e0', '-1e0'), 'r')} FROM supplier),
kp AS (SELECT *, min(id) OVER (PARTITION BY nat) AS keep FROM s0),
cm AS (SELECT keep, sum(m) AS mt, sum(m*rx)/sum(m) AS cx, sum(m*ry)/sum(m) AS cy, sum(m*rz)/sum(m) AS cz, count(*) AS n FROM kp GROUP BY keep),
it AS (SELECT k.keep, sum(1e0 + m*((ry-cy)*(ry-cy)+(rz-cz)*(rz-cz))) AS i00, sum(-m*(rx-cx)*(ry-cy)) AS i01 FROM kp k JOIN cm c ON k.keep = c.keep GROUP BY k.keep)"""


@query("merged_bodies", S.with_(_mb) + f"SELECT cm.keep AS body_id, {S.r6('mt', 'mass', 4)}, {S.r6('cx', 'rx')}, {S.r6('cy', 'ry')}, {S.r6('cz', 'rz')}, {S.r6('i00', 'i00', 3)}, {S.r6('i01', 'i01', 3)} FROM cm JOIN it ON cm.keep = it.keep")
def merged_bodies(spark, sf):
    """Suppliers of a nation chained by fixed joints become one body."""
    s = T.load(spark, sf, "supplier")
    one = {f"{q}{r}{c}": F.lit(float(r == c)) for q in "ri" for r in range(3) for c in range(3)}
    b = s.select(F.lit("m").alias("file"), F.col("s_suppkey").alias("body_id"), F.col("s_name").alias("name"), (F.abs("s_acctbal") + 1.0).alias("mass"), F.lit(False).alias("fixed"), *[c.alias(f"r{a}") for a, c in T.scatter("s_acctbal", 2.0, -1.0).items()]).withColumns(one)
    zero = {f"o{r}{c}": F.lit(float(r == c)) for r in range(3) for c in range(3)}
    frames = b.select("file", F.col("body_id").alias("frame_id"), F.col("name"), "body_id", *[F.lit(0.0).alias(f"p{a}") for a in X]).withColumns(zero)
    # the supplier before in the same nation, found in buckets of the key
    chain = running(s.select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"], bucket_of("s_suppkey", 1000.0), prev={"frame_j": F.col("s_suppkey")})
    j = chain.select(F.lit("m").alias("file"), F.col("s_suppkey").alias("frame_i"), "frame_j").filter("frame_j is not null")
    j = j.select("file", F.col("frame_i").alias("joint_id"), F.lit("j").alias("name"), F.lit("FIXED").alias("type"), "frame_i", "frame_j", F.lit("z").alias("axis"))
    contacts = b.select("file", F.col("body_id").alias("cp_id"), F.col("body_id").alias("body_a"), F.col("body_id").alias("body_b"))
    surfaces = b.select("file", F.col("body_id").alias("surface_id"), "body_id")
    m = model.merge_fixed({"bodies": b, "frames": frames, "joints": j, "contacts": contacts, "surfaces": surfaces})
    d = m["bodies"].select("body_id", "mass", "rx", "ry", "rz", "i00", "i01")
    return rounded(rounded(rounded(d, ["rx", "ry", "rz"]), ["mass"], 4), ["i00", "i01"], 3)




@query("stacked_sweeps", "SELECT p_type AS series, CAST(p_size AS BIGINT) AS size, round(avg(p_retailprice), 4) + 0.0 AS price, NULL::DOUBLE AS high FROM part GROUP BY ALL UNION ALL SELECT p_brand, CAST(-1 AS BIGINT), round(avg(p_retailprice), 4) + 0.0, round(max(p_retailprice), 4) + 0.0 FROM part GROUP BY ALL")
def stacked_sweeps(spark, sf):
    """Result tables of two sweeps with different columns, one under the other."""
    p = T.load(spark, sf, "part")
    a = p.groupBy(F.col("p_type").alias("series"), F.col("p_size").cast("bigint").alias("size")).agg(F.avg("p_retailprice").alias("price"))
    b = p.groupBy(F.col("p_brand").alias("series")).agg(F.avg("p_retailprice").alias("price"), F.max("p_retailprice").cast("double").alias("high"))
    return rounded(signals.stack_sweeps(a, b).select("series", F.coalesce("size", F.lit(-1)).alias("size"), "price", "high"), ["price", "high"], 4)


@query("local_points", S.with_(_cust) + "SELECT c_custkey, " + ", ".join(S.r6(e, f"q{a}") for a, e in zip(X, S.matvec(S.transpose(S.mat("r")), S.sub(S.vec("p"), S.vec("r"))))) + " FROM cr")
def local_points(spark, sf):
    """A world point of every customer in the axes of the customer's body."""
    poses, frames, _, _ = customer_frames(spark, sf)
    d = poses.join(frames.select(F.col("frame_id").alias("c_custkey"), "body_id", "px", "py", "pz"), "body_id")
    q = pose.to_local(V3.of("p"), V3.of("r"), M3.of("r"))
    return rounded(d.select("c_custkey", *q.cols("q")), [f"q{a}" for a in AXES])
