import math

import numpy as np
import pandas as pd
import pytest
from brute import closest, mesh_frames, signed, sphere_mesh
from pyspark.sql import functions as F

from gapfield.functions import law, pose
from gapfield.functions.vec import AXES, M3, V3
from gapfield.operators import bins, contact, mesh, model, nearest, ordered, phases, sectors, signals
from gapfield.operators import query as Q
from gapfield.plans import build, evaluate
from gapfield.sources import shapes


def pts_frame(spark, p, mesh_id="m"):
    return spark.createDataFrame([(mesh_id, i, *map(float, x)) for i, x in enumerate(p)], "mesh_id string, qid long, x double, y double, z double")


@pytest.mark.parametrize("levels", [1, 3, 4])
def test_nearest_and_sign_on_a_closed_mesh(spark, levels):
    v, f = sphere_mesh()
    # exact copies of a face and one tiny cluster far away
    f = np.vstack([f, f[:5]])
    k = len(v)
    v = np.vstack([v, 3 + np.random.default_rng(1).random((30, 3)) * 1e-3])
    f = np.vstack([f, np.arange(k, k + 30).reshape(-1, 3)])
    rng = np.random.default_rng(2)
    p = np.vstack([rng.uniform(-1.4, 1.4, (150, 3)), rng.uniform(-40, 40, (20, 3)), v[:5] * 0.999, [[0.01, 0.02, 0.03]]])
    t = mesh.triangles(*mesh_frames(spark, v, f))
    got = {r.qid: r for r in nearest.signed_distance(pts_frame(spark, p), t, levels=levels).collect()}
    assert len(got) == len(p)
    for i, x in enumerate(p):
        s, _, n = signed(x, v, f)
        assert got[i].dist == pytest.approx(abs(s), abs=1e-9)
        assert got[i].hits == n and got[i].phi == pytest.approx(s, abs=1e-9)
    far = nearest.nearest_triangle(pts_frame(spark, p), t, levels=levels).collect()
    a, b, c = (v[f[:, q]] for q in range(3))
    for r in far:
        _, d2 = closest(p[r.qid], a, b, c)
        tie = np.nonzero(d2 <= d2.min() + 1e-14)[0]
        assert r.tri_id in tie
        assert r.tri_id < len(f) - 15 or r.tri_id >= len(f) - 10, "a copy must not beat the lower id"


def test_plans_have_no_nested_loops(spark):
    v, f = sphere_mesh()
    t = mesh.triangles(*mesh_frames(spark, v, f))
    p = pts_frame(spark, v * 1.1)
    for d in (nearest.signed_distance(p, t, levels=2), nearest.ray_parity(p, t)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_build_dense_and_sparse(spark):
    v, f = sphere_mesh(6, 8)
    vs, fs = mesh_frames(spark, v, f)
    t = mesh.triangles(vs, fs).cache()
    p = build.BuildParams(target=12, max_res=16, block_dim=4, band=0.05, halo=1, levels=2)
    spec = build.field_specs(vs, p).cache()
    r = spec.first()
    diag = 2 * math.sqrt(3)
    assert r.voxx == pytest.approx((2 + 2 * 0.1 * math.dist(v.min(0), v.max(0))) / 12, rel=1e-2) and (r.dimx, r.dimz) == (16, 16) and diag > 0
    d = build.build_dense(t, spec, p).toPandas().set_index(["i", "j", "k"]).sort_index()
    assert len(d) == 16**3
    rng = np.random.default_rng(0)
    h, lo = r.voxx, np.array([r.bminx, r.bminy, r.bminz])
    for i, j, k in rng.integers(0, 16, (60, 3)):
        x = lo + (np.array([i, j, k]) + 0.5) * h
        s, tri, _ = signed(x, v, f)
        row = d.loc[(i, j, k)]
        assert row.phi == pytest.approx(s, abs=1e-9)
        near = lambda a, n: d.loc[tuple(np.clip(np.array([i, j, k]) + np.eye(3, dtype=int)[a] * n, 0, 15))]
        hxy = (near(0, 1).ny - near(0, -1).ny) / (2 * h)
        hyx = (near(1, 1).nx - near(1, -1).nx) / (2 * h)
        assert row.hxy == pytest.approx((hxy + hyx) / 2, abs=1e-9)
    s = build.build_sparse(t, spec, p).toPandas().set_index(["i", "j", "k"])
    assert 0 < len(s) < len(d)
    j = s.join(d, rsuffix="_d")
    assert (j.phi - j.phi_d).abs().max() < 1e-6 and (j.nz - j.nz_d).abs().max() < 1e-6
    blocks = set(zip(s.bi, s.bj, s.bk))
    for bi in range(4):
        for bj in range(4):
            for bk in range(4):
                c = lo + (np.array([bi, bj, bk]) * 4 + 2) * h
                keep = abs(signed(c, v, f)[0]) <= 0.05 + h + 0.5 * math.sqrt(3) * 4 * h
                assert ((bi, bj, bk) in blocks) == keep


def fnv(n):
    h = 2166136261
    for c in n:
        q = int(math.copysign(math.floor(abs(max(-1, min(1, c)) * 4095) + 0.5), c))
        h = ((h ^ (q & 0xFFFFFFFF)) * 16777619) & 0xFFFFFFFF
    return 1 + (h & 0x3FFFFFFF)


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("tiles", [True, False])
def test_build_candidates(spark, sparse, tiles):
    v = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0.5, 0, 0.5], [0.5, 1, 0.5]], float)
    f = np.array([[0, 1, 2], [0, 2, 3], [0, 1, 4], [3, 5, 2], [0, 4, 5], [0, 5, 3], [1, 2, 5], [1, 5, 4]])
    vs, fs = mesh_frames(spark, v, f)
    t = mesh.triangles(vs, fs)
    p = build.BuildParams(target=8, max_res=8, block_dim=2 if sparse else 4, tile=4, tiles=tiles, levels=1 + tiles, store_hessian=False, band=0.02, halo=0, tolerance=0.1)
    spec = build.field_specs(vs, p, "candidates")
    vox, cand = build.build_candidates(t, spec, p, sparse)
    got = {}
    for r in cand.orderBy("rank").collect():
        got.setdefault((r.i, r.j, r.k), []).append((r.phi, r.branch_id))
    s = spec.first()
    h, lo = s.voxx, np.array([s.bminx, s.bminy, s.bminz])
    a, b, c = (v[f[:, q]] for q in range(3))
    n = np.cross(b - a, c - a)
    n /= np.linalg.norm(n, axis=1)[:, None]
    tol, cos = 0.1, math.cos(math.radians(5))
    grow = max(0.02 if sparse else 0.0, tol + 2 * h) + h * (math.sqrt(3) / 2 * 4 + 1)
    corners = np.stack([a, b, c])
    ends = [np.clip(f((w + s * grow - lo) / h - 0.5), 0, 7) // 4 for f, s, w in ((np.floor, -1, corners.min(0)), (np.ceil, 1, corners.max(0)))]
    if not sparse:
        assert len(got) == 512
    elif not tiles:
        near = {b3 for b3 in np.ndindex(4, 4, 4) if abs(signed(lo + (np.array(b3) * 2 + 1) * h, v, f)[0]) <= 0.02 + math.sqrt(3) / 2 * 2 * h}
        assert {(i // 2, j // 2, k // 2) for i, j, k in got} == near and len(got) == 8 * len(near) and 0 < len(near) < 64
    for (i, j, k), rows in got.items():
        x = lo + (np.array([i, j, k]) + 0.5) * h
        q, d2 = closest(x, a, b, c)
        dist = np.sqrt(d2)
        here = np.array([i, j, k]) // 4
        filed = ((ends[0] <= here) & (here <= ends[1])).all(1) | (not tiles)
        if not filed.any():
            filed[dist.argmin()] = True
        kept = []
        for m in np.flatnonzero(filed):
            if dist[m] > dist[filed].min() + tol:
                continue
            e = (float((x - q[m]) @ n[m]), n[m])
            for z, o in enumerate(kept):
                if o[1] @ e[1] >= cos:
                    if abs(e[0]) < abs(o[0]):
                        kept[z] = e
                    break
            else:
                kept.append(e)
        want = sorted(abs(e[0]) for e in kept)[:4]
        assert np.allclose([abs(r[0]) for r in rows], want, atol=1e-6 if sparse else 1e-9)
        assert {r[1] for r in rows} <= {fnv(e[1]) for e in kept}
    assert vox.count() == len(got)


def plane_field(spark, n=8, fn=lambda x, y, z: 0.6 * x + 0.8 * z - 0.1, normal=(0.6, 0.0, 0.8)):
    rows = []
    for i in range(n):
        for j in range(n):
            for k in range(n):
                x, y, z = ((q + 0.5) * 0.25 - 1 for q in (i, j, k))
                rows.append(("p", i, j, k, fn(x, y, z), *normal, *[0.0] * 6))
    vox = spark.createDataFrame(rows, "field_id string, i long, j long, k long, phi double, nx double, ny double, nz double, hxx double, hxy double, hxz double, hyy double, hyz double, hzz double")
    fields = spark.createDataFrame([("p", *[-1.0] * 3, *[1.0] * 3, *[0.25] * 3, n, n, n, 0)], "field_id string, bminx double, bminy double, bminz double, bmaxx double, bmaxy double, bmaxz double, voxx double, voxy double, voxz double, dimx int, dimy int, dimz int, stride int")
    return fields, vox


@pytest.mark.parametrize("mode", ["first", "second", "trilinear", "tricubic", "candidates"])
def test_modes_are_exact_on_a_plane(spark, mode):
    fields, vox = plane_field(spark)
    p = np.random.default_rng(3).uniform(-1.1, 1.1, (300, 3))
    pts = pts_frame(spark, p, "p").withColumnRenamed("mesh_id", "field_id")
    none = spark.createDataFrame([], "field_id string, i long, j long, k long, rank int, phi double, nx double, ny double, nz double, branch_id long")
    r = Q.query(pts, fields, vox, mode, candidates=none).toPandas().set_index("qid")
    assert len(r) == 300
    for i, x in enumerate(p):
        u = (x + 1) / 0.25 - 0.5
        if mode in ("first", "second"):
            idx = np.sign(u) * np.floor(np.abs(u) + 0.5)
            ok = bool(((idx >= 0) & (idx < 8)).all())
        else:
            ok = bool(((np.floor(u) >= 0) & (np.floor(u) + 1 < 8)).all())
        assert r.loc[i].valid == ok
        if ok:
            assert r.loc[i].gap == pytest.approx(0.6 * x[0] + 0.8 * x[2] - 0.1, abs=1e-12)
            assert (r.loc[i].nx, r.loc[i].nz) == (pytest.approx(0.6), pytest.approx(0.8))
        else:
            assert np.isnan(r.loc[i].gap)


def test_box_joins_against_brute_force(spark):
    rng = np.random.default_rng(5)
    lo = rng.uniform(-2, 2, (120, 3))
    size = 10 ** rng.uniform(-6, 0.5, (120, 3))
    size[:3] = 0.0
    size[3] = 2.0
    lo[3] = -2.0
    hi = lo + size
    # a hot bin: a third of all boxes share one spot
    lo[80:] = 0.25
    hi[80:] = 0.25 + size[80:] * 1e-3
    cols = "id long, lx double, ly double, lz double, hx double, hy double, hz double"
    A = spark.createDataFrame([(i, *map(float, lo[i]), *map(float, hi[i])) for i in range(120)], cols)
    B = A.withColumnsRenamed({c: f"b{c}" for c in A.columns})
    v = lambda q: [F.col(f"{q}{a}") for a in AXES]
    got = {tuple(r) for r in bins.overlapping_boxes(A, B, [], v("l"), v("h"), v("bl"), v("bh")).select("id", "bid").collect()}
    all_rows = bins.overlapping_boxes(A, B, [], v("l"), v("h"), v("bl"), v("bh")).count()
    want = {(i, j) for i in range(120) for j in range(120) if ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all()}
    assert got == want and all_rows == len(want)
    p = np.vstack([rng.uniform(-2, 2, (200, 3)), lo[:20], hi[:20]])
    P = pts_frame(spark, p).drop("mesh_id")
    got = {tuple(r) for r in bins.points_in_boxes(P, A, [], list(V3.of()), v("l"), v("h")).select("qid", "id").collect()}
    assert got == {(i, j) for i in range(len(p)) for j in range(120) if ((p[i] >= lo[j]) & (p[i] <= hi[j])).all()}
    C = A.select("id", "lx", "ly", "lz", (F.pmod("id", F.lit(7)) * 0.1).alias("rad"))
    got = {tuple(r) for r in bins.points_within(P, C, [], V3.of(), V3.of("l"), F.col("rad")).select("qid", "id").collect()}
    assert got == {(i, j) for i in range(len(p)) for j in range(120) if ((p[i] - lo[j]) ** 2).sum() <= (j % 7 * 0.1) ** 2}


def test_running_equals_plain_window(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(t), None if rng.random() < 0.4 else float(rng.integers(0, 9)), bool(rng.random() < 0.5), bool(rng.random() < 0.1)) for k in range(3) for t in np.unique(rng.integers(0, 400, 90))]
    d = spark.createDataFrame(rows, "k int, t double, v double, f boolean, r boolean")
    out = ordered.running(
        d, ["k"], ["t"], ordered.bucket_of("t", 17.0), prev={"p": F.col("v")}, last={"l": F.col("v")}, before={"b": F.col("v")},
        following={"n": F.col("v")}, sums={"s": F.lit(1)}, mins={"m": F.col("v")}, since={"c": (F.col("f"), F.col("r"))},
    ).orderBy("k", "t").collect()
    for k in range(3):
        seq = [r for r in rows if r[0] == k]
        got = [r for r in out if r.k == k]
        c = 0
        for i, (r, g) in enumerate(zip(seq, got)):
            past = [x[2] for x in seq[: i + 1] if x[2] is not None]
            before = [x[2] for x in seq[:i] if x[2] is not None]
            after = [x[2] for x in seq[i:] if x[2] is not None]
            c = 0 if r[4] else c + int(r[3])
            assert g.p == (seq[i - 1][2] if i else None) and g.l == (past[-1] if past else None)
            assert g.b == (before[-1] if before else None) and g.n == (after[0] if after else None)
            assert g.s == i + 1 and g.m == (min(past) if past else None) and g.c == c
    assert ordered.suggest_width(d, ["k"], "t", 30) < 400


def test_phases_in_batch_and_in_pieces(spark):
    """The batch form, and the stream's step over random cuts of the same series, give the same rows."""
    from gapfield.streaming.phases import START, step

    rng = np.random.default_rng(11)
    P = phases.PhaseParams()
    rows = []
    for r in range(6):
        for i in range(150):
            g = float(rng.choice([-2e-6, -1.01e-6, -1e-6, 0.0, 2e-5, 3e-5])) if r % 2 else float(rng.choice([-1e-6, 2e-5]) if (i // 9) % 3 else -1e-6)
            rows.append((r, 1, i * 0.1, g, max(0.0, -g), int(g < 0), float(rng.choice([0.0, 1e-6, -2e-5, 0.0]))))
    m = spark.createDataFrame(rows, "run_id int, cp_id int, t double, gap double, penetration double, active_count int, normal_velocity double")
    out = phases.phases(m, ordered.bucket_of("t", 2.0)).orderBy("run_id", "t").collect()
    assert {r.phase for r in out} == {"INACTIVE", "IMPACTING", "ACTIVE", "STABLE", "LEAVING"}
    for r in range(6):
        own = pd.DataFrame([x.asDict() for x in out if x.run_id == r])
        cuts = [0, *sorted(rng.choice(np.arange(1, len(own)), 12, replace=False)), len(own)]
        carry, parts = START, []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            got, carry = step(own.iloc[lo:hi], carry, P)
            parts.append(got)
        got = pd.concat(parts)
        for c in ("phase", "stable_count", "release_count"):
            assert got[c].tolist() == own[c].tolist()


def test_alignment_equals_numpy(spark):
    rng = np.random.default_rng(4)
    ref = [(float(t), float(rng.random())) for t in np.arange(-5, 60, 0.7)]
    own = [(float(t), float(rng.random())) for t in np.unique(np.r_[rng.uniform(0, 50, 40), ref[20][0]])]
    mk = lambda x: spark.createDataFrame([("s", *r) for r in x], "k string, t double, value double")
    got = signals.align(mk(ref), mk(own), ["k"], ordered.bucket_of("t", 4.0)).orderBy("t").collect()
    want = np.interp([r[0] for r in ref], [r[0] for r in own], [r[1] for r in own])
    assert np.allclose([r.own for r in got], want, atol=1e-12)
    const = mk([(t, 1.0) for t, _ in ref])
    e = signals.signal_error(signals.align(const, mk(own), ["k"], ordered.bucket_of("t", 4.0)), ["k"]).first()
    assert e.normalized_rmse == 0.0 and e.num_points == len(ref)
    missing = signals.report(mk(ref).withColumn("k", F.lit("other")), mk(own), ["k"], ordered.bucket_of("t", 4.0))
    assert missing.count() == 0


@pytest.mark.parametrize("n_rad,err", [(40, 8.2e-6), (20, 3.3e-5)])
def test_torsion_closed_form(spark, n_rad, err):
    p = shapes.annular_points(spark, 0.4, 0.6, n_rad, 128)
    p = p.withColumns({"label": F.lit("a"), "depth": F.lit(0.002), "spin": F.lit(1.0), "mu": F.lit(0.5), "k": F.lit(1e6), "ri": F.lit(0.4), "ro": F.lit(0.6)})
    d = contact.torsion_diagnostics(contact.point_forces(evaluate.torsion_points(p), "linear")).first()
    assert d.torque_error == pytest.approx(err, rel=0.02)
    assert d.normal_force == pytest.approx(1256.637, rel=1e-6) and d.radius_exact == pytest.approx(0.506667, rel=1e-5)
    assert d.torque_exact == pytest.approx(-318.348, rel=1e-5) and d.tangential_ratio < 1e-12 and d.n_points == n_rad * 128


def test_torsion_on_a_stored_field(spark):
    fields, vox = plane_field(spark, 8, lambda x, y, z: z, (0.0, 0.0, 1.0))
    p = shapes.annular_points(spark, 0.4, 0.6, 20, 64)
    p = p.withColumns({"label": F.lit("sdf_res8"), "field_id": F.lit("p"), "depth": F.lit(0.002), "spin": F.lit(1.0), "mu": F.lit(0.5), "k": F.lit(1e6), "ri": F.lit(0.4), "ro": F.lit(0.6)})
    q = evaluate.sweep_contacts(p, fields, Q.cell_table(vox, cubic=False))
    d = contact.torsion_diagnostics(contact.point_forces(q, "linear")).first()
    assert d.torque_error < 1e-4 and d.balance_error == 0.0


def test_rotations(spark):
    d = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("a", 0.3), ("b", 1.1), ("c", -0.7))])
    r = pose.euler313(F.col("a"), F.col("b"), F.col("c"))
    eye = r @ r.t
    e = pose.exp_map(pose.log_map(r))
    row = d.select(*[c.alias(f"i{n}") for n, c in eye.named("").items()], *[c.alias(f"e{n}") for n, c in e.named("").items()], *[c.alias(f"r{n}") for n, c in r.named("").items()]).first()
    for x in range(3):
        for y in range(3):
            assert row[f"i{x}{y}"] == pytest.approx(float(x == y), abs=1e-12)
            assert row[f"e{x}{y}"] == pytest.approx(row[f"r{x}{y}"], abs=1e-12)


def test_laws(spark):
    d = spark.createDataFrame([(-0.1,), (0.2,)], "g double")
    g = F.col("g")
    r = d.select(law.pressure(g, 10.0, 0.05).alias("p"), law.pressure_pow(g, 10.0, 2).alias("q"), *law.friction(V3(3.0, 4.0, 0.0), F.lit(2.0), 0.5).cols("f"), *law.friction(V3(0.0, 0.0, 0.0), F.lit(2.0), 0.5).cols("z")).collect()
    assert (r[0].p, r[0].q, r[1].p, r[1].q) == (pytest.approx(1.5), pytest.approx(0.1), 0.0, 0.0)
    assert (r[0].fx, r[0].fy, r[0].zx) == (pytest.approx(-0.6), pytest.approx(-0.8), 0.0)


def test_components_and_merge(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(99)] + [(150, x) for x in range(151, 190)], "a long, b long")
    c = {r.node: r.component for r in model.connected_components(nodes, edges).collect()}
    assert all(c[i] == 0 for i in range(100)) and all(c[i] == 150 for i in range(150, 190)) and c[120] == 120

    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    rz = [0.0, -1.0, 0, 1.0, 0.0, 0, 0, 0, 1.0]
    names = lambda q: ", ".join(f"{q}{r}{k} double" for r in range(3) for k in range(3))
    f = lambda m: [float(x) for x in m]
    bodies = spark.createDataFrame(
        [("m", 1, "a", 2.0, False, 0.0, 0.0, 0.0, *f(eye), *f(eye)), ("m", 2, "b", 1.0, False, 3.0, 0.0, 0.0, *f(rz), *f(eye)), ("m", 3, "c", 5.0, False, 9.0, 0.0, 0.0, *f(eye), *f(eye))],
        f"file string, body_id long, name string, mass double, fixed boolean, rx double, ry double, rz double, {names('r')}, {names('i')}",
    )
    frames = spark.createDataFrame(
        [("m", 10, "f", 1, 0.0, 0.0, 0.0, *f(eye)), ("m", 20, "g", 2, 1.0, 0.0, 0.0, *f(eye)), ("m", 30, "h", 3, 0.5, 0.0, 0.0, *f(eye))],
        f"file string, frame_id long, name string, body_id long, px double, py double, pz double, {names('o')}",
    )
    joints = spark.createDataFrame([("m", 1, "j", "FIXED", 10, 20, "z"), ("m", 2, "k", "REVOLUTE", 20, 30, "z")], "file string, joint_id long, name string, type string, frame_i long, frame_j long, axis string")
    cts = spark.createDataFrame([("m", 1, 2, 3)], "file string, cp_id long, body_a long, body_b long")
    sfs = spark.createDataFrame([("m", 1, 2)], "file string, surface_id long, body_id long")
    m = model.merge_fixed({"bodies": bodies, "frames": frames, "joints": joints, "contacts": cts, "surfaces": sfs})
    b = {r.body_id: r for r in m["bodies"].collect()}
    assert set(b) == {1, 3} and (b[1].mass, b[1].rx) == (3.0, pytest.approx(1.0)) and b[3].mass == 5.0
    # two unit inertias plus m d^2 of both about the common centre
    assert b[1].i11 == pytest.approx(2.0 + 2.0 * 1.0 + 1.0 * 4.0) and b[1].i00 == pytest.approx(2.0)
    fr = {r.frame_id: r for r in m["frames"].collect()}
    # the marker of body 2 sits at (3,0,0) + Rz(90) (1,0,0) = (3,1,0), seen from the centre (1,0,0)
    assert (fr[20].body_id, fr[20].px, fr[20].py) == (1, pytest.approx(2.0), pytest.approx(1.0)) and fr[20].o10 == pytest.approx(1.0)
    assert (fr[10].px, fr[30].px) == (pytest.approx(-1.0), 0.5)
    assert [r.joint_id for r in m["joints"].collect()] == [2]
    assert m["contacts"].first().body_a == 1 and m["surfaces"].first().body_id == 1


def test_frames_in_contact_evaluation(spark):
    """Markers move the points: the same world geometry through frames and without gives one wrench."""
    fields, vox = plane_field(spark, 8, lambda x, y, z: z, (0.0, 0.0, 1.0))
    cells = Q.cell_table(vox, cubic=False)
    q = shapes.square_points(spark, 0.3, 6).withColumn("mesh_id", F.lit("s"))
    rot = {f"r{r}{c}": F.lit(float(r == c)) for r in range(3) for c in range(3)}
    vel = {f"{v}{a}": F.lit(0.1 if v == "v" else 0.2) for v in "vo" for a in AXES}
    poses = spark.createDataFrame([("r", 0.0, 1, 0.05, 0.0, -0.01), ("r", 0.0, 2, 0.0, 0.0, 0.0), ("r", 1.0, 1, 0.05, 0.0, 5.0), ("r", 1.0, 2, 0.0, 0.0, 0.0)], "run_id string, t double, body_id long, rx double, ry double, rz double").withColumns({**rot, **vel})
    base = dict(mesh_id="s", field_id="p", k=1e5, mu=0.3, k_order=1.0, damping=10.0, regularizer=1e-4)
    ct = spark.range(1).select(F.lit(7).alias("cp_id"), F.lit(1).cast("long").alias("body_a"), F.lit(2).cast("long").alias("body_b"), *[F.lit(v).alias(n) for n, v in base.items()])
    w0 = evaluate.evaluate_contacts(poses, ct, q, fields, cells).orderBy("t").collect()
    # at t = 1 the boxes are apart, which is a zero row
    assert len(w0) == 2 and w0[0].fz > 0 and all(w0[1][c] == 0 for c in contact.WRENCH)
    ori = {f"o{r}{c}": F.lit(float(r == c)) for r in range(3) for c in range(3)}
    frames = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.0), (2, 2, 0.0, 0.0, 0.0)], "frame_id long, body_id long, px double, py double, pz double").withColumns(ori)
    ct2 = ct.withColumns({"action_frame": F.lit(1).cast("long"), "base_frame": F.lit(2).cast("long")})
    moved = q.withColumns({"x": F.col("x") - 0.1, "y": F.col("y") - 0.2})
    w1 = evaluate.evaluate_contacts(poses, ct2, moved, fields, cells, frames=frames).orderBy("t").first()
    for c in contact.WRENCH:
        assert w1[c] == pytest.approx(w0[0][c], rel=1e-9, abs=1e-9)
    assert (w1.fx + w1.fbx, w1.fz + w1.fbz) == (0.0, 0.0)


def test_matrix_helpers(spark):
    m = M3([[1, 2, 3], [4, 5, 6], [7, 8, 10]])
    r = spark.range(1).select((m @ V3(1.0, 0.0, -1.0)).x.alias("a"), m.trace().alias("t"), V3(1, 2, 3).cross(V3(0, 1, 0)).z.alias("c")).first()
    assert (r.a, r.t, r.c) == (-2.0, 16.0, 1.0)


def test_sector_merge_over_many_batches(spark):
    """A voxel that spans batches is merged like one in a single batch."""
    rng = np.random.default_rng(5)
    rows = []
    for g, n in enumerate([1, 700, 3, 40, 40, 1, 2500]):
        for t in range(n):
            x = rng.normal(size=3) * [1, 1, 0.05 if g == 6 else 1]
            rows.append((g % 3, g, t, float(rng.random() / 2), 0.6, *map(float, [rng.normal(), *x / np.linalg.norm(x), 0, 0, t])))
    names = "field_id int, i int, tri_id int, dist double, tol double, " + ", ".join(f"{v} double" for v in sectors.VALUES)
    df = spark.createDataFrame(rows, names)
    cos = math.cos(math.radians(5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = sectors.merged(df.repartition(5), ("field_id", "i"), "tri_id", "tol", cos, 6).orderBy("i", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(7):
        kept = []
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: r[2]):
            for z, o in enumerate(kept):
                if np.dot(o[6:9], r[6:9]) >= cos:
                    if abs(r[5]) < abs(o[5]):
                        kept[z] = r
                    break
            else:
                kept.append(r)
        want = sorted(kept, key=lambda r: abs(r[5]))[:6]
        assert [(r.rank, r.phi, r.wz) for r in got if r.i == g] == [(k, r[5], r[11]) for k, r in enumerate(want)]
    assert sectors.merged(df.where("false"), ("field_id", "i"), "tri_id", "tol", cos, 6).count() == 0


def test_phases_of_many_contacts_equal_those_of_each():
    """Contacts stepped side by side, in two parts, as one by one in one."""
    from gapfield.streaming.phases import START, step, steps

    rng = np.random.default_rng(9)
    p = phases.PhaseParams(stable_steps=2, release_steps=2)
    parts = []
    for _ in range(12):
        n = int(rng.integers(1, 30))
        gap = rng.choice([-0.2, -0.2, 0.0, 1e-6, 0.3], n)
        parts.append(pd.DataFrame({"t": np.arange(n) * 1.0, "gap": gap, "penetration": np.maximum(0, -gap), "active_count": (gap < 0).astype(int), "normal_velocity": rng.choice([0.0, 1e-6, -1.0], n)}))
    want = [step(x, START, p) for x in parts]
    cut = [len(x) // 2 for x in parts]
    carries = {k: START for k in range(12)}
    got = {k: [] for k in range(12)}
    for half in (0, 1):
        own = [(k, x[: cut[k]] if half == 0 else x[cut[k] :]) for k, x in enumerate(parts)]
        own = [(k, x) for k, x in own if len(x)]
        starts = np.cumsum([0, *(len(x) for _, x in own)])[:-1]
        out, after = steps(pd.concat([x for _, x in own], ignore_index=True), starts, tuple(map(np.array, zip(*(carries[k] for k, _ in own)))), p)
        for (k, x), a in zip(own, starts):
            got[k].append(out.iloc[a : a + len(x)])
        for (k, _), c in zip(own, zip(*after)):
            carries[k] = tuple(v.item() for v in c)
    for k in range(12):
        a = pd.concat(got[k], ignore_index=True)
        assert a.equals(want[k][0].reset_index(drop=True)) and carries[k] == want[k][1]


def test_pairs_within_the_nearest_and_more(spark):
    v, f = sphere_mesh(6, 9)
    f = np.vstack([f, f[:4]])
    t = mesh.triangles(*mesh_frames(spark, v, f))
    p = np.random.default_rng(3).uniform(-1.5, 1.5, (60, 3))
    got = {}
    for r in nearest.triangles_within(pts_frame(spark, p), t, F.lit(0.2), levels=2).select("qid", "tri_id").collect():
        got.setdefault(r.qid, []).append(r.tri_id)
    a, b, c = (v[f[:, q]] for q in range(3))
    for i, x in enumerate(p):
        d = np.sqrt(closest(x, a, b, c)[1])
        assert set(np.flatnonzero(d <= d.min() + 0.2)) <= set(got[i]) and len(set(got[i])) == len(got[i])
    d = {r.qid: r.d2 for r in nearest.nearest_distance(pts_frame(spark, p), t, levels=2).collect()}
    assert all(d[i] == pytest.approx(closest(x, a, b, c)[1].min(), abs=1e-12) for i, x in enumerate(p))


def test_pairs_within_are_cut_before_copies_join(spark):
    v, f = sphere_mesh(6, 9)
    f = np.vstack([f, f[:4]])
    p = np.random.default_rng(4).uniform(-1.5, 1.5, (20, 3))
    got = nearest.triangles_within(pts_frame(spark, p), mesh.triangles(*mesh_frames(spark, v, f)), F.lit(0.2), levels=1).select("qid", "tri_id").collect()
    a, b, c = (v[f[:, q]] for q in range(3))
    far = [np.sqrt(closest(x, a, b, c)[1]) for x in p]
    # none is handed on that the tolerance would drop
    assert {(r.qid, r.tri_id) for r in got} == {(i, t) for i, d in enumerate(far) for t in np.flatnonzero(d <= d.min() + 0.2)}
