"""Plain NumPy versions of the geometry, used only by tests."""

import math

import numpy as np

RAW = np.array([1.0, 0.3713906763541037, 0.52999894000318])
RAY = RAW / np.linalg.norm(RAW)


def segment(p, a, b):
    d = b - a
    n = (d * d).sum(-1)
    t = np.clip(((p - a) * d).sum(-1) / np.where(n == 0, 1, n), 0, 1)
    return a + t[..., None] * d


def closest(p, a, b, c):
    """Closest points of one point to many triangles."""
    cand = [segment(p, a, b), segment(p, b, c), segment(p, c, a)]
    n = np.cross(b - a, c - a)
    nn = (n * n).sum(-1)
    safe = np.where(nn == 0, 1, nn)
    q = p - (((p - a) * n).sum(-1) / safe)[:, None] * n
    inside = nn > 0
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, q - u) * n).sum(-1) >= 0
    best = cand[0]
    bd = ((best - p) ** 2).sum(-1)
    for x in cand[1:]:
        d = ((x - p) ** 2).sum(-1)
        best = np.where((d < bd)[:, None], x, best)
        bd = np.minimum(d, bd)
    best = np.where(inside[:, None], q, best)
    return best, ((best - p) ** 2).sum(-1)


def hits(p, a, b, c, eps=1e-12):
    u, w = b - a, c - a
    pv = np.cross(RAY, w)
    det = (u * pv).sum(-1)
    ok = np.abs(det) >= eps
    inv = 1 / np.where(ok, det, 1)
    s = p - a
    bu = (s * pv).sum(-1) * inv
    q = np.cross(s, u)
    bv = (RAY * q).sum(-1) * inv
    t = (w * q).sum(-1) * inv
    return int((ok & (bu >= -eps) & (bu <= 1 + eps) & (bv >= -eps) & (bu + bv <= 1 + eps) & (t > eps)).sum())


def sphere_mesh(n_lat=8, n_lon=12, r=1.0):
    """Vertices and faces of a closed triangulated sphere."""
    v = [(0, 0, r)]
    for i in range(1, n_lat):
        th = math.pi * i / n_lat
        for j in range(n_lon):
            ph = 2 * math.pi * (j + 0.37) / n_lon
            v.append((r * math.sin(th) * math.cos(ph), r * math.sin(th) * math.sin(ph), r * math.cos(th)))
    v.append((0, 0, -r))
    f = []
    row = lambda i, j: 1 + (i - 1) * n_lon + j % n_lon
    for j in range(n_lon):
        f.append((0, row(1, j), row(1, j + 1)))
        f.append((len(v) - 1, row(n_lat - 1, j + 1), row(n_lat - 1, j)))
        for i in range(1, n_lat - 1):
            f.append((row(i, j), row(i + 1, j), row(i + 1, j + 1)))
            f.append((row(i, j), row(i + 1, j + 1), row(i, j + 1)))
    return np.array(v, float), np.array(f)


def mesh_frames(spark, v, f, mesh_id="m"):
    vs = spark.createDataFrame([(mesh_id, i, *map(float, p)) for i, p in enumerate(v)], "mesh_id string, vid long, x double, y double, z double")
    fs = spark.createDataFrame([(mesh_id, i, *map(int, t)) for i, t in enumerate(f)], "mesh_id string, tri_id long, v0 long, v1 long, v2 long")
    return vs, fs


def signed(p, v, f):
    a, b, c = (v[f[:, k]] for k in range(3))
    q, d2 = closest(p, a, b, c)
    i = int(np.argmin(d2))
    n = hits(p, a, b, c)
    if n:
        s = -1.0 if n % 2 else 1.0
    else:
        s = -1.0 if (p - q[i]) @ np.cross(b[i] - a[i], c[i] - a[i]) < 0 else 1.0
    return s * math.sqrt(d2[i]), i, n
