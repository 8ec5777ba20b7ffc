"""Rigid transforms, marker frames and rotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import M3, V3, ratio


def to_world(p: V3, r: V3, rot: M3) -> V3:
    return r + (rot @ p)


def to_local(p: V3, r: V3, rot: M3) -> V3:
    return rot.t @ (p - r)


def velocity_at(p: V3, r: V3, v: V3, omega: V3) -> V3:
    """Velocity of the body point that coincides with world point ``p``."""
    return v + omega.cross(p - r)


def frame_world(pos: V3, ori: M3, r: V3, rot: M3) -> tuple[V3, M3]:
    """World origin and rotation of a marker fixed to a body."""
    return to_world(pos, r, rot), rot @ ori


def relative(ra: V3, rota: M3, rb: V3, rotb: M3) -> tuple[V3, M3]:
    """Transform that maps coordinates of frame A into frame B."""
    return rotb.t @ (ra - rb), rotb.t @ rota


def euler313(psi: Column, theta: Column, phi: Column) -> M3:
    """Body-fixed 3-1-3 angles: Rz(psi) Rx(theta) Rz(phi)."""

    def rz(a):
        return M3([[F.cos(a), -F.sin(a), 0.0], [F.sin(a), F.cos(a), 0.0], [0.0, 0.0, 1.0]])

    rx = M3(
        [[1.0, 0.0, 0.0], [0.0, F.cos(theta), -F.sin(theta)], [0.0, F.sin(theta), F.cos(theta)]]
    )
    return rz(psi) @ rx @ rz(phi)


def exp_map(v: V3) -> M3:
    """Rotation matrix of an axis-angle vector; identity for a vanishing angle."""
    ang = v.norm()
    tiny = ang < 1e-30
    k = V3(*(F.when(tiny, F.lit(0.0)).otherwise(ratio(c, ang)) for c in v))
    s = F.when(tiny, F.lit(0.0)).otherwise(F.sin(ang))
    c1 = F.when(tiny, F.lit(0.0)).otherwise(1.0 - F.cos(ang))
    skew = [[0.0, -k.z, k.y], [k.z, 0.0, -k.x], [-k.y, k.x, 0.0]]
    skew_m = M3(skew)
    sq = skew_m @ skew_m
    eye = M3.eye()
    return M3(
        [
            [eye.rows[r][c] + s * skew_m.rows[r][c] + c1 * sq.rows[r][c] for c in range(3)]
            for r in range(3)
        ]
    )


def log_map(rot: M3) -> V3:
    """Axis-angle vector of a rotation matrix."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (rot.trace() - 1.0) / 2.0))
    ang = F.acos(cosine)
    scale = F.when(ang < 1e-10, F.lit(0.0)).otherwise(ratio(ang, 2.0 * F.sin(ang), 0.0))
    m = rot.rows
    return V3(m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]) * scale


def joint_angle(rot_i: M3, rot_j: M3) -> Column:
    """Angle of frame J's x axis seen from frame I: ``atan2(xi.yj, xi.xj)``."""
    xi = rot_i.column(0)
    return F.atan2(xi.dot(rot_j.column(1)), xi.dot(rot_j.column(0)))
