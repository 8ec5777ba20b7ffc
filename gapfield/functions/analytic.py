"""Closed forms used as yardsticks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V3, lit, ratio


def plane_gap(p: V3, z_top=0.0) -> Column:
    return p.z - lit(z_top)


def annulus_normal_force(k, depth, ri, ro) -> Column:
    ri, ro = lit(ri), lit(ro)
    return lit(k) * lit(depth) * F.lit(math.pi) * (ro * ro - ri * ri)


def annulus_radius(ri, ro) -> Column:
    """Equivalent friction radius ``2/3 (ro^3 - ri^3)/(ro^2 - ri^2)``; ``ri`` for a zero-width ring."""
    ri, ro = lit(ri), lit(ro)
    r3 = ro * ro * ro - ri * ri * ri
    r2 = ro * ro - ri * ri
    return F.when(F.abs(r2) <= 1e-30, ri).otherwise(F.lit(2.0 / 3.0) * ratio(r3, r2))


def torsion_torque(mu, normal, radius, spin=1.0) -> Column:
    """Torque that opposes the spin: ``-mu * N * R * sign(spin)``."""
    return -lit(mu) * lit(normal) * lit(radius) * F.signum(lit(spin))


def effective_radius(torque, mu, force) -> Column:
    return ratio(torque, lit(mu) * lit(force))
