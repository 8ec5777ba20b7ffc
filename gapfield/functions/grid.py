"""Cell-centred grid arithmetic.

A grid is described by the columns of a ``fields`` row: ``bminx..bminz``,
``bmaxx..bmaxz``, ``voxx..voxz`` and the dimensions ``dimx dimy dimz``. Indices are
``i j k``; the linear index is a bigint, so 2048^3 does not overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V3

IJK = ("i", "j", "k")
DIMS = ("dimx", "dimy", "dimz")

# The ladder of allowed dimensions.
LADDER = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)

BLOCK_BITS = 21


def bmin() -> V3:
    return V3.of("bmin")


def voxel() -> V3:
    return V3.of("vox")


def center(i=None, j=None, k=None) -> V3:
    """Centre of voxel (i, j, k): ``bmin + (index + 0.5) * voxel``."""
    idx = [F.col(n) if c is None else c for n, c in zip(IJK, (i, j, k))]
    return V3(*(b + (c + F.lit(0.5)) * v for b, c, v in zip(bmin(), idx, voxel())))


def coordinate(p: V3) -> V3:
    """Continuous index of a point: 0 at the centre of voxel 0."""
    return V3(*((c - b) / v - F.lit(0.5) for c, b, v in zip(p, bmin(), voxel())))


def nearest_index(p: V3) -> list[Column]:
    """Rounded index, half away from zero."""
    return [F.round(c).cast("bigint") for c in coordinate(p)]


def cell(u: V3) -> list[Column]:
    """Lower corner index of the interpolation cell from :func:`coordinate` columns."""
    return [F.floor(c).cast("bigint") for c in u]


def in_bounds(idx: list[Column], margin: int = 0) -> Column:
    """Index inside the grid; ``margin=1`` asks for a full cell."""
    out = F.lit(True)
    for c, d in zip(idx, DIMS):
        out = out & (c >= 0) & (c + margin < F.col(d))
    return out


def lin(i: Column, j: Column, k: Column) -> Column:
    """Linear index, x fastest."""
    b = [c.cast("bigint") for c in (i, j, k)]
    return b[0] + F.col("dimx").cast("bigint") * (b[1] + F.col("dimy").cast("bigint") * b[2])


def from_lin(n: Column) -> list[Column]:
    nx, ny = F.col("dimx").cast("bigint"), F.col("dimy").cast("bigint")
    row = F.floor(n / nx).cast("bigint")
    return [F.pmod(n, nx), F.pmod(row, ny), F.floor(row / ny).cast("bigint")]


def block(idx: list[Column], dim) -> list[Column]:
    d = dim if isinstance(dim, Column) else F.lit(dim)
    return [F.floor(c / d).cast("bigint") for c in idx]


def block_local(idx: list[Column], dim) -> list[Column]:
    d = dim if isinstance(dim, Column) else F.lit(dim)
    return [F.pmod(c.cast("bigint"), d.cast("bigint")) for c in idx]


def local_index(loc: list[Column], dim) -> Column:
    d = (dim if isinstance(dim, Column) else F.lit(dim)).cast("bigint")
    return loc[0] + d * (loc[1] + d * loc[2])


def block_key(b: list[Column]) -> Column:
    """One bigint per block: three 21-bit fields, z highest."""
    mask = F.lit((1 << BLOCK_BITS) - 1).cast("bigint")
    low = [c.cast("bigint").bitwiseAND(mask) for c in b]
    return (
        F.shiftleft(low[2], 2 * BLOCK_BITS)
        .bitwiseOR(F.shiftleft(low[1], BLOCK_BITS))
        .bitwiseOR(low[0])
    )


def snap_resolution(n: Column, max_res) -> Column:
    """Smallest ladder step that holds ``n``, never above ``max_res``."""
    cap = (max_res if isinstance(max_res, Column) else F.lit(max_res)).cast("bigint")
    out = F.lit(LADDER[-1]).cast("bigint")
    for step in reversed(LADDER[:-1]):
        out = F.when(n <= step, F.lit(step).cast("bigint")).otherwise(out)
    return F.least(out, cap)


def on_ladder(n: Column) -> Column:
    return n.isin(*LADDER)
