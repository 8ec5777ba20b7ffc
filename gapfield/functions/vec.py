"""Three-component vectors and 3x3 matrices built from flat double columns.

Everything here is a ``Column`` builder: nothing is evaluated in Python, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def solid(c: Column) -> Column:
    """The same value, typed as never NULL (a NULL becomes NaN).

    Join keys built from nullable columns get an inferred not-null filter, which is pushed
    down with the whole expression inlined; a non-null type needs no such filter.
    """
    return F.coalesce(c, F.lit(float("nan")))


def ratio(num, den, otherwise=None) -> Column:
    """Division that yields ``otherwise`` (NULL by default) when the divisor is zero."""
    out = F.try_divide(lit(num), lit(den))
    return out if otherwise is None else F.coalesce(out, lit(otherwise))


class V3:
    """A vector of three columns."""

    __slots__ = ("x", "y", "z")

    def __init__(self, x, y, z):
        self.x, self.y, self.z = lit(x), lit(y), lit(z)

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> "V3":
        return cls(*(F.col(f"{prefix}{a}{suffix}") for a in AXES))

    @classmethod
    def field(cls, struct: Column) -> "V3":
        return cls(*(struct[a] for a in AXES))

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def __add__(self, o: "V3") -> "V3":
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "V3") -> "V3":
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> "V3":
        s = lit(s)
        return V3(self.x * s, self.y * s, self.z * s)

    __rmul__ = __mul__

    def __neg__(self) -> "V3":
        return V3(-self.x, -self.y, -self.z)

    def times(self, o: "V3") -> "V3":
        """Component-wise product."""
        return V3(self.x * o.x, self.y * o.y, self.z * o.z)

    def dot(self, o: "V3") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "V3") -> "V3":
        return V3(
            self.y * o.z - self.z * o.y,
            self.z * o.x - self.x * o.z,
            self.x * o.y - self.y * o.x,
        )

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def over(self, s: Column, otherwise: "V3 | None" = None) -> "V3":
        if otherwise is None:
            return V3(*(ratio(c, s) for c in self))
        return V3(*(ratio(c, s, o) for c, o in zip(self, otherwise)))

    def named(self, prefix: str = "", suffix: str = "") -> dict[str, Column]:
        return {f"{prefix}{a}{suffix}": c for a, c in zip(AXES, self)}

    def cols(self, prefix: str = "") -> list[Column]:
        return [c.alias(n) for n, c in self.named(prefix).items()]

    def struct(self) -> Column:
        return F.struct(*self.cols())


def where(cond: Column, a: V3, b: V3) -> V3:
    return V3(*(F.when(cond, p).otherwise(q) for p, q in zip(a, b)))


def unit(v: V3, norm: Column, fallback: V3 | None = None, eps: float = 1e-15) -> V3:
    """``v / norm`` with a fallback vector, then the x axis.

    ``norm`` is passed in so that callers can project it once beforehand.
    """
    fb = fallback or V3(1.0, 0.0, 0.0)
    return V3(*(F.when(norm > eps, ratio(c, norm)).otherwise(o) for c, o in zip(v, fb)))


class M3:
    """A 3x3 matrix of nine columns in row-major order."""

    def __init__(self, rows):
        self.rows = [[lit(c) for c in r] for r in rows]

    @classmethod
    def of(cls, prefix: str) -> "M3":
        return cls([[F.col(f"{prefix}{r}{c}") for c in range(3)] for r in range(3)])

    @classmethod
    def eye(cls) -> "M3":
        return cls([[1.0 if r == c else 0.0 for c in range(3)] for r in range(3)])

    @property
    def t(self) -> "M3":
        return M3([[self.rows[c][r] for c in range(3)] for r in range(3)])

    def row(self, r: int) -> V3:
        return V3(*self.rows[r])

    def column(self, c: int) -> V3:
        return V3(*(self.rows[r][c] for r in range(3)))

    def __matmul__(self, o):
        if isinstance(o, V3):
            return V3(*(self.row(r).dot(o) for r in range(3)))
        return M3([[self.row(r).dot(o.column(c)) for c in range(3)] for r in range(3)])

    def abs(self) -> "M3":
        return M3([[F.abs(c) for c in r] for r in self.rows])

    def trace(self) -> Column:
        return self.rows[0][0] + self.rows[1][1] + self.rows[2][2]

    def named(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}{r}{c}": self.rows[r][c] for r in range(3) for c in range(3)}
