"""Time functions, their derivatives, and the drive expressions of model files."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("constant", "linear", "sine", "cosine")


def _case(kind: Column, **by_kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, expr in by_kind.items():
        out = F.when(kind == name, expr).otherwise(out)
    return out


def _cols():
    return (F.col(c) for c in ("kind", "a", "b", "omega", "phase"))


def value(t: Column) -> Column:
    """Value at ``t`` of the function row ``kind, a, b, omega, phase``.

    constant ``a``; linear ``a + b*t``; sine and cosine ``a * f(omega*t + phase)``.
    """
    kind, a, b, om, ph = _cols()
    arg = om * t + ph
    return _case(kind, constant=a, linear=a + b * t, sine=a * F.sin(arg), cosine=a * F.cos(arg))


def d1(t: Column) -> Column:
    kind, a, b, om, ph = _cols()
    arg = om * t + ph
    return _case(
        kind, constant=F.lit(0.0), linear=b, sine=a * om * F.cos(arg), cosine=-a * om * F.sin(arg)
    )


def d2(t: Column) -> Column:
    kind, a, b, om, ph = _cols()
    arg = om * t + ph
    return _case(
        kind,
        constant=F.lit(0.0),
        linear=F.lit(0.0),
        sine=-a * om * om * F.sin(arg),
        cosine=-a * om * om * F.cos(arg),
    )


def parse_drive(expr: Column, velocity: Column) -> Column:
    """Struct ``(kind, a, b)`` of a drive text, NULL when the text is none of the known forms.

    Known forms: a number, ``2*PI`` and ``a*time*PI/180``. A velocity drive turns a number
    ``v`` into the linear function ``v*t``.
    """
    e = F.trim(F.coalesce(expr, F.lit("")))
    number = F.when(e == "2*PI", F.lit(2.0 * math.pi)).otherwise(e.try_cast("double"))
    lead = F.trim(F.split(e, r"\*").getItem(0)).try_cast("double")
    has = F.lit(True)
    for token in ("*", "time", "PI", "/"):
        has = has & e.contains(token)
    zero = F.lit(0.0)

    def fn(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    return (
        F.when(number.isNotNull() & velocity, fn("linear", zero, number))
        .when(number.isNotNull(), fn("constant", number, zero))
        .when(has & lead.isNotNull(), fn("linear", zero, lead * F.lit(math.pi / 180.0)))
    )
