"""Contact phases and settling over recorded rows, in batch, without folding a whole series.

The phase rules are a state machine, but each of its counters restarts at rows that can be
recognized from the data alone, so the state at a row follows from running values. That spreads
one long series over many tasks; see :mod:`ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import BUCKET, running

INACTIVE, IMPACTING, ACTIVE, STABLE, LEAVING = "INACTIVE", "IMPACTING", "ACTIVE", "STABLE", "LEAVING"


@dataclass(frozen=True)
class PhaseParams:
    """Debounce settings; the defaults are fixed values of the phase rules."""

    penetration_tol: float = 1e-6
    vn_tol: float = 1e-5
    rel_change: float = 5e-2
    stable_steps: int = 5
    release_steps: int = 3
    release_gap_min: float = 1e-9

    @property
    def release_gap(self) -> float:
        return max(5.0 * self.penetration_tol, self.release_gap_min)


def separated(p: PhaseParams) -> Column:
    return (F.col("gap") > p.release_gap) & (F.col("normal_velocity") >= -p.vn_tol)


def steady(p: PhaseParams, before: Column) -> Column:
    """Is the contact held with little normal motion and little change of penetration?"""
    change = F.abs(F.col("penetration") - before)
    base = F.greatest(F.abs(before), F.lit(p.penetration_tol))
    small = (change <= p.penetration_tol) | (change / base <= p.rel_change)
    return (F.col("active_count") > 0) & small & (F.abs("normal_velocity") <= p.vn_tol)


def phases(
    measures: DataFrame,
    bucket: Column,
    p: PhaseParams = PhaseParams(),
    keys: Sequence[str] = ("run_id", "cp_id"),
) -> DataFrame:
    """Add ``phase``, ``stable_count`` and ``release_count`` to every measure row.

    Why running values suffice: a touching row is never a separated row, so the run of separated
    rows since the last other row is the release count while in contact. A contact is inactive
    exactly when its last completed release is later than its last touch. The stable count
    restarts at unstable rows and at completed releases only.
    """
    keys = list(keys)
    own = measures.columns
    sep = separated(p)
    d = running(
        measures.withColumn("_sep", sep), keys, ["t"], bucket,
        prev={"_pen0": F.col("penetration")},
        since={"_run": (F.col("_sep"), ~F.col("_sep"))},
    )
    # the last event decides: a touch starts contact, a completed release ends it
    event = F.when(F.col("gap") <= 0, F.lit(True)).when(F.col("_run") >= p.release_steps, F.lit(False))
    d = running(d.withColumn("_ev", event), keys, ["t"], last={"_on": F.col("_ev")}, before={"_on0": F.col("_ev")})
    on, was_on = F.coalesce("_on", F.lit(False)), F.coalesce("_on0", F.lit(False))
    d = d.withColumns({"_on": on, "_enter": on & ~was_on, "_ended": was_on & ~on})
    # every call reads its input twice; a reliable checkpoint keeps that from compounding
    d = cut_lineage(d.drop("_ev", "_on0"))
    d = running(d, keys, ["t"], F.col(BUCKET), prev={"_enter0": F.col("_enter")})
    checked = F.col("_on") & ~F.col("_enter") & ~F.col("_sep") & ~F.coalesce("_enter0", F.lit(False))
    good = steady(p, F.coalesce("_pen0", F.lit(0.0)))
    d = d.withColumns({"_chk": checked, "_good": F.coalesce(checked & good, F.lit(False))})
    restart = (F.col("_chk") & ~F.col("_good")) | F.col("_ended")
    d = running(d, keys, ["t"], since={"stable_count": (F.col("_good"), restart)})
    d = d.withColumn("stable_count", F.col("stable_count").cast("int"))
    phase = (
        F.when(~F.col("_on"), INACTIVE)
        .when(F.col("_enter"), IMPACTING)
        .when(F.col("_sep"), LEAVING)
        .when(F.col("_chk") & (F.col("stable_count") >= p.stable_steps), STABLE)
        .otherwise(ACTIVE)
    )
    release = F.when(F.col("_on") & F.col("_sep"), F.col("_run")).otherwise(0).cast("int")
    return d.select(*own, phase.alias("phase"), "stable_count", release.alias("release_count"))


def settling_time(
    q: DataFrame, cond: Column, n: int, bucket: Column, keys: Sequence[str] = ("run_id",), time: str = "t"
) -> DataFrame:
    """First time at which ``cond`` has held for more than ``n`` rows in a row; NULL if never."""
    keys = list(keys)
    d = q.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    d = running(d, keys, [time], bucket, since={"_held": (F.col("_ok"), ~F.col("_ok"))})
    return d.groupBy(*keys).agg(F.min(F.when(F.col("_held") > n, F.col(time))).alias("settled_at"))


__all__ = ["BUCKET", "PhaseParams", "phases", "separated", "settling_time", "steady"]
