"""Contact phases over a stream of measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.phases import ACTIVE, IMPACTING, INACTIVE, LEAVING, STABLE, PhaseParams

#: What a contact carries from one row to the next: separated rows in a row, whether it is on, whether
#: the last row switched it on, good rows since the last restart, and the last penetration.
CARRY = "run bigint, is_on boolean, entered boolean, good bigint, penetration double"
ROW = "run_id string, cp_id bigint, t double, ts_ms bigint, gap double, penetration double, active_count bigint, normal_velocity double"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _arrays(columns: str) -> str:
    return ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in columns.split(", "))


#: The rows of a bucket, and what the contacts of a group carry, as one value each: an array per column.
HELD = _arrays(ROW)
CARRIED = _arrays("run_id string, cp_id bigint, " + CARRY)
OUT = (
    "run_id string, cp_id bigint, t double, gap double, penetration double, "
    "phase string, stable_count int, release_count int"
)
START = (0, False, False, 0, 0.0)


class _Segments:
    """Rows of several contacts, one contact after the other, each in order of time."""

    def __init__(self, starts: np.ndarray, n: int):
        self.n, self.starts = n, starts
        self.ends = np.append(starts[1:], n) - 1
        self.of = np.repeat(np.arange(len(starts)), self.ends - starts + 1)
        self.first = starts[self.of]

    def before(self, value: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """The value of the row before; a contact's first row takes what it carries."""
        out = np.empty_like(value)
        out[1:] = value[:-1]
        out[self.starts] = carried
        return out

    def count_since(self, flag: np.ndarray, restart: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """Flagged rows after the last restart row; before the first one the carried count goes on."""
        own = flag & ~restart
        total = np.cumsum(own)
        at = np.maximum.accumulate(np.where(restart, np.arange(self.n), -1))
        since_first = total - (total - own)[self.first] + carried[self.of]
        return np.where(at >= self.first, total - total[np.maximum(at, 0)], since_first)

    def last_known(self, value: np.ndarray, known: np.ndarray, carried: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(known, np.arange(self.n), -1))
        return np.where(at >= self.first, value[np.maximum(at, 0)], carried[self.of])


def steps(rows: pd.DataFrame, starts: np.ndarray, carries: tuple[np.ndarray, ...], p: PhaseParams) -> tuple[pd.DataFrame, tuple[np.ndarray, ...]]:
    """Phases of the rows of contacts that begin at ``starts``, and what each carries on: the batch rules on arrays.

    A touch switches a contact on, a completed release off; the release count is the run of
    separated rows, the stable count the good rows since the last bad row or completed release.
    """
    run0, on0, entered0, good0, pen0 = carries
    seg = _Segments(starts, len(rows))
    gap, pen, vn = (rows[c].to_numpy(float) for c in ("gap", "penetration", "normal_velocity"))
    separated = (gap > p.release_gap) & (vn >= -p.vn_tol)
    run = seg.count_since(separated, ~separated, run0)
    touch = gap <= 0
    on = seg.last_known(touch, touch | (run >= p.release_steps), on0).astype(bool)
    was_on = seg.before(on, on0)
    enter = on & ~was_on
    before = seg.before(pen, pen0)
    change = np.abs(pen - before)
    small = (change <= p.penetration_tol) | (change / np.maximum(np.abs(before), p.penetration_tol) <= p.rel_change)
    checked = on & ~enter & ~separated & ~seg.before(enter, entered0)
    good = checked & (rows["active_count"].to_numpy() > 0) & small & (np.abs(vn) <= p.vn_tol)
    stable = seg.count_since(good, (checked & ~good) | (was_on & ~on), good0)
    phase = np.select([~on, enter, separated, checked & (stable >= p.stable_steps)], [INACTIVE, IMPACTING, LEAVING, STABLE], ACTIVE)
    out = rows[["t", "gap", "penetration"]].assign(phase=phase, stable_count=stable.astype(np.int32), release_count=np.where(on & separated, run, 0).astype(np.int32))
    return out, tuple(x[seg.ends] for x in (run, on, enter, stable, pen))


def step(rows: pd.DataFrame, carry: tuple, p: PhaseParams) -> tuple[pd.DataFrame, tuple]:
    """:func:`steps` for one contact."""
    out, carries = steps(rows, np.array([0]), tuple(np.array([c]) for c in carry), p)
    return out, tuple(x[0].item() for x in carries)


class PhaseTracker(StatefulProcessor):
    """Holds the rows of a group of contacts by time bucket until the watermark has passed them.

    A bucket is one entry of the state with a timer at its first row, so what is read and written at a
    time is a bucket, never a series. Buckets become due in order; what a contact carries goes from one to the next.
    """

    def __init__(self, p: PhaseParams, bucket_ms: int):
        self.p, self.bucket_ms = p, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", CARRIED)
        self.held = handle.getMapState("held", "bucket bigint", HELD)

    def _rows(self, bucket: int) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(COLUMNS, self.held.getValue((bucket,)), strict=True)), columns=COLUMNS)

    def _hold(self, bucket: int, rows: pd.DataFrame) -> None:
        self.held.updateValue((bucket,), tuple(rows[c].tolist() for c in COLUMNS))
        self.handle.registerTimer(int(rows["ts_ms"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for bucket, own in part[COLUMNS].groupby(part["ts_ms"] // self.bucket_ms):
                bucket = int(bucket)
                if self.held.containsKey((bucket,)):
                    own = pd.concat([self._rows(bucket), own], ignore_index=True)
                self._hold(bucket, own)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bucket = int(expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms)
        if not self.held.containsKey((bucket,)):
            yield pd.DataFrame()
            return
        rows = self._rows(bucket)
        due = rows["ts_ms"] <= timerValues.getCurrentWatermarkInMs()
        if due.all():
            self.held.removeKey((bucket,))
        elif due.any():
            self._hold(bucket, rows[~due])
        ready = rows[due].sort_values(["run_id", "cp_id", "ts_ms", "t"], kind="stable", ignore_index=True)
        if not len(ready):
            yield pd.DataFrame()
            return
        carried = {c[:2]: c[2:] for c in zip(*self.carry.get(), strict=True)} if self.carry.exists() else {}
        who = ready[["run_id", "cp_id"]]
        starts = np.flatnonzero((who != who.shift()).any(axis=1))
        contacts = list(who.iloc[starts].itertuples(index=False, name=None))
        phases, after = steps(ready, starts, tuple(map(np.array, zip(*(carried.get(c, START) for c in contacts), strict=True))), self.p)
        carried |= {c: tuple(x.item() for x in v) for c, v in zip(contacts, zip(*after, strict=True), strict=True)}
        self.carry.update(tuple(map(list, zip(*(c + v for c, v in carried.items()), strict=True))))
        phases.insert(0, "run_id", ready["run_id"])
        phases.insert(1, "cp_id", ready["cp_id"])
        yield phases

    def close(self) -> None:
        pass


def track_phases(stream: DataFrame, p: PhaseParams = PhaseParams(), delay: str = "10 seconds", bucket_seconds: int = 60, groups: int = 64) -> DataFrame:
    """Phases of arriving rows ``(run_id, cp_id, ts, t, gap, penetration, active_count,
    normal_velocity)``.

    Rows may arrive in any order within ``delay`` of the newest time seen; a row comes out once the
    watermark has passed its time, in order. Rows behind the watermark are dropped by Spark. Contacts are dealt to
    ``groups`` by hash, so that a call serves many of them; take more groups for more contacts. State are five numbers per contact
    and the rows that still wait, in buckets of ``bucket_seconds``. Needs the RocksDB state store.
    """
    contact = (F.col("run_id").cast("string").alias("run_id"), F.col("cp_id").cast("bigint").alias("cp_id"))
    keyed = stream.select(
        *contact, "ts", F.unix_millis("ts").alias("ts_ms"), "t", "gap", "penetration",
        F.col("active_count").cast("bigint").alias("active_count"), "normal_velocity",
    ).withColumn("group", F.pmod(F.xxhash64("run_id", "cp_id"), F.lit(groups)))
    return keyed.withWatermark("ts", delay).groupBy("group").transformWithStateInPandas(
        PhaseTracker(p, bucket_seconds * 1000), OUT, "Append", "EventTime"
    )
