"""Recorded signals against references: alignment, scores, levels and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import ratio
from .ordered import running

SIGNAL = ("scenario", "category", "entity", "component")


def align(ref: DataFrame, own: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Own value at every reference time, interpolated linearly and held flat outside.

    ``ref`` and ``own`` hold ``(keys, t, value)``. A reference whose own signal is missing has
    no row. Result: ``(keys, t, ref, own)``.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    o = own.select(*keys, "t", F.lit(0).alias("_src"), F.col("value").alias("_v"), none.alias("ref"))
    r = ref.select(*keys, "t", F.lit(1).alias("_src"), none.alias("_v"), F.col("value").alias("ref"))
    sample = F.when(F.col("_src") == 0, F.struct("t", F.col("_v").alias("v")))
    d = running(
        o.unionByName(r), keys, ["t", "_src"], bucket, last={"_lo": sample}, following={"_hi": sample}
    ).filter(F.col("_src") == 1)
    lo, hi = F.col("_lo"), F.col("_hi")
    share = ratio(F.col("t") - lo["t"], hi["t"] - lo["t"])
    v = (
        F.when(lo.isNull(), hi["v"])
        .when(hi.isNull() | (lo["t"] == F.col("t")), lo["v"])
        .otherwise(lo["v"] + (hi["v"] - lo["v"]) * share)
    )
    return d.filter(lo.isNotNull() | hi.isNotNull()).select(*keys, "t", "ref", v.alias("own"))


def signal_error(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean square, maximum, mean and end error; rmse over the reference range; count."""
    diff = F.col("own") - F.col("ref")
    d = aligned.withColumn("_d", diff)
    g = d.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        F.max(F.abs("_d")).alias("max_abs_error"),
        F.avg(F.abs("_d")).alias("mean_abs_error"),
        F.max_by("_d", "t").alias("end_error"),
        (F.max("ref") - F.min("ref")).alias("_range"),
        F.count(F.lit(1)).alias("num_points"),
    )
    norm = F.when(F.col("_range") > 1e-30, ratio(F.col("rmse"), F.col("_range"))).otherwise(0.0)
    return g.withColumn("normalized_rmse", norm).drop("_range")


def level(errors: DataFrame, strict: float = 0.1, smoke: float = 0.25) -> DataFrame:
    e = F.abs("end_error")
    return errors.withColumn("level", F.when(e < strict, "strict").when(e < smoke, "smoke").otherwise("fail"))


def last_values(signals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return signals.groupBy(*keys).agg(F.max_by("value", "t").alias(name))


def report(
    ref: DataFrame, own: DataFrame, keys: Sequence[str], bucket: Column, strict: float = 0.1, smoke: float = 0.25
) -> DataFrame:
    """One row per case and signal: errors, level, and the last value of both sides."""
    keys = list(keys)
    err = level(signal_error(align(ref, own, keys, bucket), keys), strict, smoke)
    return err.join(last_values(ref, keys, "ref_last"), keys).join(last_values(own, keys, "own_last"), keys)


def components(signals: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Components of one entity side by side, with the magnitude; times missing one are dropped."""
    wide = signals.filter(F.col("component").isin(*names)).groupBy(*keys, "t").agg(
        *[F.max(F.when(F.col("component") == n, F.col("value"))).alias(n) for n in names]
    )
    wide = wide.dropna(subset=list(names))
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n) * F.col(n)
    return wide.withColumn("magnitude", F.sqrt(total))


def steady_value(signals: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Mean of the last ``n`` samples. The rank filter lets Spark keep only ``n`` rows per key
    before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("t").desc())
    d = signals.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return d.groupBy(*keys).agg(F.avg("value").alias("steady"), F.count(F.lit(1)).alias("samples"))


def sample_step(signals: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Step statistics per signal: mean, smallest and largest step and their spread."""
    d = running(signals, keys, ["t"], bucket, prev={"_t0": F.col("t")})
    step = F.col("t") - F.col("_t0")
    return d.groupBy(*keys).agg(
        F.avg(step).alias("mean_step"), F.min(step).alias("min_step"), F.max(step).alias("max_step"),
        (F.max(step) - F.min(step)).alias("irregularity"),
    )


def final_values(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return signals.groupBy(*keys).agg(
        F.max_by("value", "t").alias("final"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


def time_profile(timings: DataFrame) -> DataFrame:
    """Mean, total, count and share of all time per section of ``(section, seconds)`` rows."""
    d = timings.groupBy("section").agg(
        F.avg("seconds").alias("mean"), F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("calls")
    )
    everything = timings.agg(F.sum("seconds").alias("s")).scalar()
    return d.withColumn("share", ratio(F.col("total"), everything))


def stack_sweeps(*diagnostics: DataFrame) -> DataFrame:
    out = diagnostics[0]
    for d in diagnostics[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def history_signals(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Wide history rows (struct or map columns of body id to value) to long signal rows.

    Double columns become one signal each; map columns one per key.
    """
    parts = None
    for f in history.schema.fields:
        if f.name in (run, "t"):
            continue
        kind = f.dataType.typeName()
        if kind == "map":
            d = history.select(run, "t", F.explode(f.name).alias("entity", "value")).select(
                run, F.lit(f.name).alias("component"), F.col("entity").cast("string").alias("entity"), "t",
                F.col("value").cast("double").alias("value"),
            )
        elif kind == "struct":
            d = history.select(
                run, F.lit(f.name).alias("component"),
                F.explode(F.create_map(*[x for n in f.dataType.names for x in (F.lit(n), F.col(f"{f.name}.{n}").cast("double"))])).alias("entity", "value"),
                "t",
            ).select(run, "component", "entity", "t", "value")
        else:
            d = history.select(
                run, F.lit(f.name).alias("component"), F.lit("").alias("entity"), "t",
                F.col(f.name).cast("double").alias("value"),
            )
        parts = d if parts is None else parts.unionByName(d)
    return parts
