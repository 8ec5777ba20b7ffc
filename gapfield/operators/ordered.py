"""Running values over ordered rows of a key, without one task per key.

A plain window over a key sorts the whole key in one task. Here each key is cut into
buckets of the order column. A window runs inside each (key, bucket); a second, small
window runs over one summary row per bucket; the carried value is joined back. A key that
holds a third of all rows is spread over its buckets, and the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(order: str | Column, width: float) -> Column:
    """Bucket number of an order value: a pure function of the row."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(float(width))).cast("bigint")


def suggest_width(df: DataFrame, keys: Sequence[str], order: str, rows: int = 1_000_000) -> float:
    """Width that leaves about ``rows`` rows per bucket in the fullest key (one small job)."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(order) - F.min(order)).alias("span")
    )
    w = per_key.agg(
        F.min(F.col("span") / F.ceil(F.col("n") / F.lit(rows))).alias("w"),
    ).first()["w"]
    return float(w) if w else 1.0


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None = None,
    *,
    prev: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    since: Mapping[str, tuple[Column, Column]] | None = None,
    mins: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over ``keys`` ordered by ``order``.

    * ``prev``: value on the previous row (NULL on the first),
    * ``last``: last non-NULL value up to and including the row,
    * ``before``: last non-NULL value strictly before the row,
    * ``following``: first non-NULL value from the row on,
    * ``sums``: running sum including the row,
    * ``since``: for ``(flag, restart)`` the number of ``flag`` rows after the last ``restart``
      row, the row included; a restart row itself counts 0,
    * ``mins``: running minimum including the row.

    ``order`` must be unique within a key and keys must not be NULL; ``bucket`` must be
    non-decreasing along the order. It is kept as column ``_bucket``: a following call may omit
    it and then reuses the partitioning instead of shuffling again. The input is read twice,
    but the shuffle below is one and the same exchange, so what lies beneath runs once.
    """
    prev, last, before, following = prev or {}, last or {}, before or {}, following or {}
    sums, since, mins = sums or {}, since or {}, mins or {}
    keys, order = list(keys), list(order)
    ord_key = F.struct(*order) if len(order) > 1 else F.col(order[0])

    base = df
    if bucket is not None:
        base = df.withColumn(BUCKET, F.coalesce(bucket.cast("bigint"), F.lit(0))).repartition(*keys, BUCKET)
    inputs = {}
    for kind, spec in (("p", prev), ("l", last), ("b", before), ("f", following), ("s", sums), ("m", mins)):
        for name, expr in spec.items():
            inputs[f"_{kind}_{name}"] = expr
    for name, (flag, restart) in since.items():
        inputs[f"_n_{name}"] = F.when(flag & ~restart, 1).otherwise(0).cast("bigint")
        inputs[f"_r_{name}"] = restart
    base = base.withColumns(inputs)

    iw = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = iw.rowsBetween(Window.unboundedPreceding, 0)
    above = iw.rowsBetween(Window.unboundedPreceding, -1)
    onward = iw.rowsBetween(0, Window.unboundedFollowing)
    pcols = [f"_p_{n}" for n in prev]
    inner = {}
    if prev:
        inner["_i_prev"] = F.lag(F.struct(*pcols), 1).over(iw)
    for n in last:
        inner[f"_i_l_{n}"] = F.last(f"_l_{n}", ignorenulls=True).over(upto)
    for n in before:
        inner[f"_i_b_{n}"] = F.last(f"_b_{n}", ignorenulls=True).over(above)
    for n in following:
        inner[f"_i_f_{n}"] = F.first(f"_f_{n}", ignorenulls=True).over(onward)
    for n in sums:
        inner[f"_i_s_{n}"] = F.sum(f"_s_{n}").over(upto)
    for n in since:
        inner[f"_i_n_{n}"] = F.sum(f"_n_{n}").over(upto)
    for n in mins:
        inner[f"_i_m_{n}"] = F.min(f"_m_{n}").over(upto)
    rows = base.withColumns(inner)
    if since:
        rows = rows.withColumns(
            {
                f"_z_{n}": F.last(F.when(F.col(f"_r_{n}"), F.col(f"_i_n_{n}")), ignorenulls=True).over(upto)
                for n in since
            }
        )

    aggs = [F.max_by(F.struct(*pcols), ord_key).alias("_s_prev")] if prev else []
    for kind, names in (("l", last), ("b", before)):
        for n in names:
            c = F.col(f"_{kind}_{n}")
            aggs.append(F.max_by(c, F.when(c.isNotNull(), ord_key)).alias(f"_a_{kind}_{n}"))
    for n in following:
        c = F.col(f"_f_{n}")
        aggs.append(F.min_by(c, F.when(c.isNotNull(), ord_key)).alias(f"_a_f_{n}"))
    for n in sums:
        aggs.append(F.sum(f"_s_{n}").alias(f"_a_s_{n}"))
    for n in since:
        aggs.append(F.sum(f"_n_{n}").alias(f"_a_n_{n}"))
        aggs.append(F.max(f"_z_{n}").alias(f"_a_z_{n}"))
    for n in mins:
        aggs.append(F.min(f"_m_{n}").alias(f"_a_m_{n}"))
    summary = (rows if since else base).groupBy(*keys, BUCKET).agg(*aggs)

    w = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    carry = {}
    if prev:
        carry["_c_prev"] = F.last("_s_prev", ignorenulls=True).over(earlier)
    for kind, names in (("l", last), ("b", before)):
        for n in names:
            carry[f"_c_{kind}_{n}"] = F.last(f"_a_{kind}_{n}", ignorenulls=True).over(earlier)
    for n in following:
        carry[f"_c_f_{n}"] = F.first(f"_a_f_{n}", ignorenulls=True).over(later)
    for n in sums:
        carry[f"_c_s_{n}"] = F.sum(f"_a_s_{n}").over(earlier)
    for n in since:
        # count up to the last restart, measured from the start of the key
        total = F.coalesce(F.sum(f"_a_n_{n}").over(earlier), F.lit(0))
        summary = summary.withColumns({f"_t_{n}": total})
        summary = summary.withColumn(f"_y_{n}", F.col(f"_t_{n}") + F.col(f"_a_z_{n}"))
        zero = F.coalesce(F.last(f"_y_{n}", ignorenulls=True).over(earlier), F.lit(0))
        carry[f"_c_n_{n}"] = F.col(f"_t_{n}") - zero
    for n in mins:
        carry[f"_c_m_{n}"] = F.min(f"_a_m_{n}").over(earlier)
    carried = summary.select(*keys, BUCKET, *[c.alias(n) for n, c in carry.items()])

    j = rows.join(carried, [*keys, BUCKET], "left")

    out = {}
    for n in prev:
        out[n] = F.coalesce(F.col("_i_prev"), F.col("_c_prev"))[f"_p_{n}"]
    for kind, names in (("l", last), ("b", before), ("f", following)):
        for n in names:
            out[n] = F.coalesce(F.col(f"_i_{kind}_{n}"), F.col(f"_c_{kind}_{n}"))
    for n in sums:
        i, c = F.col(f"_i_s_{n}"), F.col(f"_c_s_{n}")
        out[n] = F.when(i.isNull(), c).when(c.isNull(), i).otherwise(i + c)
    for n in since:
        i, z, c = F.col(f"_i_n_{n}"), F.col(f"_z_{n}"), F.col(f"_c_n_{n}")
        out[n] = F.when(z.isNotNull(), i - z).otherwise(i + F.coalesce(c, F.lit(0)))
    for n in mins:
        out[n] = F.least(F.col(f"_i_m_{n}"), F.col(f"_c_m_{n}"))
    keep = [F.col(c) for c in dict.fromkeys([*df.columns, BUCKET]) if c not in out]
    return j.select(*keep, *[c.alias(n) for n, c in out.items()])
