"""Queries on recorded signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapfield.operators import signals
from gapfield.operators.ordered import bucket_of

from . import sql as S
from . import tables as T
from .registry import query, rounded

KEYS = ["user_id", "event_type"]
BUCKET = 4 * 86400.0


def _ref_own(spark, sf):
    """Each user's event series is the reference; the next user's is the recorded one."""
    e = T.events(spark, sf).select(*KEYS, "t", "value")
    return e, e.withColumn("user_id", F.col("user_id") - 1)


_align = """own AS (SELECT user_id - 1 AS user_id, event_type, t, value FROM ev),
lo AS (SELECT r.user_id, r.event_type, r.t, r.value AS ref, o.t AS t0, o.value AS v0 FROM ev r ASOF LEFT JOIN own o ON r.user_id = o.user_id AND r.event_type = o.event_type AND r.t >= o.t),
hi AS (SELECT r.user_id, r.event_type, r.t, o.t AS t1, o.value AS v1 FROM ev r ASOF LEFT JOIN own o ON r.user_id = o.user_id AND r.event_type = o.event_type AND r.t <= o.t),
al AS (SELECT lo.user_id, lo.event_type, lo.t, ref, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = lo.t THEN v0 ELSE v0 + (v1-v0)*(lo.t-t0)/(t1-t0) END AS own
 FROM lo JOIN hi ON lo.user_id = hi.user_id AND lo.event_type = hi.event_type AND lo.t = hi.t WHERE t0 IS NOT NULL OR t1 IS NOT NULL)"""
_err = """er AS (SELECT user_id, event_type, sqrt(avg((own-ref)*(own-ref))) AS rmse, max(abs(own-ref)) AS max_abs_error, avg(abs(own-ref)) AS mean_abs_error, arg_max(own-ref, t) AS end_error,
 max(ref)-min(ref) AS rng, count(*) AS num_points FROM al GROUP BY ALL),
en AS (SELECT *, CASE WHEN rng > 1e-30 THEN rmse/rng ELSE 0e0 END AS normalized_rmse, CASE WHEN abs(end_error) < 1e1 THEN 'strict' WHEN abs(end_error) < 5e1 THEN 'smoke' ELSE 'fail' END AS level FROM er)"""
ERR = ["rmse", "max_abs_error", "mean_abs_error", "end_error", "normalized_rmse"]


@query("signal_align", S.with_(S.EV, _align) + f"SELECT user_id, event_type, {S.r6('t', 't', 4)}, {S.r6s(['ref', 'own'])} FROM al")
def signal_align(spark, sf):
    d = signals.align(*_ref_own(spark, sf), KEYS, bucket_of("t", BUCKET))
    return rounded(rounded(d, ["ref", "own"]), ["t"], 4)


@query("signal_error", S.with_(S.EV, _align, _err) + f"SELECT user_id, event_type, {S.r6s(ERR)}, num_points FROM en")
def signal_error(spark, sf):
    d = signals.signal_error(signals.align(*_ref_own(spark, sf), KEYS, bucket_of("t", BUCKET)), KEYS)
    return rounded(d, ERR)


@query("signal_level", S.with_(S.EV, _align, _err) + "SELECT level, count(*) AS n FROM en GROUP BY level")
def signal_level(spark, sf):
    d = signals.signal_error(signals.align(*_ref_own(spark, sf), KEYS, bucket_of("t", BUCKET)), KEYS)
    return signals.level(d, 10.0, 50.0).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("signal_report", S.with_(S.EV, _align, _err, "rl AS (SELECT user_id, event_type, arg_max(value, t) AS ref_last FROM ev GROUP BY ALL)", "ol AS (SELECT user_id, event_type, arg_max(value, t) AS own_last FROM own GROUP BY ALL)") + f"SELECT user_id, event_type, level, {S.r6s(['rmse', 'end_error', 'ref_last', 'own_last'])} FROM en JOIN rl USING (user_id, event_type) JOIN ol USING (user_id, event_type)")
def signal_report(spark, sf):
    d = signals.report(*_ref_own(spark, sf), KEYS, bucket_of("t", BUCKET), 10.0, 50.0)
    names = ["rmse", "end_error", "ref_last", "own_last"]
    return rounded(d.select(*KEYS, "level", *names), names)


@query("signal_magnitude", f"""SELECT user_id, CAST(tm AS DOUBLE) AS t, {S.r6('c', 'click')}, {S.r6('v', 'view')}, {S.r6('sqrt(c*c+v*v)', 'magnitude')} FROM (
 SELECT user_id, event_id // 500 AS tm, max(value) FILTER (WHERE event_type = 'click') AS c, max(value) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY ALL) WHERE c IS NOT NULL AND v IS NOT NULL""")
def signal_magnitude(spark, sf):
    """Two components side by side; the time is coarse here so that they meet."""
    e = T.load(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 500).cast("double").alias("t"), F.col("event_type").alias("component"), "value")
    d = signals.components(e, ["click", "view"], ["user_id"])
    return rounded(d.select("user_id", "t", "click", "view", "magnitude"), ["click", "view", "magnitude"])


@query("steady_value", S.with_(S.EV) + f"SELECT user_id, {S.r6('avg(value)', 'steady')}, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS rn FROM ev) WHERE rn <= 10 GROUP BY user_id")
def steady_value(spark, sf):
    return rounded(signals.steady_value(T.events(spark, sf), 10, ["user_id"]), ["steady"])


@query("sample_step", S.with_(S.EV, "d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS s FROM ev)") + f"SELECT user_id, {S.r6('avg(s)', 'mean_step', 3)}, {S.r6('min(s)', 'min_step', 3)}, {S.r6('max(s)', 'max_step', 3)}, {S.r6('max(s)-min(s)', 'irregularity', 3)} FROM d GROUP BY user_id")
def sample_step(spark, sf):
    d = signals.sample_step(T.events(spark, sf), ["user_id"], bucket_of("t", BUCKET))
    return rounded(d, ["mean_step", "min_step", "max_step", "irregularity"], 3)


@query("final_values", S.with_(S.EV) + f"SELECT user_id, event_type, {S.r6('arg_max(value, t)', 'final')}, {S.r6('min(value)', 'lowest')}, {S.r6('max(value)', 'highest')} FROM ev GROUP BY ALL")
def final_values(spark, sf):
    return rounded(signals.final_values(T.events(spark, sf), KEYS), ["final", "lowest", "highest"])


@query("time_profile", f"SELECT event_type AS section, {S.r6('avg(value)', 'mean')}, {S.r6('sum(value)', 'total', 3)}, count(*) AS calls, {S.r6('sum(value)/sum(sum(value)) OVER ()', 'share')} FROM events GROUP BY event_type")
def time_profile(spark, sf):
    e = T.load(spark, sf, "events").select(F.col("event_type").alias("section"), F.col("value").alias("seconds"))
    return rounded(rounded(signals.time_profile(e), ["mean", "share"]), ["total"], 3)


@query("history_signals", "SELECT CAST(o_custkey AS BIGINT) AS run_id, component, entity, count(*) AS n, round(sum(value), 3) + 0.0 AS total FROM (SELECT o_custkey, 'price' AS component, '' AS entity, o_totalprice AS value FROM orders UNION ALL SELECT o_custkey, 'pos', 'x', o_totalprice*2e0 FROM orders UNION ALL SELECT o_custkey, 'pos', 'y', o_orderkey*1e0 FROM orders UNION ALL SELECT o_custkey, 'load', o_orderstatus, o_totalprice*5e-1 FROM orders) GROUP BY ALL")
def history_signals(spark, sf):
    """Wide history rows with a struct and a map column to long signal rows."""
    h = T.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("double").alias("t"), F.col("o_totalprice").alias("price"),
        F.struct((F.col("o_totalprice") * 2.0).alias("x"), F.col("o_orderkey").cast("double").alias("y")).alias("pos"),
        F.create_map("o_orderstatus", F.col("o_totalprice") * 0.5).alias("load"),
    )
    d = signals.history_signals(h).groupBy("run_id", "component", "entity").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(d, ["total"], 3)
