"""Queries over joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import timeline as tl
from skycadence.operators import temporal as tm
from skycadence.operators.chunks import on_grid, series_bounds
from skycadence.operators.windows import asof_value, lead
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, W, cells, cells_sql, observations, rc, rd, reports, round_all, series)

C = F.col
REP = "rep AS (SELECT site, ts, event_id, k * 0.09375::DOUBLE AS oktas FROM obs WHERE event_type = 'signup')"
PURCHASE = "pur AS (SELECT site, ts, event_id, value FROM obs WHERE event_type = 'purchase')"


def purchases(t: Tables):
    return observations(t).where(C("event_type") == "purchase").select("site", "ts", "event_id", "value")


@query("jn_inner_sources", "JN-1 VIEW-1", f"""WITH {OBS}, a AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(value) AS clicks FROM obs WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(value) AS views FROM obs WHERE event_type = 'view' GROUP BY 1, 2),
c AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(value) AS errors FROM obs WHERE event_type = 'error' GROUP BY 1, 2)
SELECT site, ts, clicks, views, errors FROM a JOIN b USING (site, ts) JOIN c USING (site, ts)""")
def _(t: Tables):
    from skycadence.sources.readers import wide_view
    def part(kind, name):
        return (observations(t).where(C("event_type") == kind)
                .groupBy("site", tl.floor_to("ts", 3600).alias("ts")).agg(F.sum("value").alias(name)))
    return wide_view([part("click", "clicks"), part("view", "views"), part("error", "errors")])


@query("jn_full_outer", "JN-3", f"""WITH {OBS}, a AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS purchases FROM obs WHERE event_type = 'purchase' GROUP BY 1, 2),
b AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS signups FROM obs WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT coalesce(a.site, b.site) AS site, coalesce(a.ts, b.ts) AS ts, purchases, signups FROM a FULL OUTER JOIN b ON a.site = b.site AND a.ts = b.ts""")
def _(t: Tables):
    def part(kind, name):
        return (observations(t).where(C("event_type") == kind)
                .groupBy("site", tl.floor_to("ts", 3600).alias("ts")).agg(F.count(F.lit(1)).alias(name)))
    return tm.full_merge(part("purchase", "purchases"), part("signup", "signups"))


@query("jn_interval_aggregate", "JN-4 AGG-3", f"""WITH {S1H}, {REP} SELECT g.site, g.ts, count(r.ts) AS n, {rd('avg(r.oktas)', 'oktas')}, {rd('arg_max(r.oktas, (r.ts, r.event_id))', 'newest')}
FROM s1h g LEFT JOIN rep r ON r.site = g.site AND r.ts > g.ts - INTERVAL 60 MINUTE AND r.ts <= g.ts GROUP BY 1, 2""")
def _(t: Tables):
    hours = series(t, step_s=3600).select("site", "ts")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("oktas").alias("oktas"), F.max_by("oktas", F.struct("ts", "event_id")).alias("newest")]
    out = tm.interval_agg(hours, reports(t), 3600, aggs, step_s=3600)
    return out.select("site", "ts", F.coalesce("n", F.lit(0)).alias("n"), rc(C("oktas"), "oktas"), rc(C("newest"), "newest"))


@query("jn_interval_aggregate_overlapping", "JN-4", f"""WITH {S10}, {REP} SELECT g.site, g.ts, count(r.ts) AS n, {rd('avg(r.oktas)', 'oktas')}
FROM s10 g LEFT JOIN rep r ON r.site = g.site AND r.ts > g.ts - INTERVAL 60 MINUTE AND r.ts <= g.ts GROUP BY 1, 2""")
def _(t: Tables):
    out = tm.interval_agg(series(t).select("site", "ts"), reports(t), 3600,
                          [F.count(F.lit(1)).alias("n"), F.avg("oktas").alias("oktas")], step_s=600)
    return out.select("site", "ts", F.coalesce("n", F.lit(0)).alias("n"), rc(C("oktas"), "oktas"))


@query("jn_nearest_on_grid", "JN-5 WIN-11", f"""WITH {S10}, {REP}, x AS (SELECT g.site, g.ts, r.oktas, abs(epoch(r.ts - g.ts)) AS gap,
row_number() OVER (PARTITION BY g.site, g.ts ORDER BY abs(epoch_us(r.ts) - epoch_us(g.ts)), r.ts, r.event_id) AS rn
FROM s10 g JOIN rep r ON r.site = g.site AND r.ts BETWEEN g.ts - INTERVAL 5 MINUTE AND g.ts + INTERVAL 5 MINUTE)
SELECT g.site, g.ts, x.oktas, {rd('x.gap', 'gap_s', 3)} FROM s10 g LEFT JOIN x ON x.site = g.site AND x.ts = g.ts AND rn = 1""")
def _(t: Tables):
    best = tm.nearest_per_slot(reports(t), 600, 300, ["oktas"], tiebreak=["event_id"])
    return series(t).select("site", "ts").join(best, ["site", "ts"], "left").select("site", "ts", "oktas", rc(C("gap_s"), "gap_s", 3))


@query("jn_nearest_irregular", "JN-5", f"""WITH {OBS}, {REP}, {PURCHASE}, x AS (SELECT p.site, p.ts, p.event_id, r.oktas,
row_number() OVER (PARTITION BY p.site, p.event_id ORDER BY abs(epoch_us(r.ts) - epoch_us(p.ts)), r.ts) AS rn
FROM pur p LEFT JOIN rep r ON r.site = p.site AND r.ts BETWEEN p.ts - INTERVAL 5 MINUTE AND p.ts + INTERVAL 5 MINUTE)
SELECT site, ts, event_id, oktas FROM x WHERE rn = 1""")
def _(t: Tables):
    out = tm.nearest_join(purchases(t), reports(t), ["oktas"], tolerance_s=300, tiebreak=["event_id"])
    return out.select("site", "ts", "event_id", "oktas")


@query("jn_asof_tolerance", "JN-6", f"""WITH {OBS}, {REP}, {PURCHASE}, x AS (SELECT p.site, p.ts, p.event_id, p.value, r.oktas, r.ts AS rts,
row_number() OVER (PARTITION BY p.site, p.event_id ORDER BY r.ts DESC) AS rn FROM pur p
LEFT JOIN rep r ON r.site = p.site AND r.ts <= p.ts AND r.ts > p.ts - INTERVAL 65 MINUTE)
SELECT site, ts, event_id, value, oktas, {rd('epoch(ts - rts) / 60.0::DOUBLE', 'age_min', 4)} FROM x WHERE rn = 1""")
def _(t: Tables):
    out = tm.asof_join(purchases(t), reports(t), ["oktas"], tolerance_s=65 * 60, strict=True, age="age_min", tiebreak=["event_id"])
    return out.select("site", "ts", "event_id", "value", "oktas", rc(C("age_min"), "age_min", 4))


@query("jn_asof_unlimited", "JN-7", f"""WITH {OBS}, {REP}, {PURCHASE} SELECT p.site, p.ts, p.event_id, CASE WHEN p.ts - r.ts > INTERVAL 6 HOUR THEN NULL ELSE r.oktas END AS oktas,
{rd('epoch(p.ts - r.ts) / 60.0::DOUBLE', 'age_min', 4)} FROM pur p ASOF LEFT JOIN rep r ON r.site = p.site AND p.ts >= r.ts""")
def _(t: Tables):
    out = tm.asof_join(purchases(t), reports(t), ["oktas"], age="age_min", tiebreak=["event_id"], rows_per_chunk=1_000_000)
    return out.select("site", "ts", "event_id", F.when(C("age_min") <= 360, C("oktas")).alias("oktas"), rc(C("age_min"), "age_min", 4))


@query("jn_asof_on_grid", "JN-7 JN-8", f"""WITH {S10}, {REP} SELECT g.site, g.ts, CASE WHEN g.ts - r.ts > INTERVAL 61 MINUTE THEN NULL ELSE r.oktas END AS oktas
FROM s10 g ASOF LEFT JOIN rep r ON r.site = g.site AND g.ts >= r.ts""")
def _(t: Tables):
    rep = tm.latest_per_slot(reports(t), 600, ["oktas"], tiebreak=["event_id"])
    def f(g, w):
        r = g.withColumn("_r", asof_value("report", w, 7))
        return r.withColumn("oktas", F.when(tl.seconds_between("ts", "_r.at") <= 3660.0, C("_r.oktas")))
    g = on_grid([rep], f, step_s=600, bounds=series_bounds(observations(t), 600), back=7)
    return g.select("site", "ts", "oktas")


@query("jn_truncated_hour", "JN-9", f"""WITH {S10}, {cells_sql('1 HOUR', 'c1h')} SELECT s.site, s.ts, s.ghi, h.oktas AS hour_oktas FROM s10 s
LEFT JOIN c1h h ON h.site = s.site AND h.ts = date_trunc('hour', s.ts)""")
def _(t: Tables):
    hours = cells(t, 3600).select("site", C("ts").alias("period"), C("oktas").alias("hour_oktas"))
    return tm.period_join(series(t), hours, tl.floor_to("ts", 3600), ["hour_oktas"]).select("site", "ts", "ghi", "hour_oktas")


@query("jn_shifted_key", "JN-10", f"""WITH {S10} SELECT s.site, s.ts, s.ghi, c.cot AS cot_before FROM s10 s LEFT JOIN c10 c ON c.site = s.site AND s.ts = c.ts + INTERVAL 10 MINUTE""")
def _(t: Tables):
    before = tm.shift_key(cells(t).select("site", "ts", C("cot").alias("cot_before")), 600)
    return series(t).select("site", "ts", "ghi").join(before, ["site", "ts"], "left")


@query("jn_previous_hour", "JN-11", f"""WITH {S10}, {cells_sql('1 HOUR', 'c1h')} SELECT s.site, s.ts, h.temp AS prev_hour_temp FROM s10 s
LEFT JOIN c1h h ON h.site = s.site AND date_trunc('hour', s.ts) = h.ts + INTERVAL 1 HOUR""")
def _(t: Tables):
    ended = cells(t, 3600).select("site", tl.shift("ts", 3600).alias("period"), C("temp").alias("prev_hour_temp"))
    return tm.period_join(series(t), ended, tl.floor_to("ts", 3600), ["prev_hour_temp"]).select("site", "ts", "prev_hour_temp")


@query("jn_next_hour", "JN-12", f"""WITH {OBS}, {cells_sql('1 HOUR', 'c1h')} SELECT r.site, r.ts, r.ghi, nxt.ghi AS ghi_next FROM c1h r
LEFT JOIN c1h nxt ON nxt.site = r.site AND nxt.ts = r.ts + INTERVAL 1 HOUR""")
def _(t: Tables):
    return tm.lookup_at(cells(t, 3600).select("site", "ts", "ghi"), 3600, {"ghi": "ghi_next"})


@query("jn_future_lookup", "JN-13 TGT-1", f"""WITH {OBS}, {cells_sql()} SELECT a.site, a.ts, a.ghi, b.ghi AS ghi_t60 FROM c10 a
LEFT JOIN c10 b ON b.site = a.site AND b.ts = a.ts + INTERVAL 60 MINUTE""")
def _(t: Tables):
    # Same result as a self join, from one pass over the grid.
    g = on_grid([cells(t).select("site", "ts", "ghi")], lambda d, w: d.withColumn("ghi_t60", lead("ghi", 6, w)),
                step_s=600, bounds=series_bounds(observations(t), 600), ahead=6)
    return g.where(C("ghi").isNotNull()).select("site", "ts", "ghi", "ghi_t60")


@query("jn_small_dimensions", "JN-14", """SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def _(t: Tables):
    # Balances are combined per nation before the dimensions are attached.
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
    out = (per.join(t.nation, per.c_nationkey == t.nation.n_nationkey, "left")
           .join(t.region, C("n_regionkey") == C("r_regionkey"), "left"))
    return out.groupBy("r_name", "n_name").agg(F.sum("customers").alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))


@query("jn_semi_common_keys", "JN-15 JN-16", f"""WITH {OBS}, {cells_sql()}, k AS (SELECT site, ts FROM c10 WHERE cot IS NOT NULL)
SELECT a.site, a.ts, a.ghi, b.temp FROM c10 a JOIN c10 b USING (site, ts) WHERE b.temp IS NOT NULL AND EXISTS (SELECT 1 FROM k WHERE k.site = a.site AND k.ts = a.ts)""")
def _(t: Tables):
    c = cells(t)
    a, b = c.select("site", "ts", "ghi"), c.where(C("temp").isNotNull()).select("site", "ts", "temp")
    return tm.align_predictions(tm.keep_keys(a, c.where(C("cot").isNotNull())), b)
