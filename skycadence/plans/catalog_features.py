"""Queries over windows, solar geometry and the feature tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skycadence.functions import exprs as ex
from skycadence.functions import solar as so
from skycadence.functions import timeline as tl
from skycadence.operators import windows as wn
from skycadence.operators.chunks import carry_last, halo_windows, row_windows, running_total, series_bounds
from skycadence.plans import features as ft
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, SITES, W, case_sql, cells, cells_sql, cloud, elev_sql, elevation, frame,
                                       observations, radiation, rc, rd, reports, round_all, series, weather)
from skycadence.sources.sinks import materialize
from skycadence import spec as sp
from skycadence.spec import FEATURES, per_site

C = F.col
N = None


# ---- windows ---------------------------------------------------------------

@query("win_lags_leads", "WIN-1 WIN-2 WIN-12 WIN-13", f"""WITH {S10} SELECT site, ts,
{', '.join(rd(f'lag(ghi, {k}) {W}', f'lag{k}') for k in (1, 2, 3, 6, 12, 18))},
{', '.join(rd(f'lead(ghi, {k}) {W}', f'lead{k}') for k in range(1, 7))} FROM s10""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", *[rc(wn.lag("ghi", k, w), f"lag{k}") for k in (1, 2, 3, 6, 12, 18)],
                        *[rc(wn.lead("ghi", k, w), f"lead{k}") for k in range(1, 7)])
    return series(t, f, back=18, ahead=6).select("site", "ts", *[f"lag{k}" for k in (1, 2, 3, 6, 12, 18)],
                                                 *[f"lead{k}" for k in range(1, 7)])


_ROLL = [(k, s) for k in (3, 6, 12, 18) for s in ("mean", "std", "min", "max", "range", "sum")]


def _roll_sql(k, s):
    fr = frame(-k + 1, 0)
    return {"mean": f"avg(ghi) {fr}", "std": f"stddev_samp(ghi) {fr}", "min": f"min(ghi) {fr}", "max": f"max(ghi) {fr}",
            "range": f"max(ghi) {fr} - min(ghi) {fr}", "sum": f"sum(rain) {fr}"}[s]


@query("win_rolling", "WIN-3 WIN-4 WIN-5 WIN-6", f"""WITH {S10} SELECT site, ts,
{', '.join(rd(_roll_sql(k, s), f'{s}{k}', 4) for k, s in _ROLL)} FROM s10""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", *[rc(wn.rolling("rain" if s == "sum" else "ghi", k, s, w), f"{s}{k}", 4) for k, s in _ROLL])
    return series(t, f, back=18).select("site", "ts", *[f"{s}{k}" for k, s in _ROLL])


@query("win_history_complete", "WIN-7 WIN-20 WIN-21", f"""WITH {S10}, x AS (SELECT *,
sum(CASE WHEN ghi IS NOT NULL THEN 1 ELSE 0 END) {frame(-18, -1)} AS behind,
sum(CASE WHEN ghi IS NOT NULL THEN 1 ELSE 0 END) {frame(1, 6)} AS ahead FROM s10)
SELECT site, ts, CAST(behind AS BIGINT) AS behind, CAST(ahead AS BIGINT) AS ahead,
CASE WHEN behind = 18 THEN 1 ELSE 0 END AS has_history, CASE WHEN ahead = 6 THEN 1 ELSE 0 END AS has_future FROM x""")
def _(t: Tables):
    def f(g, w):
        ok = C("ghi").isNotNull()
        return g.select("*", wn.valid_behind(ok, 18, w).alias("behind"), wn.valid_within(ok, -1, 6, w).alias("ahead"))
    return series(t, f, back=18, ahead=6).select("site", "ts", "behind", "ahead", ex.flag(C("behind") == 18).alias("has_history"),
                                                 ex.flag(C("ahead") == 6).alias("has_future"))


_MIN = [(3, 2), (4, 2), (6, 3), (12, 6), (18, 9)]


@query("win_min_periods", "WIN-8 WIN-9 WIN-10 WIN-25", f"""WITH {S10} SELECT site, ts,
{', '.join(rd(f'CASE WHEN count(cot) {frame(-k + 1, 0)} >= {m} THEN avg(cot) {frame(-k + 1, 0)} END', f'm{m}of{k}') for k, m in _MIN)},
{rd(f'CASE WHEN count(ghi) {frame(-5, 0)} = 6 THEN avg(ghi) {frame(-5, 0)} END', 'full6')},
{rd(f'CASE WHEN count(ghi) {frame(-6, -1)} >= 3 THEN avg(ghi) {frame(-6, -1)} END', 'past6')},
{rd(f'coalesce(stddev_samp(ghi) {frame(-5, 0)}, 0.0::DOUBLE)', 'std0', 4)} FROM s10""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", *[rc(wn.rolling("cot", k, "mean", w, min_periods=m), f"m{m}of{k}") for k, m in _MIN],
                        rc(wn.rolling("ghi", 6, "mean", w, min_periods=6), "full6"),
                        rc(wn.rolling("ghi", 6, "mean", w, min_periods=3, skip_current=True), "past6"),
                        rc(wn.rolling_std_or_zero("ghi", 6, w), "std0", 4))
    return series(t, f, back=18).select("site", "ts", *[f"m{m}of{k}" for k, m in _MIN], "full6", "past6", "std0")


@query("win_differences", "WIN-14", f"""WITH {S10} SELECT site, ts, {rd(f'ghi - lag(ghi, 1) {W}', 'd1')}, {rd(f'ghi - lag(ghi, 3) {W}', 'd3')},
{rd(f'coalesce(ghi - lag(ghi, 1) {W}, 0.0::DOUBLE)', 'd1z')} FROM s10""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", rc(wn.diff("ghi", 1, w), "d1"), rc(wn.diff("ghi", 3, w), "d3"), rc(wn.diff("ghi", 1, w, head=0.0), "d1z"))
    return series(t, f, back=3).select("site", "ts", "d1", "d3", "d1z")


@query("win_gap_guarded", "WIN-15 WIN-16 WIN-17 SOL-24", f"""WITH {OBS}, {cells_sql()}, x AS (SELECT *,
lag(ts, 1) {W} AS t1, lag(ts, 3) {W} AS t3, lead(ts, 6) {W} AS f6, lag(ghi, 1) {W} AS g1, lag(ghi, 3) {W} AS g3, lead(ghi, 6) {W} AS h6,
lag(dhi / greatest(ghi, 20), 3) {W} AS kd3 FROM c10)
SELECT site, ts, {rd('CASE WHEN abs(epoch(ts - t1) - 600) <= 90 THEN g1 END', 'lag1')},
{rd('CASE WHEN abs(epoch(ts - t3) - 1800) <= 300 THEN ghi - g3 END', 'delta3')},
{rd('CASE WHEN abs(epoch(f6 - ts) - 3600) <= 30 THEN h6 END', 'strict_lead6')},
{rd('CASE WHEN abs(epoch(ts - t3) - 1800) <= 300 THEN dhi / greatest(ghi, 20) - kd3 END', 'kd_delta3')} FROM x""")
def _(t: Tables):
    # Row lags over the un-gridded bins, as the guarded form is meant for.
    def f(g, w):
        kd = C("dhi") / ex.floor_at("ghi", 20.0)
        return g.select("*", rc(wn.guarded_lag("ghi", 1, w, step_s=600, tolerance_s=90), "lag1"),
                        rc(C("ghi") - wn.guarded_lag("ghi", 3, w, step_s=600, tolerance_s=300), "delta3"),
                        rc(wn.guarded_lead("ghi", 6, w, step_s=600, tolerance_s=30), "strict_lead6"),
                        rc(kd - wn.guarded_lag(kd, 3, w, step_s=600, tolerance_s=300), "kd_delta3"))
    # A guarded lag that reaches further than k steps + tolerance is NULL anyway,
    # so a halo of that size gives the same result as the whole series.
    out = halo_windows(cells(t), f, width_s=7 * tl.DAY, back_s=1800 + 300, ahead_s=3600 + 30)
    return out.select("site", "ts", "lag1", "delta3", "strict_lead6", "kd_delta3")


@query("win_no_break_prefix", "WIN-18 ANC-6", f"""WITH {OBS}, {cells_sql()}, b AS (SELECT site, ts,
CASE WHEN epoch(ts - lag(ts) {W}) = 600 THEN 0 ELSE 1 END AS brk FROM c10),
c AS (SELECT *, sum(brk) OVER (PARTITION BY site ORDER BY ts) AS cum FROM b)
SELECT site, ts, CAST(cum AS BIGINT) AS cum, CASE WHEN lead(cum, 6) {W} - lag(cum, 17) {W} = 0 THEN 1 ELSE 0 END AS unbroken FROM c""")
def _(t: Tables):
    c = materialize(cells(t).select("site", "ts"))
    prev = carry_last(c, {"_prev": C("ts")}, width_s=7 * tl.DAY, include_current=False)
    brk = prev.select("site", "ts", F.when(tl.seconds_between("ts", "_prev") == 600.0, 0).otherwise(1).alias("brk"))
    cum = running_total(brk, {"cum": C("brk")}, width_s=7 * tl.DAY)
    def f(g, w):
        return g.withColumn("unbroken", ex.flag(wn.lead("cum", 6, w) - wn.lag("cum", 17, w) == 0))
    return row_windows(cum, f, back=17, ahead=6, width_s=7 * tl.DAY).select("site", "ts", "cum", "unbroken")


@query("win_step_continuity", "WIN-19 WIN-20 ANC-3", f"""WITH {OBS}, {cells_sql()}, x AS (SELECT site, ts, epoch(ts - lag(ts) {W}) AS step FROM c10)
SELECT site, ts, CASE WHEN count(step) {frame(-18, 0)} = 19 AND min(step) {frame(-18, 0)} = 600 AND max(step) {frame(-18, 0)} = 600 THEN 1 ELSE 0 END AS strict19,
CASE WHEN sum(CASE WHEN step BETWEEN 570 AND 630 THEN 1 ELSE 0 END) {frame(-17, 0)} = 18 THEN 1 ELSE 0 END AS tolerant18 FROM x""")
def _(t: Tables):
    def f(g, w):
        g = g.withColumn("step", wn.step_seconds(w))
        fr = w.rowsBetween(-18, 0)
        strict = (F.count("step").over(fr) == 19) & (F.min("step").over(fr) == 600) & (F.max("step").over(fr) == 600)
        tol = wn.valid_within(C("step").between(570, 630), 17, 0, w) == 18
        return g.select("site", "ts", "_chunk", "_home", ex.flag(strict).alias("strict19"), ex.flag(tol).alias("tolerant18"))
    # 19 unbroken steps span 190 minutes; anything further back cannot change either flag.
    return halo_windows(cells(t).select("site", "ts"), f, width_s=7 * tl.DAY, back_s=20 * 600)


@query("win_runs", "WIN-22 AGG-17", f"""WITH {OBS}, q AS (SELECT site, ts, event_id, floor(value / 50) AS x FROM obs),
a AS (SELECT *, lag(x) OVER (PARTITION BY site ORDER BY ts, event_id) AS p FROM q),
b AS (SELECT *, sum(CASE WHEN x = p THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT site, run, min(x) AS x, count(*) AS n FROM b GROUP BY 1, 2)
SELECT site, CAST(n AS BIGINT) AS run_length, count(*) AS runs FROM c GROUP BY 1, 2""")
def _(t: Tables):
    from skycadence.operators.quality import run_lengths
    q = observations(t).select("site", "ts", "event_id", F.floor(C("value") / 50).cast("double").alias("x"))
    r = run_lengths(q, "x", order=("ts", "event_id"), width_s=tl.DAY)
    return r.groupBy("site", C("n").alias("run_length")).agg(F.count(F.lit(1)).alias("runs"))


@query("win_lag_valid_rows", "WIN-23", f"""WITH {OBS}, r AS (SELECT site, ts, event_id, k * 0.09375::DOUBLE AS oktas FROM obs WHERE event_type = 'signup')
SELECT site, ts, event_id, {', '.join(rd(f'lag(oktas, {k}) OVER (PARTITION BY site ORDER BY ts, event_id)', f'lag{k}') for k in (1, 2, 3))},
{rd('epoch(ts - lag(ts) OVER (PARTITION BY site ORDER BY ts, event_id)) / 60.0::DOUBLE', 'gap_min_prev', 4)} FROM r""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", *[rc(wn.lag("oktas", k, w), f"lag{k}") for k in (1, 2, 3)],
                        rc(tl.seconds_between("ts", wn.lag("ts", 1, w)) / 60.0, "gap_min_prev", 4))
    out = row_windows(reports(t), f, back=3, order=("ts", "event_id"), width_s=7 * tl.DAY)
    return out.select("site", "ts", "event_id", "lag1", "lag2", "lag3", "gap_min_prev")


@query("win_sequences", "WIN-24 SEG-2", f"""WITH {S10}, x AS (SELECT site, ts, list(round(ghi, 4)) {frame(-17, 0)} AS seq,
count(ghi) {frame(-17, 0)} AS ok, lead(ghi, 6) {W} AS y FROM s10) SELECT site, ts, array_to_string(seq, '|') AS seq, round(y, 4) AS y
FROM x WHERE ok = 18 AND y IS NOT NULL""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", wn.sequence_of(["ghi"], 18, w).alias("seq"), F.count("ghi").over(w.rowsBetween(-17, 0)).alias("ok"),
                        wn.lead("ghi", 6, w).alias("y"))
    s = series(t, f, back=18, ahead=6).where((C("ok") == 18) & C("y").isNotNull())
    return s.select("site", "ts", F.array_join(F.transform("seq", lambda e: F.round(e["ghi"], 4).cast("string")), "|").alias("seq"),
                    F.round("y", 4).alias("y"))


# ---- solar geometry -----------------------------------------------------------

_E = elev_sql()
_UTC = f"(ts - INTERVAL 7 HOUR)"
_LATR = f"radians({case_sql('lat')})"
_DECL_UTC = f"radians(23.45::DOUBLE * sin(radians(360.0::DOUBLE * (284.0::DOUBLE + dayofyear({_UTC})) / 365.0::DOUBLE)))"
_HA_UTC = f"radians((extract(hour FROM {_UTC}) + extract(minute FROM {_UTC}) / 60.0::DOUBLE + {case_sql('lon')} / 15.0::DOUBLE - 12.0::DOUBLE) * 15.0::DOUBLE)"
_E_UTC = f"greatest(degrees(asin(least(greatest(sin({_LATR}) * sin({_DECL_UTC}) + cos({_LATR}) * cos({_DECL_UTC}) * cos({_HA_UTC}), -1::DOUBLE), 1::DOUBLE))), 0::DOUBLE)"


@query("sol_elevation", "SOL-1 SOL-2", f"""WITH {S10} SELECT site, ts, {rd(_E, 'elev', 5)}, {rd(_E_UTC, 'elev_utc', 5)} FROM s10""")
def _(t: Tables):
    utc = so.elevation_deg_utc("ts", per_site(SITES, "lat"), per_site(SITES, "lon"))
    return series(t).select("site", "ts", rc(elevation(), "elev", 5), rc(utc, "elev_utc", 5))


_S = "greatest(sin(radians(e)), 0::DOUBLE)"


@query("sol_clear_sky_forms", "SOL-3 SOL-4 SOL-5 SOL-6", f"""WITH {S10}, x AS (SELECT *, {_E} AS e FROM s10)
SELECT site, ts, {rd(f'1100 * {_S}', 'flat', 4)}, {rd(f'greatest(950 * power({_S}, 1.1), 1)', 'power', 4)}, {rd(f'950 * power({_S}, 1.1)', 'power_dark', 4)},
{rd('1366.1 * (1 + 0.033 * cos(2 * pi() * dayofyear(ts) / 365.0)) * sin(radians(e))', 'toa', 4)},
{rd(f'950 * power({_S}, 1.1) * power(5.0 / (3.0 + oktas), 0.15) * exp(-1.5 * oktas / 10.0)', 'attenuated', 4)} FROM x""")
def _(t: Tables):
    s = series(t).withColumn("e", elevation())
    return s.select("site", "ts", *[rc(so.clear_sky("e", k), k, 4) for k in ("flat", "power", "power_dark")],
                    rc(so.clear_sky("e", "toa", doy=F.dayofyear("ts")), "toa", 4),
                    rc(so.clear_sky("e", "attenuated", water=F.lit(3.0) + C("oktas"), aerosol=C("oktas") / 10.0), "attenuated", 4))


@query("sol_clearness_forms", "SOL-7 SOL-8 SOL-9 SOL-10", f"""WITH {S10}, x AS (SELECT *, {_E} AS e FROM s10)
SELECT site, ts, {rd(f'ghi / greatest(1100 * {_S}, 20)', 'kt_now', 5)},
{rd('ghi / greatest(1100 * greatest(sin(radians(e)), 0.02), 20)', 'kt_point', 5)},
{rd(f'CASE WHEN ghi IS NULL THEN NULL ELSE least(greatest(ghi / greatest(1100 * {_S}, 20), 0), 1.3) END', 'kt_13', 5)},
{rd(f'CASE WHEN e <= 0 THEN 0 WHEN ghi IS NULL THEN NULL ELSE least(greatest(ghi / greatest(1100 * {_S}, 20), 0), 1.2) END', 'kt_12_dark', 5)},
{rd('CASE WHEN e > 5 THEN ghi / nullif(1366.1 * (1 + 0.033 * cos(2 * pi() * dayofyear(ts) / 365.0)) * sin(radians(e)), 0) END', 'kt_toa', 5)} FROM x""")
def _(t: Tables):
    s = series(t).withColumn("e", elevation())
    cs = so.clear_sky("e")
    return s.select("site", "ts", rc(so.clearness("ghi", cs), "kt_now", 5), rc(so.clearness_point("ghi", "e"), "kt_point", 5),
                    rc(so.clearness("ghi", cs, upper=1.3), "kt_13", 5),
                    rc(so.clearness("ghi", cs, upper=1.2, dark_zero=C("e") <= 0), "kt_12_dark", 5),
                    rc(so.clearness_toa("ghi", "e", F.dayofyear("ts")), "kt_toa", 5))


def _cs_sql(k):
    return f"1100 * greatest(sin(radians({elev_sql(f'(ts + INTERVAL {k * 10} MINUTE)')})), 0::DOUBLE)"


@query("sol_future_and_smart_persistence", "SOL-11 SOL-12 SOL-13", f"""WITH {S10}, x AS (SELECT site, ts, ghi, {_E} AS e,
{', '.join(f'{_cs_sql(k)} AS cs{k}' for k in range(1, 7))} FROM s10), y AS (SELECT *, ghi / greatest(1100 * {_S}, 20) AS kt, 1100 * {_S} AS cs0,
{_S} AS s0, cs6 / 1100 AS s6 FROM x)
SELECT site, ts, {', '.join(rd(f'cs{k}', f'cs{k}', 4) for k in range(1, 7))}, {rd('kt * cs6', 'sp', 4)}, {rd('kt * (cs1 + cs2 + cs3 + cs4 + cs5 + cs6) / 6', 'sp_avg', 4)},
{rd('ghi * CASE WHEN s0 > 0.05 THEN s6 / s0 ELSE 1 END', 'sine_ratio', 4)}, {rd('CASE WHEN cs0 > 10 THEN ghi * cs6 / cs0 ELSE ghi END', 'cs_ratio', 4)} FROM y""")
def _(t: Tables):
    s = series(t).select("site", "ts", "ghi", elevation().alias("e"),
                         *[so.clear_sky(elevation(600 * k)).alias(f"cs{k}") for k in range(1, 7)])
    cs0 = so.clear_sky("e")
    kt = so.clearness("ghi", cs0)
    mean = sum([C(f"cs{k}") for k in range(2, 7)], C("cs1")) / 6.0
    return s.select("site", "ts", *[rc(C(f"cs{k}"), f"cs{k}", 4) for k in range(1, 7)], rc(kt * C("cs6"), "sp", 4), rc(kt * mean, "sp_avg", 4),
                    rc(so.persistence_by_sine("ghi", ex.floor_at(so.sin_elev("e"), 0.0), C("cs6") / 1100.0), "sine_ratio", 4),
                    rc(so.persistence_by_clear_sky("ghi", cs0, C("cs6")), "cs_ratio", 4))


@query("sol_cyclic_and_season", "SOL-14 SOL-15", f"""WITH {S10} SELECT site, ts,
{rd('sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0)', 'hs')}, {rd('cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0)', 'hc')},
{rd('sin(2 * pi() * dayofyear(ts) / 365.0)', 'd365')}, {rd('sin(2 * pi() * dayofyear(ts) / 365.25)', 'd36525')}, {rd('cos(2 * pi() * month(ts) / 12.0)', 'mc')},
{rd('sin(2 * pi() * (hour(ts + INTERVAL 1 HOUR) + minute(ts) / 60.0) / 24.0)', 'hs60')},
CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'dry' ELSE 'wet' END AS season2,
CASE WHEN month(ts) IN (12, 1, 2) THEN 'wet' WHEN month(ts) IN (6, 7, 8, 9) THEN 'dry' ELSE 'transition' END AS season3 FROM s10""")
def _(t: Tables):
    ts = C("ts")
    hs, hc = so.cyclic(tl.clock_hours(ts), 24)
    return series(t).select("site", "ts", rc(hs, "hs"), rc(hc, "hc"), rc(so.cyclic(F.dayofyear(ts), 365)[0], "d365"),
                            rc(so.cyclic(F.dayofyear(ts), 365.25)[0], "d36525"), rc(so.cyclic(F.month(ts), 12)[1], "mc"),
                            rc(so.cyclic(tl.clock_hours(tl.shift(ts, 3600)), 24)[0], "hs60"),
                            so.season_two(F.month(ts)).alias("season2"), so.season_three(F.month(ts)).alias("season3"))


@query("sol_wind_direction", "SOL-14", f"""SELECT event_id, {rd('sin(radians(wd))','ws')}, {rd('cos(radians(wd))','wc')}
FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) * 3.625::DOUBLE AS wd FROM events WHERE event_type = 'click')""")
def _(t: Tables):
    w = weather(t).where(C("site") == "all")
    return w.select("event_id", rc(F.sin(F.radians("wd")), "ws"), rc(F.cos(F.radians("wd")), "wc"))


@query("sol_acceleration_and_deltas", "SOL-16 SOL-17 SOL-20 SOL-23", f"""WITH {S10}, x AS (SELECT *, {_E} AS e,
{', '.join(f'lag(ghi, {k}) {W} AS l{k}' for k in (1, 2, 3, 6, 12, 18))}, avg(ghi) {frame(-5, 0)} AS m6, lag(temp, 3) {W} AS t3 FROM s10)
SELECT site, ts, {rd('ghi - 2 * l1 + l2', 'accel20', 4)}, {rd('ghi - 2 * l3 + l6', 'accel60', 4)}, {rd('ghi - l6', 'd60', 4)}, {rd('ghi - m6', 'd_mean', 4)},
{rd('greatest(l1, l2, l3) - least(l1, l2, l3)', 'lag_range', 4)}, {rd('m6 - ghi', 'revert', 4)}, {rd(f'e - lag(e, 1) {W}', 'd_elev', 4)},
{rd('ghi - (l6 + l12 + l18) / 3', 'trend_long', 4)} FROM x""")
def _(t: Tables):
    def f(g, w):
        g = g.withColumn("e", elevation())
        g = g.select("*", *[wn.lag("ghi", k, w).alias(f"l{k}") for k in (1, 2, 3, 6, 12, 18)], wn.rolling("ghi", 6, "mean", w).alias("m6"),
                     wn.diff("e", 1, w).alias("de"), wn.mean_of_lags("ghi", (6, 12, 18), w).alias("lm"))
        return g
    s = series(t, f, back=18)
    return s.select("site", "ts", rc(so.acceleration("ghi", "l1", "l2"), "accel20", 4), rc(so.acceleration("ghi", "l3", "l6"), "accel60", 4),
                    rc(C("ghi") - C("l6"), "d60", 4), rc(C("ghi") - C("m6"), "d_mean", 4),
                    rc(ex.row_max("l1", "l2", "l3") - ex.row_min("l1", "l2", "l3"), "lag_range", 4), rc(C("m6") - C("ghi"), "revert", 4),
                    rc(C("de"), "d_elev", 4), rc(C("ghi") - C("lm"), "trend_long", 4))


@query("sol_ratios_and_interactions", "SOL-18 SOL-19 SOL-21 SOL-22", f"""WITH {S10}, x AS (SELECT *, {_E} AS e, lag(ghi) {W} AS l1, avg(ghi) {frame(-2, 0)} AS m3,
stddev_samp(ghi) {frame(-2, 0)} AS s3 FROM s10) SELECT site, ts, {rd('dhi / greatest(ghi, 20)', 'kd', 5)}, {rd('CASE WHEN ghi >= 10 THEN dhi / ghi END', 'kd_strict', 5)},
{rd('ghi / greatest(l1, 20)', 'ramp', 5)}, {rd('s3 / greatest(m3, 20)', 'norm_std', 5)}, {rd('cot * temp', 'cot_temp', 4)},
{rd(f'1100 * {_S} / (1 + 0.09 * cot)', 'cs_cloud', 4)}, {rd(f'cot * (ghi / greatest(1100 * {_S}, 20))', 'cot_kt', 4)},
CASE WHEN oktas <= 2 THEN 1 ELSE 0 END AS sky_clear, CASE WHEN oktas > 2 AND oktas <= 5 THEN 1 ELSE 0 END AS sky_part,
CASE WHEN oktas > 5 AND oktas < 8 THEN 1 ELSE 0 END AS sky_most, CASE WHEN oktas >= 8 THEN 1 ELSE 0 END AS sky_over FROM x""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", elevation().alias("e"), wn.lag("ghi", 1, w).alias("l1"), wn.rolling("ghi", 3, "mean", w).alias("m3"),
                        wn.rolling("ghi", 3, "std", w).alias("s3"))
    s = series(t, f, back=3)
    from skycadence.functions.weather import sky_flags
    cs = so.clear_sky("e")
    return s.select("site", "ts", rc(C("dhi") / F.greatest(C("ghi"), F.lit(20.0)), "kd", 5),
                    rc(F.when(C("ghi") >= 10, C("dhi") / C("ghi")), "kd_strict", 5),
                    rc(C("ghi") / F.greatest(C("l1"), F.lit(20.0)), "ramp", 5), rc(C("s3") / F.greatest(C("m3"), F.lit(20.0)), "norm_std", 5),
                    rc(C("cot") * C("temp"), "cot_temp", 4), rc(cs / (1.0 + 0.09 * C("cot")), "cs_cloud", 4),
                    rc(C("cot") * so.clearness("ghi", cs), "cot_kt", 4), *sky_flags("oktas"))


@query("sol_cloud_and_weather_codes", "SOL-21 PRJ-6", """WITH c AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS ww FROM events)
SELECT event_id, CASE WHEN ww IN (3, 9) THEN 1 ELSE 0 END AS is_cb, CASE WHEN ww IN (1, 2, 8) THEN 1 ELSE 0 END AS is_cu,
CASE WHEN ww IN (4, 5) THEN 1 ELSE 0 END AS is_sc, CASE WHEN ww BETWEEN 50 AND 99 THEN 1 ELSE 0 END AS is_rain,
CASE WHEN ww IN (17, 29) OR ww BETWEEN 95 AND 99 THEN 1 ELSE 0 END AS is_thunder, CASE WHEN ww % 10 BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS past_rain FROM c""")
def _(t: Tables):
    from skycadence.functions.weather import cloud_type_flags, weather_code_flags
    o = observations(t).where(C("site") == "all")
    return o.select("event_id", *cloud_type_flags(C("k")), *weather_code_flags(C("k"), C("k") % 10))


# ---- feature tables -----------------------------------------------------------

def wide(t: Tables):
    o = observations(t)
    return ft.wide_table(radiation(t), cloud(t), weather(t), reports(t), elevation(), series_bounds(o, 600))


# SQL of every field of a source over ``obs``, and which rows are the source's.
_ONLY = {"radiation": "true", "cloud": "event_type = 'purchase'", "weather": "event_type = 'click'", "report": "event_type = 'signup'"}
_FIELDS = {
    "radiation": {"ghi": "value * 10.0", "dhi": "value * k / 8.0", "dni": "value * 8.0", "reflected": "value * 2.0",
                  "net": "value * 10.0 - value * 2.0", "elevation": elev_sql(), "good": "event_id % 4 = 0"},
    "cloud": {"cot": "value / 4.0", "cth": "k * 100.0", "ctt": "300.0 - k", "cer": "5.0 + k / 8.0", "present": "value > 20",
              "clear": "value < 8", "thin": "value BETWEEN 8 AND 23.99", "moderate": "value BETWEEN 24 AND 59.99", "thick": "value >= 60"},
    "weather": {"temp": "20.0 + k / 8.0", "rh": "value", "pressure": "1000.0 + k / 8.0", "ws": "k / 16.0", "ws_max": "k / 8.0",
                "wd": "k * 3.625", "rain": "value / 128.0", "sr": "value * 9.0"},
    "report": {"temp": "22.0 + k / 8.0", "dewpoint": "15.0 + k / 16.0", "rh": "value", "wind": "k / 8.0", "wind_dir": "k * 3.625",
               "visibility": "10.0 - k / 16.0", "rain24": "value / 8.0", "rad24": "value * 3.0"}}


def _statistic_sql(source: str, field: str, how: str) -> str:
    x, only = _FIELDS[source][field], f"FILTER (WHERE {_ONLY[source]})"
    return {"rows": f"count(*) {only}", "hits": f"count_if({x})::BIGINT", "any": f"max(({x})::INT) {only}"}.get(
        how) or f"{'avg' if how == 'mean' else how}(({x})::DOUBLE) {only}"


_PLAIN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def _history_sql(e, now: str, past: str | None = None) -> str:
    past = past or now
    back = f"lag({past}, {e.steps}) {W}"
    made = {"lag": back, "lead": f"lead({past}, {e.steps}) {W}", "delta": f"{now} - {back}",
            "apart": f"{now} - avg({past}) {frame(1 - e.steps, 0)}", "accel": f"{now} - 2 * {back} + lag({past}, {2 * e.steps}) {W}"}
    return f"{made.get(e.how) or f'{_PLAIN[e.how]}({past}) {frame(1 - e.steps, 0)}'} AS {e.name}"


# Every binned measure of every source from one conditional aggregate over all readings, on the complete grid.
def _binned_sql(names) -> str:
    picked = [m for m in sp.MEASURES if m[0] in names]
    return f"""{OBS},
binned AS (SELECT site, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, {', '.join(f'{_statistic_sql(*m[1:])} AS {m[0]}' for m in picked)}
  FROM obs GROUP BY ALL),
slots AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL 10 MINUTE)) AS ts FROM binned GROUP BY site),
grid AS (FROM slots LEFT JOIN binned USING (site, ts))"""


_WIDE_MEASURES = [m[0] for m in sp.MEASURES if m[1] != "report"]
_REPORTED = [m for m in sp.MEASURES if m[1] == "report"]
_WIDE_FLOATS = (["hour_sin", "hour_cos", "month_sin", "month_cos"]
                + [m[0] for m in sp.MEASURES if m[3] in ("mean", "min", "max", "sum", "latest")] + [e.name for e in sp.HISTORY if e.source != "ts"])
_TURN = {"hour": "(hour(ts_wib) + minute(ts_wib) / 60.0::DOUBLE) / 24", "month": "month(ts_wib) / 12.0::DOUBLE"}
WIDE_SQL = f"""{_binned_sql(_WIDE_MEASURES)},
said AS (SELECT site, ts AS said_at, {', '.join(f'({_FIELDS["report"][m[2]]})::DOUBLE AS {m[0]}' for m in _REPORTED)} FROM obs WHERE {_ONLY['report']}),
known AS (SELECT grid.*, {', '.join(f'CASE WHEN grid.ts - said_at <= INTERVAL 6 HOUR THEN {m[0]} END AS {m[0]}' for m in _REPORTED)}
  FROM grid ASOF LEFT JOIN said ON grid.site = said.site AND grid.ts >= said_at),
past AS (SELECT *, {', '.join(_history_sql(e, e.source) for e in sp.HISTORY)}, count(ghi_now) {frame(-18, -1)} = 18 AS whole FROM known),
fin AS (SELECT * EXCLUDE (whole, ts), ts AS ts_wib, ts + INTERVAL 1 HOUR AS target_ts_wib, {', '.join(f'{p}(ts_wib) AS {p}' for p in ('year', 'month', 'day', 'hour', 'minute'))},
  {', '.join(f'{f}(2 * pi() * {at}) AS {n}_{f}' for n, at in _TURN.items() for f in ('sin', 'cos'))},
  {', '.join(f"{shown} IS NOT NULL AS {has}, if({shown} IS NULL, 'missing', 'ok') AS {state}" for has, state, shown in sp.SOURCES.values())},
  coalesce((solar_elev_deg > 0)::INT, 0) AS daylight_flag, coalesce((solar_elev_deg > 5)::INT, 0) AS sun_above_5deg_flag,
  whole::INT AS has_continuous_3h_history, (whole AND ghi_now IS NOT NULL AND target_ghi_1h_ahead IS NOT NULL)::INT AS is_model_ready,
  if(ghi_now IS NULL, 'missing_radiation', if(clp_cot IS NULL, 'partial_no_clp', 'ok')) AS master_qc_status FROM past)"""


@query("feature_table_wide", "JN-2 JN-7 RSM-2 WIN-1 WIN-2 WIN-3 WIN-4 WIN-5 WIN-6 WIN-7 ANC-5 AGG-7",
       f"WITH {WIDE_SQL} SELECT * REPLACE ({', '.join(rd(c, c) for c in _WIDE_FLOATS)}) FROM fin")
def _(t: Tables):
    return round_all(wide(t), _WIDE_FLOATS, 6)


def recipe(t: Tables, ready_only: bool = True, extra=()):
    rad = ft.radiation_cells(radiation(t), elevation()).select("site", "ts", "ghi_now")
    return ft.recipe50([rad, ft.cloud_cells(cloud(t))], series_bounds(observations(t), 600), elevation, ready_only=ready_only, extra=extra)


_PAST = {"ghi": ("ghi_now", "ghi_now"), "kt": ("kt_now", "kt_point"), "cot": ("clp_cot", "clp_cot")}
_SKY = "1100 * greatest(sin(radians(solar_elev_deg)), {})"
_WAVES = {"hour": "(hour(ts) + minute(ts) / 60.0::DOUBLE) / 24", "doy": "dayofyear(ts) / 365.25", "month": "month(ts) / 12.0"}
RECIPE_SQL = f"""{_binned_sql(['ghi_now', 'clp_cot', 'clp_cth_m', 'clp_ctt_k', 'clp_cer', 'clp_cloud_present'])},
sun AS (SELECT *, {elev_sql()} AS solar_elev_deg FROM grid),
ratio AS (SELECT *, ghi_now / greatest({_SKY.format(0.02)}, 20) AS kt_point, ghi_now / greatest({_SKY.format(0)}, 20) AS kt_now FROM sun),
past AS (SELECT *, {', '.join(_history_sql(e, *_PAST[e.source]) for e in sp.RECIPE if e.source in _PAST and e.how != 'now')},
  {', '.join(f'lead(ghi_now, {k}) {W} AS f{k}' for k in range(1, 7))}, count(ghi_now) {frame(-18, -1)} AS n_back FROM ratio),
ready AS (SELECT *, solar_elev_deg AS e, [f1, f2, f3, f4, f5, f6] AS fs, [{', '.join(_cs_sql(k) for k in range(1, 7))}] AS skies FROM past
  WHERE n_back = 18 AND ghi_now BETWEEN 0 AND 1400 AND f6 IS NOT NULL AND solar_elev_deg > 5),
recipe AS (SELECT *, {', '.join(f'{f}(2 * pi() * {at}) AS {n}_{f}' for n, at in _WAVES.items() for f in ('sin', 'cos'))},
  skies[6] AS ghi_cs_t60, skies[6] / 1100 AS elev_sin_t60, kt_now * skies[6] AS smart_persist, kt_now * list_avg(skies) AS smart_persist_avg,
  f6 AS ghi_point_t60, f6 - ghi_now AS delta_point, if(len(list_filter(fs, lambda x: x BETWEEN 0 AND 1400)) = 6, list_avg(fs), NULL) AS ghi_avg_t10_t60,
  ghi_avg_t10_t60 - ghi_now AS delta_avg FROM ready)"""
RECIPE_COLS = ["site", "ts", *FEATURES, "ghi_point_t60", "ghi_avg_t10_t60", "delta_point", "delta_avg", "solar_elev_deg"]
_RF = [c for c in RECIPE_COLS if c not in ("site", "ts", "clp_cloud_present")]


@query("recipe_50_features", "SOL-1 SOL-3 SOL-7 SOL-8 SOL-11 SOL-12 SOL-14 SOL-16 SOL-17 TGT-1 TGT-2 TGT-3 PRJ-8 PRJ-9",
       f"WITH {RECIPE_SQL} SELECT site, ts, clp_cloud_present, {', '.join(rd(c, c, 4) for c in _RF)} FROM recipe")
def _(t: Tables):
    return round_all(recipe(t), _RF, 4)
