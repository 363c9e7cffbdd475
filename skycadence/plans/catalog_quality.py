"""Queries over audits, repair, imputation and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import exprs as ex
from skycadence.functions import solar as so
from skycadence.functions import timeline as tl
from skycadence.operators import impute as im
from skycadence.operators import quality as ql
from skycadence.operators import windows as wn
from skycadence.operators.anchors import segments
from skycadence.plans.catalog_series import _DAILY_CTE, daily
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, W, cells, cells_sql, elev_sql, elevation, frame, observations, rc, rd,
                                       round_all, series)
from skycadence.sources.sinks import materialize
from skycadence.spec import SENTINELS

C = F.col
_E = elev_sql()
KT = "ghi / greatest(1100 * greatest(sin(radians(e)), 0.02), 20)"
DAY_SQL = f"dd AS (SELECT *, {KT} AS kt FROM (SELECT *, {_E} AS e FROM s10) WHERE e > 5)"
CELL_DAY_SQL = f"dd AS (SELECT *, {KT} AS kt FROM (SELECT *, {_E} AS e FROM c10) WHERE e > 5)"


def day_cells(t: Tables):
    d = cells(t).withColumn("elev", elevation()).where(C("elev") > 5)
    return d.withColumn("kt", so.clearness_point("ghi", "elev"))


@query("qc_closure", "QC-2", f"""WITH {OBS}, {cells_sql()}, {CELL_DAY_SQL}, z AS (SELECT site, abs(dhi + dni * sin(radians(e)) - ghi) / greatest(ghi, 20) AS err FROM dd)
SELECT site, count(*) AS n_checked, {rd('100.0::DOUBLE * avg(CASE WHEN err > 0.15 THEN 1.0::DOUBLE ELSE 0 END)', 'violation_pct')} FROM z WHERE err IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return round_all(ql.closure_report(day_cells(t)), ["violation_pct"])


_SENT = ", ".join(str(x) for x in SENTINELS)


@query("qc_sentinels", "QC-3", " UNION ALL ".join(f"""SELECT l_returnflag AS site, '{c}' AS "column", count({c}) AS n_nonnull, count(*) FILTER (WHERE {c} IN ({_SENT})) AS sentinel_n,
{rd(f'100.0::DOUBLE * count(*) FILTER (WHERE {c} IN ({_SENT})) / greatest(count({c}), 1)', 'sentinel_pct')} FROM lineitem GROUP BY 1""" for c in ("l_orderkey", "l_partkey", "l_quantity")))
def _(t: Tables):
    li = t.lineitem.select(C("l_returnflag").alias("site"), *[C(c).cast("double").alias(c) for c in ("l_orderkey", "l_partkey", "l_quantity")])
    return round_all(ql.sentinel_report(li, ["l_orderkey", "l_partkey", "l_quantity"], SENTINELS, by=["site"]), ["sentinel_pct"])


def _stuck_sql(c):
    return f"""SELECT site, '{c}' AS "column", CAST(coalesce(sum(CASE WHEN x IS NOT NULL THEN m END), 0) AS BIGINT) AS n_nonnull, CAST(coalesce(sum(CASE WHEN m >= 3 AND x <> 0 THEN m END), 0) AS BIGINT) AS stuck_n
FROM (SELECT site, run, max(x) AS x, count(*) AS m FROM (SELECT *, sum(CASE WHEN x = p THEN 0 ELSE 1 END) {W} AS run FROM (SELECT site, ts, floor({c} / 200) AS x, lag(floor({c} / 200)) {W} AS p FROM dd)) GROUP BY 1, 2) GROUP BY 1"""


@query("qc_stuck_runs", "QC-4 WIN-22", f"WITH {OBS}, {cells_sql()}, {CELL_DAY_SQL} " + " UNION ALL ".join(_stuck_sql(c) for c in ("ghi", "dni", "cot")))
def _(t: Tables):
    # Coarse steps make equal neighbours common, so that runs exist to be found.
    d = materialize(day_cells(t).select("site", "ts", *[F.floor(C(c) / 200).cast("double").alias(c) for c in ("ghi", "dni", "cot")]))
    return ql.stuck_report(d, ["ghi", "dni", "cot"], min_run=3)


@query("qc_volatility", "QC-5", f"""WITH {OBS}, {cells_sql()}, {CELL_DAY_SQL}, p AS (SELECT *, lag(kt) {W} AS pk, lag(cot) {W} AS pc FROM dd)
SELECT site, {rd('avg(abs(kt - pk)) / stddev_samp(kt)', 'vol_target')}, {rd('avg(abs(cot - pc)) / stddev_samp(cot)', 'vol_feature')},
{rd('avg(abs(kt - pk)) / stddev_samp(kt) / (avg(abs(cot - pc)) / stddev_samp(cot))', 'vol_ratio')} FROM p GROUP BY 1""")
def _(t: Tables):
    return round_all(ql.volatility_report(day_cells(t), "kt", "cot"), ["vol_target", "vol_feature", "vol_ratio"])


_LAGS = list(range(-60, 61, 10))
_XC_SQL = f"""x AS (SELECT *, {KT} AS kt FROM (SELECT *, {_E} AS e FROM s10)), y AS (SELECT site, e, cot, {', '.join(f'lead(kt, {m // 10}) {W} AS k{i}' for i, m in enumerate(_LAGS))} FROM x),
c AS ({' UNION ALL '.join(f'SELECT site, {m} AS lag_min, count(*) FILTER (WHERE cot IS NOT NULL AND k{i} IS NOT NULL) AS pairs, corr(cot, k{i}) AS r FROM y WHERE e > 5 GROUP BY 1' for i, m in enumerate(_LAGS))}),
cc AS (SELECT site, lag_min, pairs, CASE WHEN pairs > 50 THEN r END AS r FROM c)"""


def cross_correlation(t: Tables):
    def f(g, w):
        g = g.withColumn("elev", elevation()).withColumn("kt", so.clearness_point("ghi", C("elev")))
        return g.select("*", *[wn.lead("kt", m // 10, w).alias(f"k{i}") for i, m in enumerate(_LAGS)])
    s = series(t, f, back=6, ahead=6).where(C("elev") > 5)
    return ql.lagged_correlation(s, "cot", {m: f"k{i}" for i, m in enumerate(_LAGS)})


@query("qc_cross_correlation", "QC-6 AGG-10", f"WITH {S10}, {_XC_SQL} SELECT site, lag_min, pairs, {rd('r', 'r')} FROM cc")
def _(t: Tables):
    return round_all(cross_correlation(t), ["r"])


@query("qc_peak_lag", "QC-6 SRT-5", f"""WITH {S10}, {_XC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs(r) DESC, lag_min) AS rn FROM cc WHERE r IS NOT NULL)
SELECT site, lag_min AS peak_lag, {rd('r', 'peak_r')} FROM k WHERE rn = 1""")
def _(t: Tables):
    return round_all(ql.peak_lag(cross_correlation(t)), ["peak_r"])


@query("qc_contradiction", "QC-7 AGG-9", f"""WITH {OBS}, {cells_sql()}, {CELL_DAY_SQL}, q AS (SELECT site, quantile_cont(cot, 0.25) AS p25, quantile_cont(cot, 0.75) AS p75 FROM dd GROUP BY 1),
j AS (SELECT dd.site, p25, p75, (cot > p75 AND kt > 0.7) OR (cot < p25 AND kt < 0.3) AS odd FROM dd JOIN q USING (site) WHERE cot IS NOT NULL AND kt IS NOT NULL)
SELECT site, count(*) AS n_checked, count(*) FILTER (WHERE odd) AS n_contradiction, {rd('100.0::DOUBLE * count(*) FILTER (WHERE odd) / count(*)', 'contradiction_pct')}, {rd('max(p25)', 'p25')}, {rd('max(p75)', 'p75')} FROM j GROUP BY 1""")
def _(t: Tables):
    return round_all(ql.contradiction_report(materialize(day_cells(t).select("site", "cot", "kt"))), ["contradiction_pct", "p25", "p75"])


@query("qc_two_products", "QC-8 JN-1", f"""WITH {OBS}, {cells_sql()}, {CELL_DAY_SQL}, b AS (SELECT site, ts, oktas < 4 AS clear FROM c10 WHERE oktas IS NOT NULL),
m AS (SELECT dd.site, kt, CAST(cp AS BOOLEAN) AS c, clear AS s FROM dd JOIN b USING (site, ts) WHERE cp IS NOT NULL), n AS (SELECT site, count(*) AS n_all FROM dd GROUP BY 1)
SELECT site, count(*) AS n_checked, {rd('100.0::DOUBLE * avg(CASE WHEN c = s THEN 1.0::DOUBLE ELSE 0 END)', 'disagreement_pct')}, {rd('100.0::DOUBLE * count(*) FILTER (WHERE c AND s AND kt > 0.7) / max(n_all)', 'false_positive_pct')}
FROM m JOIN n USING (site) GROUP BY 1""")
def _(t: Tables):
    other = cells(t).where(C("oktas").isNotNull()).select("site", "ts", (C("oktas") < 4).alias("clear"))
    out = ql.two_product_report(day_cells(t).select("site", "ts", "kt", "cp"), other, "cp", "clear", "kt")
    return round_all(out, ["disagreement_pct", "false_positive_pct"])


@query("qc_coverage_by_split", "QC-9 VIEW-2", f"""WITH {S10}, z AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split, ghi, cot, oktas FROM s10),
g AS (SELECT split, count(*) AS n, count(ghi) AS ghi, count(cot) AS cot, count(oktas) AS oktas FROM z GROUP BY 1), u AS (UNPIVOT g ON ghi, cot, oktas INTO NAME "column" VALUE n_nonnull)
SELECT split, "column", n_nonnull, {rd('100.0::DOUBLE * n_nonnull / n', 'pct_nonnull')} FROM u""")
def _(t: Tables):
    from skycadence.sources.sinks import null_profile
    s = series(t).select(F.when(tl.before("ts", "2024-01-15"), "train").otherwise("test").alias("split"), "ghi", "cot", "oktas")
    return round_all(null_profile(s, ["ghi", "cot", "oktas"], by=["split"]), ["pct_nonnull"])


@query("qc_minute_probe", "QC-11", f"""WITH {S10}, h AS (SELECT site, date_trunc('hour', ts) AS h, avg(ghi) AS hm FROM c10 GROUP BY 1, 2)
SELECT s.site, minute(s.ts) AS minute, {rd('corr(h.hm, s.ghi)', 'r')}, count(h.hm) AS n FROM c10 s JOIN h ON h.site = s.site AND h.h = date_trunc('hour', s.ts) GROUP BY 1, 2""")
def _(t: Tables):
    from skycadence.operators.temporal import period_join
    c = cells(t)
    hour = c.groupBy("site", tl.floor_to("ts", 3600).alias("period")).agg(F.avg("ghi").alias("hm"))
    return round_all(ql.minute_probe(period_join(c, hour, tl.floor_to("ts", 3600), ["hm"], how="inner"), "hm", "ghi"), ["r"])


_REPAIR = f"""w AS (SELECT *, month(ts) AS mon, greatest(floor(e / 10) * 10, 0) AS alt, coalesce(dhi > ghi AND ghi > 0, false) AS bad, CASE WHEN ghi > 0 THEN dhi / ghi END AS kd FROM (SELECT *, {_E} AS e FROM c10)),
clean AS (SELECT * FROM w WHERE NOT bad AND ghi > 0 AND e > 5), cl AS (SELECT site, mon, alt, quantile_cont(kd, 0.5) AS cell FROM clean GROUP BY 1, 2, 3), ov AS (SELECT site, quantile_cont(kd, 0.5) AS allm FROM clean GROUP BY 1),
fx AS (SELECT w.site, w.ts, ghi, dhi AS dhi_original, bad, CASE WHEN bad THEN least(coalesce(cell, allm) * ghi, ghi) WHEN ghi = 0 AND dhi > 0 THEN 0 ELSE dhi END AS dhi, bad OR coalesce(ghi = 0 AND dhi > 0, false) AS corrected
FROM w LEFT JOIN cl ON cl.site = w.site AND cl.mon = w.mon AND cl.alt = w.alt LEFT JOIN ov ON ov.site = w.site)"""


@query("qc_repair_diffuse", "QC-1 JN-14 PRJ-4 PRJ-11 AGG-8", f"WITH {OBS}, {cells_sql()}, {_REPAIR} SELECT site, ts, {rd('ghi', 'ghi')}, {rd('dhi_original', 'dhi_original')}, {rd('dhi', 'dhi')}, corrected FROM fx")
def _(t: Tables):
    c = materialize(cells(t).select("site", "ts", "ghi", "dhi", elevation().alias("elev")))
    return round_all(ql.repair_diffuse(c, "elev").drop("elev"), ["ghi", "dhi_original", "dhi"])


@query("qc_repair_counts", "QC-1", f"WITH {OBS}, {cells_sql()}, {_REPAIR} SELECT site, count(*) FILTER (WHERE dhi_original > ghi) AS before, count(*) FILTER (WHERE dhi > ghi) AS after, count(*) FILTER (WHERE corrected) AS corrected FROM fx GROUP BY 1")
def _(t: Tables):
    c = materialize(cells(t).select("site", "ts", "ghi", "dhi", elevation().alias("elev")))
    return ql.repair_diffuse(c, "elev").groupBy("site").agg(
        F.count_if(C("dhi_original") > C("ghi")).alias("before"), F.count_if(C("dhi") > C("ghi")).alias("after"), F.count_if("corrected").alias("corrected"))


# ---- imputation ---------------------------------------------------------

@query("imp_constant_and_flag", "IMP-1", f"""WITH {S10} SELECT site, ts, coalesce(cot, -999.0) AS cot, CASE WHEN cot IS NOT NULL THEN 1 ELSE 0 END AS cot_ok,
coalesce(oktas, -1.0) AS oktas, CASE WHEN oktas IS NOT NULL THEN 1 ELSE 0 END AS oktas_ok FROM s10""")
def _(t: Tables):
    return series(t).select("site", "ts", *im.constant_fill("cot", -999.0, "cot_ok"), *im.constant_fill("oktas", -1.0, "oktas_ok"))


def _ffill_sql(c, k):
    return "coalesce(" + ", ".join([c] + [f"lag({c}, {i}) {W}" for i in range(1, k + 1)]) + ")"


@query("imp_bounded_fill", "IMP-2 IMP-3", f"""WITH {S10}, a AS (SELECT site, ts, cot, {_ffill_sql('cot', 3)} AS f, coalesce({_ffill_sql('rain', 3)}, 0) AS rain_clean, CASE WHEN rain IS NOT NULL THEN 1 ELSE 0 END AS rain_ok FROM s10)
SELECT site, ts, {rd(f'coalesce(f, lead(f, 1) {W})', 'cot_clean')}, {rd('rain_clean', 'rain_clean')}, rain_ok FROM a""")
def _(t: Tables):
    def f(g, w):
        g = im.bounded_fill(g, "cot", w, 3, 1)
        return im.bounded_fill(g, "rain", w, 3, default=0.0)
    s = series(t, f, back=4, ahead=1)
    return s.select("site", "ts", rc(C("cot_clean"), "cot_clean"), rc(C("rain_clean"), "rain_clean"), C("rain").isNotNull().cast("int").alias("rain_ok"))


@query("imp_segment_fill", "IMP-4 SEG-1", f"""WITH {OBS}, {cells_sql()}, p AS (SELECT site, ts, temp, lag(ts) {W} AS q FROM c10), b AS (SELECT *, sum(CASE WHEN q IS NOT NULL AND (epoch(ts - q) > 720 OR CAST(ts AS DATE) <> CAST(q AS DATE)) THEN 1 ELSE 0 END) {W} AS seg FROM p),
m AS (SELECT site, quantile_cont(temp, 0.5) AS med FROM c10 GROUP BY 1), f AS (SELECT *, last_value(temp IGNORE NULLS) OVER (PARTITION BY site, seg ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ff,
first_value(temp IGNORE NULLS) OVER (PARTITION BY site, seg ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM b)
SELECT f.site, ts, CAST(seg AS BIGINT) AS seg, {rd('coalesce(ff, bf, med)', 'temp_filled')} FROM f JOIN m USING (site)""")
def _(t: Tables):
    d = materialize(segments(materialize(cells(t).select("site", "ts", "temp")), 720))
    return im.fill_within(d, "temp", ["site", "seg"], fallback="median").select("site", "ts", "seg", rc(C("temp_filled"), "temp_filled"))


@query("imp_climatology", "IMP-5 JN-14", f"""WITH {S10}, x AS (SELECT site, ts, cot, temp, hour(ts) AS hr, floor({_E} / 10) AS alt FROM s10), tr AS (SELECT * FROM x WHERE ts < TIMESTAMP '2024-01-15' AND cot IS NOT NULL),
c AS (SELECT site, hr, alt, quantile_cont(cot, 0.5) AS cell FROM tr GROUP BY 1, 2, 3), o AS (SELECT site, quantile_cont(cot, 0.5) AS allm FROM tr GROUP BY 1), j AS (SELECT x.*, coalesce(cot, cell, allm) AS clean FROM x LEFT JOIN c ON c.site = x.site AND c.hr = x.hr AND c.alt = x.alt LEFT JOIN o ON o.site = x.site),
r AS (SELECT site, quantile_cont(temp / nullif(cot, 0), 0.5) AS ratio FROM x GROUP BY 1) SELECT j.site, ts, {rd('clean', 'cot_clean')}, CASE WHEN cot IS NOT NULL THEN 1 ELSE 0 END AS cot_available, {rd('coalesce(temp, clean * ratio)', 'temp_clean')} FROM j JOIN r USING (site)""")
def _(t: Tables):
    s = materialize(series(t).select("site", "ts", "cot", "temp", F.hour("ts").alias("hr"), F.floor(elevation() / 10).alias("alt")))
    f = im.climatology_fill(s, "cot", ["hr", "alt"], tl.before("ts", "2024-01-15"))
    return round_all(im.ratio_fill(f, "temp", "cot", "cot_clean"), ["cot_clean", "temp_clean"]).select("site", "ts", "cot_clean", "cot_available", "temp_clean")


@query("imp_train_median", "IMP-6 IMP-7", f"""WITH {S10}, m AS (SELECT site, {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in ('cot', 'temp', 'oktas'))} FROM s10 WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT s.site, ts, {', '.join(rd(f'coalesce({c}, m_{c})', c) for c in ('cot', 'temp', 'oktas'))} FROM s10 s JOIN m USING (site)""")
def _(t: Tables):
    s = materialize(series(t).select("site", "ts", "cot", "temp", "oktas"))
    return round_all(im.median_impute(s, ["cot", "temp", "oktas"], tl.before("ts", "2024-01-20")), ["cot", "temp", "oktas"])


@query("imp_daily_fill", "IMP-8 GRD-3", f"""WITH {_DAILY_CTE}, j AS (SELECT g.site, g.ts, x FROM g LEFT JOIN d USING (site, ts))
SELECT site, ts, {rd('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)', 'x_filled', 4)} FROM j""")
def _(t: Tables):
    from skycadence.operators.grid import daily_grid
    g = daily_grid(daily(t))
    return im.fill_within(g, "x", ["site"], width_s=366 * tl.DAY, fallback=0.0).select("site", "ts", rc(C("x_filled"), "x_filled", 4))


@query("imp_scaling", "IMP-9", f"""WITH {OBS}, {cells_sql()}, a AS (SELECT site, avg(ghi) AS mu, stddev_pop(ghi) AS sd, min(temp) AS lo, max(temp) AS hi FROM c10 WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT c.site, ts, {rd('(ghi - mu) / sd', 'ghi')}, {rd('2 * (temp - lo) / (hi - lo) - 1', 'temp')} FROM c10 c JOIN a USING (site)""")
def _(t: Tables):
    tr = tl.before("ts", "2024-01-20")
    d = im.scale(cells(t).select("site", "ts", "ghi", "temp"), ["ghi"], tr)
    return round_all(im.scale(d, ["temp"], tr, "minmax"), ["ghi", "temp"])


@query("wgt_sample_weights", "WGT-1 WGT-2", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.85 WHEN '3-MEDIUM' THEN 0.75 ELSE 0.6 END AS tier,
{rd("CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.85 WHEN '3-MEDIUM' THEN 0.75 ELSE 0.6 END * (0.5 + 0.5 * coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 0.9::DOUBLE END, 0.7)) * CASE WHEN o_totalprice > 300000 THEN 0.7 ELSE 1 END * CASE WHEN o_orderstatus = 'F' THEN 1.15 ELSE 1 END", 'weight')} FROM orders""")
def _(t: Tables):
    tier = im.tier_weight("o_orderpriority", {"1-URGENT": 1.0, "2-HIGH": 0.85, "3-MEDIUM": 0.75})
    w = im.composite_weight(tier, F.when(C("o_orderstatus") != "P", F.lit(0.9)), C("o_totalprice") > 300000, C("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", tier.alias("tier"), rc(w, "weight"))


@query("flt_drop_contradictory", "FLT-1", f"WITH {OBS}, {cells_sql()} SELECT site, ts, ghi, cot FROM c10 WHERE NOT coalesce(ghi > 900 AND cot > 20, false)")
def _(t: Tables):
    extreme = F.coalesce((C("ghi") > 900) & (C("cot") > 20), F.lit(False))
    return cells(t).where(~extreme).select("site", "ts", "ghi", "cot")
