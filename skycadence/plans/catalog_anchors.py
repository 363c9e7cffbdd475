"""Queries over anchors, targets, segments and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import exprs as ex
from skycadence.functions import solar as so
from skycadence.functions import timeline as tl
from skycadence.operators import anchors as an
from skycadence.operators import windows as wn
from skycadence.operators.chunks import carry_next, on_grid, ordinal, series_bounds
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, SITES, W, cells, cells_sql, elev_sql, elevation, frame, observations, rc, rd,
                                       round_all, series)
from skycadence.sources.sinks import materialize
from skycadence.spec import SiteSpec, per_site

C = F.col
_E = elev_sql()
_E60 = elev_sql("(ts + INTERVAL 60 MINUTE)")

FLAGS = f"""fl AS (SELECT *, {_E} AS e0, {_E60} AS e60, count(n) {frame(-18, 0)} AS here, count(n) {frame(1, 6)} AS nxt, lead(ghi, 6) {W} AS y,
sum(CASE WHEN ghi BETWEEN 0 AND 1400 THEN 1 ELSE 0 END) {frame(-18, 0)} AS okv FROM s10)"""
PROTO = "(here = 19 AND nxt = 6 AND ghi BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 1400 AND e0 > 5 AND e60 > 5)"
RULES = {"protocol": an.PROTOCOL, "backward_only": an.AnchorRule(check_future=False, elev_at_target=False, target_in_range=False),
         "ts_only": an.AnchorRule(check_future=False, elev_at_target=False, target_in_range=False, hi=1e9, lo=-1e9),
         "strict": an.AnchorRule(check_future=False, elev_at_target=False, target_in_range=False, strict_history=True),
         "exact_both_ways": an.AnchorRule(min_elev=None)}
RULES_SQL = {"protocol": PROTO, "backward_only": "(here = 19 AND ghi BETWEEN 0 AND 1400 AND e0 > 5)", "ts_only": "(here = 19 AND ghi IS NOT NULL AND e0 > 5)",
             "strict": "(here = 19 AND okv = 19 AND e0 > 5)", "exact_both_ways": "(here = 19 AND nxt = 6 AND ghi BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 1400)"}


def flagged(t: Tables, rules=RULES, elev_at=elevation):
    def f(g, w):
        return g.select("*", *[an.is_anchor(r, w, elev_at).alias(n) for n, r in rules.items()], wn.lead("ghi", 6, w).alias("y"))
    return series(t, f, back=18, ahead=6)


@query("anc_rule_flags", "ANC-1 ANC-2 ANC-3 ANC-4", f"""WITH {S10}, {FLAGS} SELECT site, ts, {', '.join(f'CASE WHEN {q} THEN 1 ELSE 0 END AS {n}' for n, q in RULES_SQL.items())} FROM fl""")
def _(t: Tables):
    return flagged(t).select("site", "ts", *[ex.flag(C(n)).alias(n) for n in RULES])


@query("anc_rule_comparison", "ANC-13 ANC-14", f"""WITH {S10}, {FLAGS}, z AS (SELECT site, coalesce({PROTO}, false) AS a, coalesce(here >= 1 AND ghi IS NOT NULL AND y IS NOT NULL AND e0 > 5, false) AS b, ghi, y FROM fl),
l AS (SELECT site, unnest(['protocol', 'pipeline', 'both', 'pipeline_only']) AS rule, unnest([a, b, a AND b, b AND NOT a]) AS hit, ghi, y FROM z)
SELECT site, rule, count(*) AS n, {rd('1 - sum((y - ghi) * (y - ghi)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)', 'r2')}, {rd('sqrt(avg((y - ghi) * (y - ghi)))', 'rmse')} FROM l WHERE hit AND y IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    from skycadence.operators.evaluate import metrics
    f = flagged(t, {"protocol": an.PROTOCOL})
    b = F.coalesce((elevation() > 5) & C("ghi").isNotNull() & C("y").isNotNull(), F.lit(False))
    a = C("protocol")
    names = F.filter(F.array(F.when(a, "protocol"), F.when(b, "pipeline"), F.when(a & b, "both"), F.when(b & ~a, "pipeline_only")), lambda x: x.isNotNull())
    long = f.select("site", "ghi", "y", F.explode(names).alias("rule"))
    return metrics(long, "y", ["ghi"], by=["site", "rule"]).select("site", "rule", "n", rc(C("r2"), "r2"), rc(C("rmse"), "rmse"))


@query("anc_readiness_flags", "ANC-5", f"""WITH {S10}, x AS (SELECT site, ts, ghi, cot, temp, {_E} AS e, count(ghi) {frame(-18, -1)} AS behind, lead(ghi, 6) {W} AS y FROM s10)
SELECT site, ts, CASE WHEN e > 0 THEN 1 ELSE 0 END AS daylight, CASE WHEN e > 5 THEN 1 ELSE 0 END AS above5, ghi IS NOT NULL AS has_ghi, cot IS NOT NULL AS has_cot,
CASE WHEN ghi IS NOT NULL AND cot IS NOT NULL THEN 'ok' WHEN ghi IS NOT NULL THEN 'partial' ELSE 'missing' END AS status,
CASE WHEN behind = 18 THEN 1 ELSE 0 END AS has_history, CASE WHEN behind = 18 AND ghi IS NOT NULL AND y IS NOT NULL THEN 1 ELSE 0 END AS ready FROM x""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", wn.valid_behind(C("ghi").isNotNull(), 18, w).alias("behind"), wn.lead("ghi", 6, w).alias("y"))
    e = elevation()
    has_g, has_c = C("ghi").isNotNull(), C("cot").isNotNull()
    return series(t, f, back=18, ahead=6).select(
        "site", "ts", ex.flag(e > 0).alias("daylight"), ex.flag(e > 5).alias("above5"), has_g.alias("has_ghi"), has_c.alias("has_cot"),
        F.when(has_g & has_c, "ok").when(has_g, "partial").otherwise("missing").alias("status"), ex.flag(C("behind") == 18).alias("has_history"),
        ex.flag((C("behind") == 18) & has_g & C("y").isNotNull()).alias("ready"))


# Source, tier and quality of a bin: 0 measured (three readings or more, all from the trusted sensor), 1 measured in part,
# 2 filled by a model (one reading that no trusted sensor backs).
_TIER = """tr AS (SELECT site, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg((event_id % 4 <> 3)::INT) AS quality, count(*) AS readings FROM obs GROUP BY 1, 2),
q10 AS (SELECT s.*, quality, CASE WHEN quality = 1 AND readings >= 3 THEN 0 WHEN readings >= 2 OR quality = 1 THEN 1 WHEN readings = 1 THEN 2 END AS tier,
  if(quality >= 0.5, 'trusted', 'other') AS source FROM s10 s LEFT JOIN tr USING (site, ts))"""


def tiered(t: Tables, fn, back: int, ahead: int):
    """The binned series with the provenance of every bin."""
    from skycadence.operators.grid import resample
    o = observations(t)
    n, quality = F.count(F.lit(1)), F.avg((C("event_id") % 4 != 3).cast("int"))
    tier = F.when((quality == 1) & (n >= 3), 0).when((n >= 2) | (quality == 1), 1).otherwise(2)
    marks = resample(o, 600, [quality.alias("quality"), tier.alias("tier"), F.when(quality >= 0.5, "trusted").otherwise("other").alias("source")])
    return on_grid([cells(t), marks], fn, step_s=600, bounds=series_bounds(o, 600), back=back, ahead=ahead)


@query("anc_trusted_source", "ANC-7", f"""WITH {S10}, {_TIER}, x AS (SELECT site, ts, source, n, ghi, {_E} AS e0, {_E60} AS e60, lead(ghi, 6) {W} AS y, lead(source, 6) {W} AS ysource,
count(n) {frame(-18, 0)} AS back, count(n) {frame(1, 6)} AS ahead FROM q10)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('y', 'y')} FROM x WHERE source = 'trusted' AND ysource = 'trusted' AND back = 19 AND ahead = 6 AND e0 >= 10 AND e60 >= 10""")
def _(t: Tables):
    def f(g, w):
        there = C("n").isNotNull()
        return g.select("*", wn.lead("ghi", 6, w).alias("y"), wn.lead("source", 6, w).alias("y_source"),
                        an.is_trusted("source", ["trusted"], there, w, elevation, min_elev=10.0).alias("ok"))
    return tiered(t, f, 18, 6).where("ok").select("site", "ts", rc(C("ghi"), "ghi"), rc(C("y"), "y"))


@query("anc_provenance", "ANC-8", f"""WITH {S10}, {_TIER}, x AS (SELECT site, ts, ghi, tier, {_E} AS e0, lead(ghi, 6) {W} AS y, lead(tier, 6) {W} AS ytier FROM q10)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('y', 'y')}, tier, ytier AS y_tier FROM x WHERE tier <> 2 AND ytier <> 2 AND e0 > 5""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", wn.lead("ghi", 6, w).alias("y"), wn.lead("tier", 6, w).alias("y_tier"))
    s = tiered(t, f, 0, 6).where(an.not_imputed("tier", [2]) & an.not_imputed("y_tier", [2]) & (elevation() > 5))
    return s.select("site", "ts", rc(C("ghi"), "ghi"), rc(C("y"), "y"), "tier", "y_tier")


@query("spl_strict_quality", "SPL-8", f"""WITH {S10}, {_TIER}, x AS (SELECT site, ts, ghi, tier, quality, lead(ghi, 6) {W} AS y, lead(tier, 6) {W} AS ytier, lead(quality, 6) {W} AS yq FROM q10)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('y', 'y')} FROM x WHERE tier IN (0, 1) AND ytier IN (0, 1) AND quality >= 0.9 AND yq >= 0.9""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", wn.lead("ghi", 6, w).alias("y"), wn.lead("tier", 6, w).alias("y_tier"), wn.lead("quality", 6, w).alias("y_quality"))
    s = tiered(t, f, 0, 6).where(an.strict_quality("tier", "quality") & an.strict_quality("y_tier", "y_quality"))
    return s.select("site", "ts", rc(C("ghi"), "ghi"), rc(C("y"), "y"))


@query("anc_hourly", "ANC-9 TGT-5", f"""WITH {S1H}, x AS (SELECT *, lead(ghi, 1) {W} AS y, lead(n, 1) {W} AS yn, lag(ghi, 1) {W} AS l1 FROM s1h)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('y', 'y')} FROM x WHERE n >= 3 AND yn >= 3 AND l1 IS NOT NULL""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", wn.lead("ghi", 1, w).alias("y"), wn.lead("n", 1, w).alias("yn"), wn.lag("ghi", 1, w).alias("l1"))
    s = series(t, f, back=1, ahead=1, step_s=3600, chunk_steps=720)
    return s.where((C("n") >= 3) & (C("yn") >= 3) & C("l1").isNotNull()).select("site", "ts", rc(C("ghi"), "ghi"), rc(C("y"), "y"))


@query("anc_six_hours_daytime", "ANC-10", f"""WITH {S1H}, x AS (SELECT site, ts, n, CASE WHEN n IS NOT NULL AND {_E} > 5 THEN 1 ELSE 0 END AS day FROM s1h),
y AS (SELECT site, ts, n, sum(day) {frame(1, 6)} AS days FROM x) SELECT site, ts FROM y WHERE days = 6 AND n IS NOT NULL""")
def _(t: Tables):
    def f(g, w):
        return g.withColumn("days", wn.valid_within(C("n").isNotNull() & (elevation() > 5), -1, 6, w))
    return series(t, f, ahead=6, step_s=3600, chunk_steps=720).where((C("days") == 6) & C("n").isNotNull()).select("site", "ts")


@query("anc_reconciliation", "ANC-11 PRF-2", f"""WITH {S10}, {FLAGS}, c AS (SELECT site, hour(ts) AS hour, count(*) AS n FROM fl WHERE {PROTO} GROUP BY 1, 2),
e AS (SELECT site, hour(ts) AS hour, count(*) AS n FROM fl WHERE (here = 19 AND ghi BETWEEN 0 AND 1400 AND e0 > 5) GROUP BY 1, 2)
SELECT coalesce(c.site, e.site) AS site, coalesce(c.hour, e.hour) AS hour, coalesce(c.n, 0) AS n_found, coalesce(e.n, 0) AS n_expected, {rd('CASE WHEN coalesce(e.n, 0) > 0 THEN 100.0::DOUBLE * (coalesce(c.n, 0) - e.n) / e.n END', 'deviation_pct')},
CASE WHEN abs(CASE WHEN coalesce(e.n, 0) > 0 THEN 100.0 * (coalesce(c.n, 0) - e.n) / e.n END) <= 1 THEN 'match' ELSE 'differs' END AS verdict FROM c FULL JOIN e ON c.site = e.site AND c.hour = e.hour""")
def _(t: Tables):
    f = flagged(t, {k: RULES[k] for k in ("protocol", "backward_only")}).withColumn("hour", F.hour("ts").cast("long"))
    by = ["site", "hour"]
    # Both counts come from one scan; a group only one rule hits stays on its own side.
    both = materialize(f.groupBy(*by).agg(F.count_if("protocol").alias("a"), F.count_if("backward_only").alias("b")))
    out = an.reconcile(both.where(C("a") > 0).select(*by, C("a").alias("n")), both.where(C("b") > 0).select(*by, C("b").alias("n")), by)
    return round_all(out, ["deviation_pct"])


_ALT = [SiteSpec(s.name, s.lat + 0.75, s.lon - 1.5) for s in SITES]


def _alt_elev(ahead_s: int = 0):
    return so.elevation_deg("ts", per_site(_ALT, "lat"), per_site(_ALT, "lon"), per_site(_ALT, "meridian"), ahead_s)


def _alt_sql(text: str) -> str:
    for s, a in zip(SITES, _ALT, strict=True):
        text = text.replace(f"THEN {s.lat}::DOUBLE", f"THEN {a.lat}::DOUBLE").replace(f"THEN {s.lon}::DOUBLE", f"THEN {a.lon}::DOUBLE")
    return text


@query("anc_coordinate_sensitivity", "ANC-12", f"""WITH {S10}, {FLAGS}, z AS (SELECT site, {PROTO} AS a, (here = 19 AND nxt = 6 AND ghi BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 1400 AND {_alt_sql(_E)} > 5 AND {_alt_sql(_E60)} > 5) AS b FROM fl)
SELECT site, count(*) FILTER (WHERE a) AS n_base, count(*) FILTER (WHERE b) AS n_moved, count(*) FILTER (WHERE b) - count(*) FILTER (WHERE a) AS delta FROM z GROUP BY 1""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", an.is_anchor(an.PROTOCOL, w, elevation).alias("a"), an.is_anchor(an.PROTOCOL, w, _alt_elev).alias("b"))
    s = series(t, f, back=18, ahead=6).groupBy("site").agg(F.count_if("a").alias("n_base"), F.count_if("b").alias("n_moved"))
    return s.withColumn("delta", C("n_moved") - C("n_base"))


@query("tgt_targets", "TGT-1 TGT-2 TGT-3", f"""WITH {S10}, x AS (SELECT *, {', '.join(f'lead(ghi, {k}) {W} AS f{k}' for k in range(1, 7))} FROM s10),
y AS (SELECT *, CASE WHEN {' AND '.join(f'f{k} BETWEEN 0 AND 1400' for k in range(1, 7))} THEN (f1 + f2 + f3 + f4 + f5 + f6) / 6 END AS ym FROM x)
SELECT site, ts, {', '.join(rd(f'f{k}', f'y_{k}') for k in range(1, 7))}, {rd('ym', 'y_mean')}, {rd('f6 - ghi', 'd_point')}, {rd('ym - ghi', 'd_mean')},
{rd('CASE WHEN f6 - ghi IS NOT NULL THEN least(greatest(ghi + (f6 - ghi), 0), 1400) END', 'back')} FROM y WHERE ghi IS NOT NULL""")
def _(t: Tables):
    s = series(t, lambda g, w: g.select("*", *an.target_columns("ghi", w)), ahead=6).where(C("ghi").isNotNull())
    cols = [*[f"y_{k}" for k in range(1, 7)], "y_mean", "d_point", "d_mean"]
    return s.select("site", "ts", *[rc(C(c), c) for c in cols], rc(an.from_residual("ghi", "d_point"), "back"))


@query("tgt_ratio_target", "TGT-4", f"""WITH {S10}, x AS (SELECT site, ts, lead(ghi, 6) {W} AS y, 1100 * greatest(sin(radians({_E60})), 0::DOUBLE) AS cs FROM s10),
z AS (SELECT *, y / greatest(cs, 20) AS kt FROM x) SELECT site, ts, {rd('kt', 'kt_next', 5)}, {rd('kt * greatest(cs, 20)', 'rebuilt', 4)} FROM z WHERE y IS NOT NULL""")
def _(t: Tables):
    s = series(t, lambda g, w: g.withColumn("y", wn.lead("ghi", 6, w)), ahead=6).where(C("y").isNotNull())
    cs = so.clear_sky(elevation(3600))
    kt = so.clearness("y", cs)
    return s.select("site", "ts", rc(kt, "kt_next", 5), rc(kt * ex.floor_at(cs, 20.0), "rebuilt", 4))


@query("tgt_next_window_means", "TGT-5", f"""WITH {S1H}, x AS (SELECT site, ts, ghi, {', '.join(f'CASE WHEN lead(n, {k}) {W} >= 2 THEN lead(ghi, {k}) {W} END AS f{k}' for k in range(1, 7))} FROM s1h)
SELECT site, ts, {rd('f1', 'next1')}, {rd('(f1 + f2) / 2', 'next2')}, {rd('(f1 + f2 + f3) / 3', 'next3')}, {rd('(f1 + f2 + f3 + f4 + f5 + f6) / 6', 'next6')} FROM x WHERE ghi IS NOT NULL""")
def _(t: Tables):
    def f(g, w):
        return g.select("*", *[an.next_window_mean("ghi", "n", w, h, 2).alias(f"next{h}") for h in (1, 2, 3, 6)])
    s = series(t, f, ahead=6, step_s=3600, chunk_steps=720).where(C("ghi").isNotNull())
    return s.select("site", "ts", *[rc(C(f"next{h}"), f"next{h}") for h in (1, 2, 3, 6)])


@query("seg_ids", "SEG-1", f"""WITH {OBS}, {cells_sql()}, p AS (SELECT site, ts, lag(ts) {W} AS q FROM c10), b AS (SELECT *, CASE WHEN q IS NOT NULL AND (epoch(ts - q) > 720 OR CAST(ts AS DATE) <> CAST(q AS DATE)) THEN 1 ELSE 0 END AS brk FROM p)
SELECT site, ts, CAST(sum(brk) {W} AS BIGINT) AS seg FROM b""")
def _(t: Tables):
    return an.segments(cells(t).select("site", "ts"), 720)


@query("seg_windows_inside", "SEG-2", f"""WITH {OBS}, {cells_sql()}, p AS (SELECT site, ts, ghi, lag(ts) {W} AS q FROM c10), b AS (SELECT *, CASE WHEN q IS NOT NULL AND epoch(ts - q) > 900 THEN 1 ELSE 0 END AS brk FROM p),
s AS (SELECT *, sum(brk) {W} AS seg FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY site, seg ORDER BY ts) AS i, count(*) OVER (PARTITION BY site, seg) AS m FROM s)
SELECT site, ts, CAST(seg AS BIGINT) AS seg, i FROM r WHERE i >= 18 AND m - i >= 6""")
def _(t: Tables):
    d = materialize(an.segments(materialize(cells(t).select("site", "ts")), 900, split_on_date=False))
    # Position in the segment = position in the series minus the position of its start.
    d = ordinal(d, width_s=7 * tl.DAY, name="pos")
    ends = d.groupBy("site", "seg").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    d = d.join(ends, ["site", "seg"]).withColumn("i", C("pos") - C("first") + 1)
    return d.where((C("i") >= 18) & (C("last") - C("pos") >= 6)).select("site", "ts", "seg", "i")


@query("spl_by_date", "SPL-1 SPL-3", """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS split,
CASE WHEN year(o_orderdate) IN (1995, 1996, 1997) THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'valid' WHEN year(o_orderdate) IN (1999, 2000) THEN 'test' END AS by_year FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", an.split_by_dates("o_orderdate", "1999-01-01", "2000-01-01").alias("split"),
                           an.split_by_years("o_orderdate", [1995, 1996, 1997], [1998], [1999, 2000]).alias("by_year"))


def order_series(t: Tables):
    return t.orders.select(C("o_orderpriority").alias("site"), C("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")


_OS = "os AS (SELECT o_orderpriority AS site, o_orderdate AS ts, o_orderkey, o_totalprice FROM orders), ix AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, o_orderkey) AS i, count(*) OVER (PARTITION BY site) AS m FROM os)"
_ORD = ("ts", "o_orderkey")


@query("spl_by_fraction", "SPL-2", f"WITH {_OS} SELECT site, o_orderkey, CASE WHEN i <= floor(m * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(m * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM ix")
def _(t: Tables):
    return an.split_by_fraction(order_series(t), 0.7, 0.15, order=_ORD, width_s=365 * tl.DAY).select("site", "o_orderkey", "split")


FOLDS = [("1998-01-01", "1998-07-01"), ("1998-07-01", "1999-01-01"), ("1999-01-01", "1999-07-01"), ("1999-07-01", "2000-01-01"), ("2000-01-01", None)]


def _fold_sql(i, s, e):
    until = f"AND ts < TIMESTAMP '{e}'" if e else ""
    return (f"SELECT site, o_orderkey, {i} AS fold, CASE WHEN ts < TIMESTAMP '{s}' - INTERVAL 3 MONTH THEN 'train' WHEN ts < TIMESTAMP '{s}' THEN 'stop' ELSE 'test' END AS role "
            f"FROM os WHERE ts < TIMESTAMP '{s}' OR (ts >= TIMESTAMP '{s}' {until})")


_FOLDS_SQL = f"{_OS}, f AS ({' UNION ALL '.join(_fold_sql(i, s, e) for i, (s, e) in enumerate(FOLDS, 1))})"


@query("spl_walk_forward_dates", "SPL-4", f"""WITH {_FOLDS_SQL} SELECT site, fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'stop') AS n_stop,
count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role <> 'test') >= 1400 AND count(*) FILTER (WHERE role = 'test') >= 100 AS usable FROM f GROUP BY 1, 2""")
def _(t: Tables):
    return an.usable_folds(an.folds_by_date(order_series(t), FOLDS), 1400, 100)


@query("spl_walk_forward_counts", "SPL-5", f"""WITH {_OS}, k AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold) SELECT site, o_orderkey, fold, CASE WHEN i <= (m // 6) * fold THEN 'train' ELSE 'test' END AS role
FROM ix, k WHERE i <= least((m // 6) * (fold + 1), m)""")
def _(t: Tables):
    return an.folds_by_count(order_series(t), 5, order=_ORD, width_s=365 * tl.DAY).select("site", "o_orderkey", "fold", "role")


_SCR = "(o_orderkey * 2654435761 + 7 * 40503) % 4294967296"


@query("spl_random", "SPL-6", f"SELECT o_orderkey, CASE WHEN {_SCR} < {int(0.8 * 4294967296)} THEN 'train' ELSE 'test' END AS split FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", an.random_split("o_orderkey", 0.8, seed=7).alias("split"))


@query("spl_learning_curve_random", "SPL-7", f"""WITH {_OS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_SCR}) AS j FROM ix) SELECT site, o_orderkey FROM r WHERE j <= floor(m * 0.25::DOUBLE)""")
def _(t: Tables):
    return an.random_subset(order_series(t), "o_orderkey", 0.25, seed=7).select("site", "o_orderkey")


@query("spl_learning_curve_recent", "SPL-7", f"WITH {_OS} SELECT site, o_orderkey FROM ix WHERE i > m - floor(m * 0.25::DOUBLE)")
def _(t: Tables):
    return an.recent_subset(order_series(t), 0.25, order=_ORD, width_s=365 * tl.DAY).select("site", "o_orderkey")
