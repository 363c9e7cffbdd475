"""Queries over scores, strata, comparisons, significance and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import solar as so
from skycadence.functions import timeline as tl
from skycadence.functions.exprs import cap_at, clip
from skycadence.operators import anchors as an
from skycadence.operators import evaluate as ev
from skycadence.operators import significance as sg
from skycadence.operators import windows as wn
from skycadence.operators.ranks import exact_quantiles
from skycadence.plans.catalog_anchors import FLAGS, PROTO
from skycadence.plans.registry import Tables, query
from skycadence.sources.sinks import materialize
from skycadence.plans.stations import (OBS, S10, W, cells, cells_sql, elev_sql, elevation, frame, observations, rc, rd, round_all,
                                       rsql, series)

C = F.col
_E = elev_sql()
MODELS = ["persist", "smart", "rolling"]


def predictions(t: Tables, rule: an.AnchorRule = an.PROTOCOL):
    """Anchors with the observed value at t+10..t+60 and three baseline forecasts."""
    def f(g, w):
        return g.select("*", *[wn.lead("ghi", k, w).alias(f"y{k}") for k in range(1, 7)], wn.rolling("ghi", 6, "mean", w).alias("rolling"),
                        wn.lag("ghi", 1, w).alias("before"), an.is_anchor(rule, w, elevation).alias("_ok"))
    s = series(t, f, back=18, ahead=6).where("_ok")
    kt = so.clearness("ghi", so.clear_sky(elevation()))
    s = s.withColumn("kt", kt)
    smart = {k: clip(C("kt") * so.clear_sky(elevation(600 * k)), 0.0, 1400.0) for k in range(1, 7)}
    return s.select("site", "ts", C("y6").alias("y"), C("ghi").alias("persist"), smart[6].alias("smart"), "rolling", "cot", "cp", "oktas", "before", "n",
                    *[f"y{k}" for k in range(1, 7)], *[smart[k].alias(f"smart{k}") for k in range(1, 7)])


def _cs(k):
    return f"1100 * greatest(sin(radians({elev_sql(f'(ts + INTERVAL {k * 10} MINUTE)')})), 0::DOUBLE)"


def pred_sql(where: str = PROTO) -> str:
    return f"""{S10}, {FLAGS}, pw AS (SELECT *, {', '.join(f'lead(ghi, {k}) {W} AS y{k}' for k in range(1, 7))}, avg(ghi) {frame(-5, 0)} AS rolling, lag(ghi) {W} AS before FROM fl),
pk AS (SELECT *, ghi / greatest(1100 * greatest(sin(radians(e0)), 0), 20) AS kt, {', '.join(f'{_cs(k)} AS cs{k}' for k in range(1, 7))} FROM pw WHERE {where}),
pr AS (SELECT site, ts, y6 AS y, ghi AS persist, least(greatest(kt * cs6, 0), 1400) AS smart, rolling, cot, cp, oktas, before, n, {', '.join(f'y{k}' for k in range(1, 7))},
{', '.join(f'least(greatest(kt * cs{k}, 0), 1400) AS smart{k}' for k in range(1, 7))} FROM pk)"""


PRED = pred_sql()
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT *, '{m}' AS model, {m} AS p FROM pr" for m in MODELS) + ")"
_R2 = "1 - sum((p - y) * (p - y)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)"
_R2B = "1 - sum((persist - y) * (persist - y)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)"
_MSE, _MSEB = "avg((p - y) * (p - y))", "avg((persist - y) * (persist - y))"
_CORE = f"count(*) AS n, {rd(_R2, 'r2')}, {rd('avg(abs(p - y))', 'mae')}, {rd(f'sqrt({_MSE})', 'rmse')}"
_CORE_COLS = ["r2", "mae", "rmse"]


@query("smart_persistence_skill", "MET-1 MET-2 MET-7 SOL-12 ANC-1 TGT-1", f"""WITH {PRED}, {_LONG} SELECT site, model, {_CORE}, {rd(f'1 - sqrt({_MSE}) / nullif(sqrt({_MSEB}), 0)', 'skill_rmse')},
{rd(f'1 - {_MSE} / nullif({_MSEB}, 0)', 'skill_mse')}, {rd(f'(({_R2}) - ({_R2B})) / nullif(1 - ({_R2B}), 0)', 'skill_r2')} FROM lg GROUP BY 1, 2""")
def _(t: Tables):
    m = ev.metrics(predictions(t), "y", MODELS, base="persist", by=["site"])
    cols = [*_CORE_COLS, "skill_rmse", "skill_mse", "skill_r2"]
    return round_all(m.select("site", "model", "n", *cols), cols)


@query("met_bias_and_relative", "MET-3 MET-8", f"""WITH {PRED}, {_LONG} SELECT site, model, count(*) AS n, {rd('avg(p - y)', 'mbe')}, {rd(f'100 * sqrt({_MSE}) / (avg(y) + 0.000001)', 'nrmse_pct')},
{rd('avg(CASE WHEN y > 50 THEN 100 * abs((p - y) / y) END)', 'mape_pct')} FROM lg GROUP BY 1, 2""")
def _(t: Tables):
    m = ev.metrics(predictions(t), "y", MODELS, by=["site"])
    return round_all(m.select("site", "model", "n", "mbe", "nrmse_pct", "mape_pct"), ["mbe", "nrmse_pct", "mape_pct"])


def _horizons(t: Tables):
    p = predictions(t)
    entries = [F.struct(F.lit(k * 10).alias("horizon"), C(f"y{k}").alias("y"), C(f"smart{k}").alias("smart")) for k in range(1, 7)]
    return p.select("site", "persist", F.explode(F.array(*entries)).alias("_h")).select("site", "persist", "_h.*")


_HZ = "hz AS (" + " UNION ALL ".join(f"SELECT site, persist, {k * 10} AS horizon, y{k} AS y, smart{k} AS smart FROM pr" for k in range(1, 7)) + "), hm AS (" + " UNION ALL ".join(
    f"SELECT site, horizon, '{m}' AS model, y, {m} AS p FROM hz" for m in ("persist", "smart")) + f"), hs AS (SELECT site, horizon, model, {_CORE} FROM hm WHERE y IS NOT NULL GROUP BY 1, 2, 3)"


@query("met_per_horizon", "MET-4 REP-1", f"WITH {PRED}, {_HZ} SELECT * FROM hs")
def _(t: Tables):
    m = ev.metrics(_horizons(t), "y", ["persist", "smart"], by=["site", "horizon"])
    return round_all(m.select("site", "horizon", "model", "n", *_CORE_COLS), _CORE_COLS)


@query("met_horizon_average", "MET-4", f"WITH {PRED}, {_HZ} SELECT site, model, {', '.join(rd(f'avg({c})', f'avg_{c}', 5) for c in _CORE_COLS)} FROM hs GROUP BY 1, 2")
def _(t: Tables):
    m = round_all(ev.metrics(_horizons(t), "y", ["persist", "smart"], by=["site", "horizon"]), _CORE_COLS)
    return round_all(ev.horizon_average(m, ["site", "model"], _CORE_COLS), [f"avg_{c}" for c in _CORE_COLS], 5)


@query("met_score_matrix", "AGG-14", f"""WITH {PRED}, {_HZ} SELECT site, model, {', '.join(f"max(CASE WHEN horizon = {h} THEN rmse END) AS h{h}" for h in range(10, 61, 10))},
{rd('(' + ' + '.join(f'max(CASE WHEN horizon = {h} THEN rmse END)' for h in range(10, 61, 10)) + ') / 6', 'row_mean', 5)} FROM hs GROUP BY 1, 2""")
def _(t: Tables):
    m = round_all(ev.metrics(_horizons(t), "y", ["persist", "smart"], by=["site", "horizon"]), _CORE_COLS)
    x = ev.score_matrix(m, ["site", "model"], "horizon", list(range(10, 61, 10)), "rmse")
    return x.select("site", "model", *[C(str(h)).alias(f"h{h}") for h in range(10, 61, 10)], rc(C("row_mean"), "row_mean", 5))


@query("met_long_result_rows", "REP-1", f"""WITH {PRED}, {_HZ} UNPIVOT (SELECT site, horizon, model, r2, mae, rmse FROM hs) ON r2, mae, rmse INTO NAME metric VALUE score""")
def _(t: Tables):
    m = round_all(ev.metrics(_horizons(t), "y", ["persist", "smart"], by=["site", "horizon"]), _CORE_COLS)
    return m.unpivot(["site", "horizon", "model"], _CORE_COLS, "metric", "score")


@query("met_min_n_guard", "MET-6", f"""WITH {PRED}, {_LONG}, g AS (SELECT site, hour(ts) AS hour, model, {_CORE} FROM lg WHERE p IS NOT NULL GROUP BY 1, 2, 3) SELECT site, hour, model, n, CASE WHEN n >= 10 THEN rmse END AS rmse, CASE WHEN n >= 10 THEN mae END AS mae FROM g""")
def _(t: Tables):
    p = predictions(t).withColumn("hour", F.hour("ts").cast("long"))
    m = ev.metrics(p, "y", MODELS, by=["site", "hour"], min_n=10)
    return round_all(m.select("site", "hour", "model", "n", "rmse", "mae"), ["rmse", "mae"])


_STRATA = {
    "evl_cloud_regime": ("EVL-1", lambda: ev.cloud_regime("cot", "cp"), "CASE WHEN cot < 1 THEN 'clear' WHEN cot < 8 THEN 'partly' WHEN cot >= 8 THEN 'overcast' WHEN cp = 0 THEN 'clear' ELSE 'partly' END"),
    "evl_cot_class": ("EVL-2", lambda: ev.cot_class("cot"), "CASE WHEN cot IS NULL THEN 'no_data' WHEN cot <= 5 THEN 'thin' WHEN cot <= 15 THEN 'medium' ELSE 'thick' END"),
    "evl_sky_class": ("EVL-3", lambda: ev.sky_class("oktas"), "CASE WHEN oktas <= 2 THEN 'clear' WHEN oktas <= 5 THEN 'scattered' WHEN oktas < 8 THEN 'broken' WHEN oktas >= 8 THEN 'overcast' ELSE 'missing' END"),
    "evl_hour_season": ("EVL-4", lambda: F.concat_ws("/", F.hour("ts").cast("string"), so.season_two(F.month("ts"))), "concat(CAST(hour(ts) AS VARCHAR), '/', CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'dry' ELSE 'wet' END)"),
    "evl_value_bin": ("EVL-6", lambda: ev.value_bin("y"), "CASE " + " ".join(f"WHEN y > {a} AND y <= {b} THEN '{a}-{b}'" for a, b in zip((0, 100, 300, 600, 900, 1200), (100, 300, 600, 900, 1200, 1500))) + " END"),
}


def _stratum(name, ops, col, case):
    @query(name, ops, f"""WITH {PRED}, {_LONG}, z AS (SELECT site, {case} AS stratum, model, count(*) AS n, {rd(f'sqrt({_MSE})', 'rmse')}, {rd('avg(abs(p - y))', 'mae')}, {rd('avg(p - y)', 'mbe')} FROM lg GROUP BY 1, 2, 3)
SELECT site, stratum, model, n, CASE WHEN n >= 5 THEN rmse END AS rmse, CASE WHEN n >= 5 THEN mae END AS mae, CASE WHEN n >= 5 THEN mbe END AS mbe FROM z""")
    def _(t: Tables):
        m = ev.metrics(predictions(t).withColumn("stratum", col()), "y", MODELS, by=["site", "stratum"], min_n=5)
        return round_all(m.select("site", "stratum", "model", "n", "rmse", "mae", "mbe"), ["rmse", "mae", "mbe"])


for _name, (_ops, _colx, _case) in _STRATA.items():
    _stratum(_name, _ops, _colx, _case)


@query("evl_distribution_by_split", "EVL-7 AGG-9", f"""WITH {OBS}, {cells_sql()}, z AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM c10)
SELECT site, split, count(ghi) AS n, {rd('avg(ghi)', 'avg')}, {rd('stddev_samp(ghi)', 'std', 5)}, max(ghi) AS high, {', '.join(rd(f'quantile_cont(ghi, {p})', n) for n, p in (('p10', .1), ('p50', .5), ('p90', .9)))} FROM z GROUP BY 1, 2""")
def _(t: Tables):
    c = cells(t).withColumn("split", F.when(tl.before("ts", "2024-01-20"), "train").otherwise("test"))
    return round_all(round_all(ev.distribution(c, "ghi", ["site", "split"]), ["avg", "p10", "p50", "p90"]), ["std"], 5)


@query("evl_step_volatility", "EVL-7", f"""WITH {S10}, d AS (SELECT site, abs(ghi - lag(ghi) {W}) AS a FROM s10) SELECT site, count(a) AS n, {rd('avg(a)', 'avg')}, {rd('avg(CASE WHEN a > 100 THEN 1.0::DOUBLE WHEN a IS NOT NULL THEN 0 END)', 'share_large')},
{', '.join(rd(f'quantile_cont(a, {p})', n) for n, p in (('p50', .5), ('p90', .9), ('p95', .95)))} FROM d GROUP BY 1""")
def _(t: Tables):
    s = series(t, lambda g, w: g.withColumn("a", F.abs(wn.diff("ghi", 1, w))), back=1).select("site", "a")
    base = s.groupBy("site").agg(F.count("a").alias("n"), rc(F.avg("a"), "avg"), rc(F.avg((C("a") > 100).cast("double")), "share_large"))
    q = exact_quantiles(s, "a", ["site"], {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return base.join(round_all(q, ["p50", "p90", "p95"]), ["site"])


@query("evl_autocorrelation", "EVL-7 AGG-10", f"WITH {S10}, x AS (SELECT site, ghi, {', '.join(f'lead(ghi, {k}) {W} AS f{k}' for k in range(1, 7))} FROM s10) SELECT site, {', '.join(rd(f'corr(ghi, f{k})', f'r{k}') for k in range(1, 7))} FROM x GROUP BY 1")
def _(t: Tables):
    s = series(t, lambda g, w: g.select("*", *[wn.lead("ghi", k, w).alias(f"f{k}") for k in range(1, 7)]), ahead=6)
    return s.groupBy("site").agg(*[rc(F.corr("ghi", f"f{k}"), f"r{k}") for k in range(1, 7)])


# ---- comparisons ---------------------------------------------------------

_SITE_SCORES = f"sc AS (SELECT site, model, {_CORE} FROM lg GROUP BY 1, 2)"


def _scores(t: Tables):
    return round_all(ev.metrics(predictions(t), "y", MODELS, by=["site"]).select("site", "model", "n", *_CORE_COLS), _CORE_COLS)


@query("cmp_ablation", "CMP-1", f"""WITH {PRED}, {_LONG}, {_SITE_SCORES}, p AS (SELECT site, max(CASE WHEN model = 'persist' THEN r2 END) AS persist, max(CASE WHEN model = 'rolling' THEN r2 END) AS rolling FROM sc GROUP BY 1)
SELECT site, persist, rolling, {rd('rolling - persist', 'delta')}, CASE WHEN abs(rolling - persist) >= 0.015 THEN 'HIGH' WHEN abs(rolling - persist) >= 0.005 THEN 'MEDIUM' ELSE 'NEGLIGIBLE' END AS relevance FROM p""")
def _(t: Tables):
    return round_all(ev.ablation(_scores(t), "model", "persist", "rolling", "r2", ["site"]), ["delta"])


@query("cmp_incremental_gain", "MET-4", f"""WITH {PRED}, {_HZ} SELECT site, horizon, rmse, {rd('rmse - lag(rmse) OVER (PARTITION BY site ORDER BY horizon)', 'gain')}, {rd('rmse - first_value(rmse) OVER (PARTITION BY site ORDER BY horizon)', 'gain_total')} FROM hs WHERE model = 'smart'""")
def _(t: Tables):
    m = round_all(ev.metrics(_horizons(t), "y", ["smart"], by=["site", "horizon"]), _CORE_COLS).select("site", "horizon", "rmse")
    return round_all(ev.incremental_gain(m, "horizon", "rmse", ["site"]), ["gain", "gain_total"])


@query("cmp_seed_summary", "AGG-15 AGG-16", f"""WITH {PRED}, {_HZ}, g AS (SELECT site, model, count(*) AS n_seeds, avg(rmse) AS a, stddev_samp(rmse) AS s, stddev_pop(rmse) AS p FROM hs GROUP BY 1, 2)
SELECT site, model, n_seeds, {rd('a', 'avg', 5)}, {rd('s', 'std', 5)}, {rd('p', 'std_pop', 5)}, CAST(row_number() OVER (PARTITION BY site ORDER BY a DESC, model) AS INTEGER) AS rank FROM g""")
def _(t: Tables):
    # Horizons play the part of repeated runs.
    m = round_all(ev.metrics(_horizons(t), "y", ["persist", "smart"], by=["site", "horizon"]), _CORE_COLS)
    return round_all(ev.seed_summary(m, "rmse", ["site", "model"], ["site"]), ["avg", "std", "std_pop"], 5)


@query("cmp_cross_site", "CMP-4 SET-1 AGG-15", f"""WITH {PRED}, {_LONG}, {_SITE_SCORES} SELECT model, count(*) AS n, {', '.join(rd(f'avg({c})', f'{c}_mean', 5) + ', ' + rd(f'stddev_samp({c})', f'{c}_std', 5) for c in _CORE_COLS)} FROM sc GROUP BY 1""")
def _(t: Tables):
    out = ev.mean_and_std(_scores(t), _CORE_COLS, ["model"])  # one job already covers all sites
    return round_all(out, [c for c in out.columns if c not in ("model", "n")], 5)


_WEIGHTS = [round(0.40 + 0.05 * i, 2) for i in range(13)]


@query("cmp_blend_grid", "CMP-5", f"""WITH {PRED}, w AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _WEIGHTS)}]) AS weight)
SELECT site, weight, count(*) AS n, {rd('sqrt(avg((weight * smart + (1 - weight) * rolling - y) * (weight * smart + (1 - weight) * rolling - y)))', 'rmse', 5)} FROM pr, w WHERE rolling IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    return round_all(ev.blend_grid(predictions(t), "y", "smart", "rolling", _WEIGHTS, ["site"]), ["rmse"], 5)


@query("cmp_ensembles_and_regimes", "CMP-5 CMP-6", f"""WITH {PRED}, e AS (SELECT *, (persist + smart + rolling) / 3 AS blend, CASE WHEN cot < 1 OR (cot IS NULL AND cp = 0) THEN smart ELSE rolling END AS regime FROM pr)
SELECT site, {rd('sqrt(avg((blend - y) * (blend - y)))', 'blend_rmse')}, {rd('sqrt(avg((regime - y) * (regime - y)))', 'regime_rmse')} FROM e GROUP BY 1""")
def _(t: Tables):
    p = predictions(t)
    blend = (C("persist") + C("smart") + C("rolling")) / 3.0
    regime = F.when(ev.cloud_regime("cot", "cp") == "clear", C("smart")).otherwise(C("rolling"))
    def rmse(x):
        return F.sqrt(F.avg((x - C("y")) * (x - C("y"))))
    return p.groupBy("site").agg(rc(rmse(blend), "blend_rmse"), rc(rmse(regime), "regime_rmse"))


# ---- significance ---------------------------------------------------------

_ANY = "(here = 19 AND nxt = 6 AND ghi BETWEEN 0 AND 1400 AND y BETWEEN 0 AND 1400)"
ANY_TIME = an.AnchorRule(min_elev=None)
BOOT_B, BOOT_BLOCK, BOOT_SEED = 5000, 78, 42
_DRAW = f"('0x' || substr(md5(b || ':' || k || ':{BOOT_SEED}'), 1, 15))::BIGINT"
_LISTS = ["y", "yy", *MODELS]
_PART = "list_sum(list_slice({0}s, s + 1, s + len))"
_BOOT = f"""{pred_sql(_ANY)}, ls AS (SELECT site, count(*) AS n, least({BOOT_BLOCK}, count(*)) AS blk, list(y ORDER BY ts) AS ys, list(y * y ORDER BY ts) AS yys,
  {', '.join(f'list((y - {m}) * (y - {m}) ORDER BY ts) AS {m}s' for m in MODELS)} FROM pr GROUP BY 1), s2 AS (SELECT *, (n + blk - 1) // blk AS nb FROM ls),
dr AS (SELECT site, n, blk, nb, b, unnest(generate_series(0, nb - 1)) AS k FROM (SELECT *, unnest(generate_series(0, {BOOT_B - 1})) AS b FROM s2)),
st AS (SELECT site, b, {_DRAW} % (n - blk + 1) AS s, CASE WHEN k = nb - 1 THEN n - (nb - 1) * blk ELSE blk END AS len FROM dr),
sm AS (SELECT site, b, n, {', '.join(f'sum({_PART.format(c)}) AS {c}' for c in _LISTS)} FROM st JOIN s2 USING (site) GROUP BY ALL),
bt AS (SELECT site, b, {', '.join(f'1 - {m} / nullif(yy - y * y / n, 0) AS r2_{m}' for m in MODELS)} FROM sm)"""


def boot(t: Tables):
    p = predictions(t, ANY_TIME).select("site", "ts", "y", *MODELS)
    # A small table (series x resamples) that every test below reads several times.
    return materialize(sg.block_bootstrap(p, "y", MODELS, resamples=BOOT_B, block=BOOT_BLOCK, seed=BOOT_SEED), "bootstrap")


@query("sig_block_bootstrap", "SIG-1", f"WITH {_BOOT} SELECT site, b, {', '.join(rd(f'r2_{m}', f'r2_{m}', 5) for m in MODELS)} FROM bt")
def _(t: Tables):
    return round_all(boot(t), [f"r2_{m}" for m in MODELS], 5)


_PAIRS = f"""pl AS (SELECT site, 'persist-smart' AS pair, r2_persist - r2_smart AS d FROM bt UNION ALL SELECT site, 'persist-rolling', r2_persist - r2_rolling FROM bt UNION ALL SELECT site, 'smart-rolling', r2_smart - r2_rolling FROM bt),
pt AS (SELECT site, pair, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, 2 * least(avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END), 1 - avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END)) AS p FROM pl WHERE d IS NOT NULL GROUP BY 1, 2)"""


def _pairs(t: Tables):
    p = sg.pair_tests(boot(t), MODELS)
    return p.where(C("ci_lo").isNotNull())


@query("sig_pair_tests", "SIG-2 AGG-9", f"WITH {_BOOT}, {_PAIRS} SELECT site, pair, {rd('ci_lo', 'ci_lo', 5)}, {rd('ci_hi', 'ci_hi', 5)}, {rd('p', 'p')}, ci_lo > 0 OR ci_hi < 0 AS significant FROM pt")
def _(t: Tables):
    return round_all(round_all(_pairs(t), ["ci_lo", "ci_hi"], 5), ["p"])


@query("sig_spread", "SIG-3", f"""WITH {_BOOT}, s AS (SELECT site, greatest(r2_persist, r2_smart, r2_rolling) - least(r2_persist, r2_smart, r2_rolling) AS x FROM bt)
SELECT site, {rd('quantile_cont(x, 0.025)', 'lo', 5)}, {rd('quantile_cont(x, 0.5)', 'median', 5)}, {rd('quantile_cont(x, 0.975)', 'hi', 5)}, {rd('avg(CASE WHEN x <= 0.01 THEN 1.0::DOUBLE ELSE 0 END)', 'p_small')} FROM s GROUP BY 1""")
def _(t: Tables):
    return round_all(round_all(sg.spread_test(boot(t), MODELS), ["lo", "median", "hi"], 5), ["p_small"])


@query("sig_holm", "SIG-4", f"""WITH {_BOOT}, {_PAIRS}, r AS (SELECT site, pair, p, row_number() OVER (PARTITION BY site ORDER BY p, pair) AS rk, count(*) OVER (PARTITION BY site) AS m FROM pt),
o AS (SELECT *, CASE WHEN p <= 0.05 / (m - rk + 1) THEN 1 ELSE 0 END AS ok FROM r) SELECT site, pair, {rd('p', 'p')}, min(ok) OVER (PARTITION BY site ORDER BY rk) AS holm_pass, ok AS legacy_pass FROM o""")
def _(t: Tables):
    p = _pairs(t)
    h = sg.holm(p).withColumnRenamed("holm_pass", "_h")
    h = sg.holm(h, step_down=False).withColumnRenamed("holm_pass", "legacy_pass")
    return h.select("site", "pair", rc(C("p"), "p"), C("_h").alias("holm_pass"), "legacy_pass")


# ---- calibration ---------------------------------------------------------

def banded(t: Tables):
    """Orders with an 80 % band per priority from the first three years."""
    o = t.orders.select(C("o_orderpriority").alias("site"), C("o_orderdate").alias("ts"), C("o_totalprice").alias("y"), "o_orderkey")
    band = sg.residual_bands(o.where(tl.before("ts", "1998-01-01")), "y", ["site"])
    return o.join(band, ["site"]).withColumnsRenamed({"q_lo": "lo", "q_hi": "hi"})


_BAND = """o AS (SELECT o_orderpriority AS site, o_orderdate AS ts, o_totalprice AS y, o_orderkey FROM orders),
bd AS (SELECT site, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.5) AS mid, quantile_cont(y, 0.9) AS hi, count(*) AS nb FROM o WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1),
sc AS (SELECT o.*, lo, mid, hi, nb, greatest(lo - y, y - hi) AS score, date_trunc('month', ts) AS month FROM o JOIN bd USING (site))"""
_CAL = f"""{_BAND}, mo AS (SELECT site, CAST(month AS TIMESTAMP) AS month, min(ts) AS f FROM sc GROUP BY 1, 2),
us AS (SELECT mo.site, mo.month, s.score FROM mo JOIN sc s ON s.site = mo.site AND s.month < mo.month AND s.ts >= mo.f - INTERVAL 60 DAY),
q0 AS (SELECT site, month, list_sort(list(score)) AS v, count(*) AS n FROM us GROUP BY 1, 2), q1 AS (SELECT *, least(ceil((n + 1) * (1.0::DOUBLE - 0.2::DOUBLE)) / n, 1.0::DOUBLE) * (n - 1) AS pos FROM q0),
q2 AS (SELECT site, month, n, v[CAST(floor(pos) AS INT) + 1] + (v[CAST(ceil(pos) AS INT) + 1] - v[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)) AS q FROM q1),
co AS (SELECT mo.site, mo.month, coalesce(n, 0) AS n_scores, coalesce(last_value(CASE WHEN n >= 30 THEN q END IGNORE NULLS) OVER (PARTITION BY mo.site ORDER BY mo.month ROWS UNBOUNDED PRECEDING), 0) AS correction
FROM mo LEFT JOIN q2 ON q2.site = mo.site AND q2.month = mo.month)"""


@query("ml_residual_bands", "ML-10 AGG-9", f"WITH {_BAND} SELECT site, {rd('lo', 'q_lo', 4)}, {rd('mid', 'q_mid', 4)}, {rd('hi', 'q_hi', 4)}, nb AS n_band FROM bd")
def _(t: Tables):
    o = t.orders.select(C("o_orderpriority").alias("site"), C("o_orderdate").alias("ts"), C("o_totalprice").alias("y"))
    b = sg.residual_bands(o.where(tl.before("ts", "1998-01-01")), "y", ["site"])
    return round_all(b, ["q_lo", "q_mid", "q_hi"], 4)


@query("cal_rolling_corrections", "CAL-1 JN-17", f"WITH {_CAL} SELECT site, month, n_scores, {rd('correction', 'correction', 4)} FROM co")
def _(t: Tables):
    return round_all(sg.rolling_corrections(banded(t), "y", "lo", "hi"), ["correction"], 4)


@query("cal_rolling_coverage", "CAL-1 MET-5", f"""WITH {_CAL}, a AS (SELECT s.site, y, lo - correction AS la, hi + correction AS ha, lo, hi FROM sc s JOIN co ON co.site = s.site AND co.month = s.month)
SELECT site, count(*) AS n, {rd('avg(CASE WHEN y BETWEEN la AND ha THEN 1.0::DOUBLE ELSE 0 END)', 'coverage')}, {rd('avg(ha - la)', 'width', 3)} FROM a GROUP BY 1""")
def _(t: Tables):
    a = sg.rolling_conformal(banded(t), "y", "lo", "hi")
    s = ev.interval_scores(a, "y", "lo_adj", "hi_adj", ["site"])
    return round_all(round_all(s, ["coverage"]), ["width"], 3)


@query("cal_static_correction", "CAL-2 MET-5", f"""WITH {_BAND}, tr AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS i, count(*) OVER (PARTITION BY site) AS m, max(ts) OVER (PARTITION BY site) AS last FROM sc WHERE ts < TIMESTAMP '1998-01-01'),
ca AS (SELECT * FROM tr WHERE i > m - floor(m * 0.2::DOUBLE) AND ts >= last - INTERVAL 60 DAY), q0 AS (SELECT site, list_sort(list(score)) AS v, count(*) AS n FROM ca GROUP BY 1),
q1 AS (SELECT *, least(ceil((n + 1) * (1.0::DOUBLE - 0.2::DOUBLE)) / n, 1.0::DOUBLE) * (n - 1) AS pos FROM q0)
SELECT site, n AS n_scores, {rd('v[CAST(floor(pos) AS INT) + 1] + (v[CAST(ceil(pos) AS INT) + 1] - v[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos))', 'correction', 4)} FROM q1""")
def _(t: Tables):
    cal = sg.calibration_window(banded(t).where(tl.before("ts", "1998-01-01")), width_s=365 * tl.DAY)
    return round_all(sg.static_correction(cal, "y", "lo", "hi"), ["correction"], 4)
