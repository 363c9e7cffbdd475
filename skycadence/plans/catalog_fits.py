"""Queries over linear fits from sums and over boosted trees that share their scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import solar as so
from skycadence.operators import anchors as an
from skycadence.operators import boosting as bo
from skycadence.operators import evaluate as ev
from skycadence.operators import result_tables as rt
from skycadence.operators import sums as sm
from skycadence.operators import windows as wn
from skycadence.operators.encoding import ordered_target_mean
from skycadence.plans.catalog_features import RECIPE_SQL, recipe
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import rc, rd, round_all, rsql, series
from skycadence.sources.sinks import materialize
from skycadence.spec import CLOUD_FEATURES, FEATURES, FUTURE_FEATURES, LEVEL_FEATURES, RATIO_FEATURES, TIME_FEATURES

C = F.col
Y = "ghi_point_t60"
FOLDS = 5
NULLABLE = CLOUD_FEATURES
WHOLE = [f for f in FEATURES if f not in NULLABLE]
ALPHA = 10.0


def fit_frame(t: Tables):
    """Recipe rows with their five-day block (0 to 5) and season, written once for the passes that follow."""
    r = recipe(t).where(C(Y).isNotNull())
    block = F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(FOLDS)).cast("int")
    return materialize(r.withColumn("block", block).withColumn("season", so.season_two(F.month("ts"))), "fits")


_FIT = f"""{RECIPE_SQL}, fr AS (SELECT *, least((day(ts) - 1) // 5, {FOLDS})::INTEGER AS block, CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'dry' ELSE 'wet' END AS season
FROM recipe WHERE {Y} IS NOT NULL)"""


def _columns_sql() -> tuple[str, str]:
    """(one row of pivots, list of the columns' values) for the table of sums."""
    piv = ", ".join(f"floor(avg({f}::DOUBLE) + 0.5) AS p_{f}" for f in FEATURES)
    values = ["1.0::DOUBLE", *[f"coalesce({f}::DOUBLE - p_{f}, 0)" for f in FEATURES], *[f"({f} IS NULL)::INTEGER::DOUBLE" for f in FEATURES if f in NULLABLE], Y]
    return piv, ", ".join(values)


_PIV, _VALUES = _columns_sql()
_NAMES = [sm.ONE, *sm.columns_of(FEATURES, NULLABLE), sm.LABEL]


@query("ml_sums_table", "ML-6 CMP-2 SPL-4", f"""WITH {_FIT}, pv AS (SELECT {_PIV} FROM fr), v AS (SELECT row_number() OVER () AS k, site, block, season, [{_VALUES}] AS x FROM fr, pv),
u AS (SELECT k, site, block, season, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM v), names AS (SELECT {_NAMES} AS a)
SELECT u.site, u.block, u.season, (SELECT a FROM names)[u.p] AS i, (SELECT a FROM names)[w.p] AS j, {rd('sum(u.x * w.x)', 's', 2)} FROM u JOIN u w ON w.k = u.k AND w.p >= u.p GROUP BY u.site, u.block, u.season, u.p, w.p""")
def _(t: Tables):
    d = fit_frame(t)
    s = sm.sums(d, FEATURES, Y, ["site", "block", "season"], nullable=NULLABLE, centre=sm.pivots(d, FEATURES))
    return round_all(s, ["s"], 2)


def _folds(t: Tables, features, nullable=(), by=("site",)):
    d = fit_frame(t)
    table = sm.sums(d, features, Y, [*by, "block"], nullable=nullable, centre=sm.pivots(d, features))
    return sm.walk_forward(materialize(table, "sums"), "block", FOLDS, by)


def _ridge_sql(x: str, train: str) -> str:
    """Sums of a one-feature ridge fit: coefficient and intercept, as columns b and b0."""
    cxx, cxy = f"(sum({x} * {x}) - sum({x}) * sum({x}) / count(*))", f"(sum({x} * {Y}) - sum({x}) * sum({Y}) / count(*))"
    b = f"(CASE WHEN {cxx} > 1e-14::DOUBLE * sum({x} * {x}) THEN {cxy} * count(*) / ({cxx} * (count(*) + {ALPHA}::DOUBLE)) ELSE 0 END)"
    return f"{b} AS b, avg({Y}) - {b} * avg({x}) AS b0"


_CENTRED = ", ".join(f"{f} - floor(avg({f}) OVER () + 0.5) AS {f}" for f in WHOLE)
_TRY = [f for f in WHOLE if f != "ghi_now"]
_R2 = "1 - sum(({y} - p) * ({y} - p)) / nullif(sum({y} * {y}) - sum({y}) * sum({y}) / count(*), 0)".format(y=Y)
# The two-feature ridge in closed form: standardised features, penalty ALPHA on their coefficients.
_PAIR = f"""{_FIT}, ce AS (SELECT site, block, {Y}, {_CENTRED} FROM fr), fo AS (SELECT unnest(range(1, {FOLDS + 1}))::INTEGER AS fold),
lo AS (SELECT site, block, {Y}, ghi_now AS x1, unnest({_TRY}) AS feature, unnest([{', '.join(_TRY)}]) AS x2 FROM ce),
m AS (SELECT site, fold, feature, count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg({Y}) AS my, sum(x2 * x2) AS raw,
  sum(x1 * x1) - sum(x1) * sum(x1) / count(*) AS c11, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) AS c22, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS c12,
  sum(x1 * {Y}) - sum(x1) * sum({Y}) / count(*) AS c1y, sum(x2 * {Y}) - sum(x2) * sum({Y}) / count(*) AS c2y FROM lo JOIN fo ON block < fold GROUP BY 1, 2, 3),
q AS (SELECT *, c11 * (1 + {ALPHA}::DOUBLE / n) AS d1, c22 * (1 + {ALPHA}::DOUBLE / n) AS d2, c22 > 1e-14::DOUBLE * raw AS used FROM m),
co AS (SELECT *, c1y / d1 AS b_one, CASE WHEN used THEN (c1y * d2 - c2y * c12) / (d1 * d2 - c12 * c12) ELSE c1y / d1 END AS b1,
  CASE WHEN used THEN (c2y * d1 - c1y * c12) / (d1 * d2 - c12 * c12) ELSE 0 END AS b2 FROM q),
pr AS (SELECT lo.site, fo.fold, lo.feature, {Y}, my + b_one * (x1 - m1) AS p1, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p
  FROM lo JOIN fo ON block = fold JOIN co ON co.site = lo.site AND co.fold = fo.fold AND co.feature = lo.feature)"""


@query("cmp_add_one", "CMP-2", f"""WITH {_PAIR} SELECT site, fold, feature, {rd(_R2.replace('p)', 'p1)'), 'r2_base', 4)}, {rd(_R2, 'r2', 4)} FROM pr GROUP BY 1, 2, 3""")
def _(t: Tables):
    train, held = _folds(t, WHOLE)
    a = sm.add_one(train, held, ["ghi_now"], _TRY, ["site", "fold"], alpha=ALPHA).where(C("r2").isNotNull())
    return round_all(a.select("site", "fold", "feature", "r2_base", "r2"), ["r2_base", "r2"], 4)


_GROUPS = {"level": LEVEL_FEATURES, "ratio": RATIO_FEATURES, "cloud": CLOUD_FEATURES, "time": TIME_FEATURES, "future": FUTURE_FEATURES}


@query("cmp_cumulative_groups", "CMP-1 CMP-2")
def _(t: Tables):
    train, held = _folds(t, FEATURES, NULLABLE)
    steps, so_far = {}, []
    for name, feats in _GROUPS.items():
        so_far = [*so_far, *feats]
        steps[name] = so_far
    s = sm.subset_scores(train, held, FEATURES, steps, ["site", "fold"], nullable=NULLABLE, alpha=ALPHA)
    return ev.incremental_gain(s, "step", "r2", ["site", "fold"])


_SEASON = f"""{_FIT}, ce AS (SELECT site, block, season, {Y}, ghi_now - floor(avg(ghi_now) OVER () + 0.5) AS x FROM fr),
own AS (SELECT site, season, {_ridge_sql('x', 'ce')} FROM ce WHERE block < 4 GROUP BY 1, 2 HAVING count(*) >= 30), al AS (SELECT site, {_ridge_sql('x', 'ce')} FROM ce WHERE block < 4 GROUP BY 1),
pr AS (SELECT ce.site, CASE WHEN own.b IS NULL THEN '*' ELSE ce.season END AS source, {Y} AS y, least(greatest(coalesce(own.b0 + own.b * x, al.b0 + al.b * x), 0), 1400) AS p
  FROM ce LEFT JOIN own ON own.site = ce.site AND own.season = ce.season LEFT JOIN al ON al.site = ce.site WHERE block >= 4)"""


@query("evl_season_models", "EVL-5 ML-9", f"""WITH {_SEASON} SELECT site, source, count(*) AS n, {rd('sqrt(avg((p - y) * (p - y)))', 'rmse', 4)}, {rd('avg(p - y)', 'mbe', 4)} FROM pr WHERE p IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    d = fit_frame(t)
    centre = sm.pivots(d, ["ghi_now"])
    table = sm.sums(d.where("block < 4"), ["ghi_now"], Y, ["site", "season"], centre=centre)
    p = sm.group_models(d.where("block >= 4"), table, ["ghi_now"], "season", "p", ["site"], centre=centre, alpha=ALPHA, min_rows=30)
    m = ev.metrics(p.withColumnRenamed("p_model", "source"), Y, ["p"], by=["site", "source"])
    return round_all(m.select("site", "source", "n", "rmse", "mbe"), ["rmse", "mbe"], 4)


SEEDS = 5
_MODELS = {"level": "ghi_now", "smart": "smart_persist"}
_CDF = sm.poisson_steps(1.0)


def _seed_sql() -> str:
    u = "('0x' || substr(md5(concat_ws('|', site, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'seed' || seed)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    count = f"len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in _CDF)}], lambda c: c <= {u}))"
    pairs = " UNION ALL ".join(f"SELECT site, block, ts, '{m}' AS model, {f} - floor(avg({f}) OVER () + 0.5) AS x, {Y} AS y FROM fr" for m, f in _MODELS.items())
    return f"""{_FIT}, lo AS ({pairs}), sd AS (SELECT unnest(range({SEEDS}))::INTEGER AS seed),
w AS (SELECT site, model, seed, x, y, {count}::DOUBLE AS w FROM lo, sd WHERE block < 4),
m AS (SELECT site, model, seed, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS cxx,
  sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS cxy FROM w GROUP BY 1, 2, 3),
pr AS (SELECT lo.site, lo.model, seed, y, my + cxy * n / (cxx * (n + {ALPHA}::DOUBLE)) * (x - mx) AS p FROM lo JOIN m ON m.site = lo.site AND m.model = lo.model WHERE block >= 4),
sc AS (SELECT site, model, seed, {rsql('1 - sum((y - p) * (y - p)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)', 6)} AS r2 FROM pr GROUP BY 1, 2, 3),
g AS (SELECT site, model, count(*) AS n_seeds, avg(r2) AS a, stddev_samp(r2) AS s, stddev_pop(r2) AS p FROM sc GROUP BY 1, 2)"""


def _seed_scores(t: Tables):
    """Scores of the one-feature models over seeds: weighted fits in one pass, the same held-out rows for all."""
    d = fit_frame(t)
    feats = list(_MODELS.values())
    centre = sm.pivots(d, feats)
    drawn = d.where("block < 4").withColumn("w", sm.poisson_weights(["site", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")], SEEDS))
    train = sm.sums(drawn, feats, Y, ["site"], centre=centre, weights="w")
    held = sm.sums(d.where("block >= 4"), feats, Y, ["site"], centre=centre).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    s = sm.subset_scores(train, held, feats, {m: [f] for m, f in _MODELS.items()}, ["site", "seed"], alpha=ALPHA).where(C("r2").isNotNull())
    return s


@query("cmp_seeds", "CMP-3 AGG-16", f"""WITH {_seed_sql()} SELECT site, model, n_seeds, {rd('a', 'avg', 5)}, {rd('s', 'std', 5)}, {rd('p', 'std_pop', 5)},
CAST(row_number() OVER (PARTITION BY site ORDER BY a DESC, model) AS INTEGER) AS rank FROM g""")
def _(t: Tables):
    s = _seed_scores(t)
    s = s.select("site", C("subset").alias("model"), "seed", rc("r2", "r2"))
    return round_all(ev.seed_summary(s, "r2", ["site", "model"], ["site"]), ["avg", "std", "std_pop"], 5)


SIZES = [3, 5, 8, 10, 12, 15, 20, 25, 30, 35, 40, 45]


@query("ml_topk_sweep", "ML-12 SRT-4")
def _(t: Tables):
    train, held = _folds(t, FEATURES, NULLABLE)
    return sm.topk_sweep(train, held, FEATURES, SIZES, ["site", "fold"], nullable=NULLABLE, alpha=ALPHA)


@query("ml_backward_elimination", "ML-13")
def _(t: Tables):
    train, held = _folds(t, FEATURES, NULLABLE)
    return sm.eliminate(train, held, FEATURES, ["site", "fold"], nullable=NULLABLE, alpha=ALPHA, tolerance=0.001)


@query("ml_greedy_search", "ML-14")
def _(t: Tables):
    train, held = _folds(t, FEATURES, NULLABLE)
    return sm.eliminate(train, held, FEATURES, ["site", "fold"], every=True, nullable=NULLABLE, alpha=ALPHA, tolerance=0.0003, min_features=3)


# ---- boosted trees that share their scans ---------------------------------------


def _role(k: int):
    """Role in fold k: test is block k, the stop set is the two days before, training all before those."""
    day = F.dayofmonth("ts")
    return F.when(C("block") == k, "test").when(C("block") > k, "later").when(day > 5 * k - 2, "stop").otherwise("train")


_TARGETS = {"point": (Y, "delta_point"), "mean": ("ghi_avg_t10_t60", "delta_avg")}


@query("ml_benchmark", "ML-1 ML-2 ML-20 TGT-3 MET-2 SPL-1 SPL-4")
def _(t: Tables):
    """Both targets, residual and direct, five folds with a stop set: twenty models in one run."""
    d = fit_frame(t)
    for k in range(1, FOLDS + 1):
        d = d.withColumn(f"role{k}", _role(k))
    arms = [bo.Arm(f"{target}_{kind}_{k}", label, tuple(FEATURES), role=f"role{k}", depth=3, rate=0.1, rounds=20, patience=6)
            for k in range(1, FOLDS + 1) for target, labels in _TARGETS.items() for kind, label in zip(("direct", "residual"), labels)]
    models = {m["arm"]["name"]: m for m in bo.fit_arms(d, arms)}
    p = materialize(bo.predict(d, models, now={n: "ghi_now" for n in models if "_residual_" in n}), "benchmark")
    smart = {"point": "smart_persist", "mean": "smart_persist_avg"}
    out = None
    for k in range(1, FOLDS + 1):
        for target, (label, _) in _TARGETS.items():
            rows = p.where(C(f"role{k}") == "test").withColumnsRenamed({f"{target}_{kind}_{k}": kind for kind in ("direct", "residual")})
            m = ev.metrics(rows, label, [smart[target], "direct", "residual"], base=smart[target])
            m = m.select(F.lit(target).alias("target"), F.lit(k).alias("fold"), "model", "n", "r2", "mae", "rmse", "skill_rmse")
            out = m if out is None else out.unionByName(m)
    return out


@query("ml_walk_forward", "ML-1 ML-6 SPL-4 MET-2")
def _(t: Tables):
    """Ridge on the whole recipe, five expanding folds, from one table of sums."""
    train, held = _folds(t, FEATURES, NULLABLE)
    return sm.subset_scores(train, held, FEATURES, {"recipe": FEATURES}, ["site", "fold"], nullable=NULLABLE, alpha=ALPHA).drop("step")


@query("ml_per_horizon", "ML-3 MET-4")
def _(t: Tables):
    """One model per lead time, all six in one run."""
    s = series(t, lambda g, w: g.select("*", *an.target_columns("ghi", w), *[wn.lag("ghi", k, w).alias(f"l{k}") for k in (1, 2, 3, 6)], wn.rolling("ghi", 18, "mean", w).alias("m18")), back=18, ahead=6)
    day = F.dayofmonth("ts")
    s = materialize(s.where(C("ghi").isNotNull() & C("l3").isNotNull()).withColumn("role", F.when(day <= 18, "train").when(day <= 21, "stop").otherwise("test")))
    feats = ("ghi", "l1", "l2", "l3", "l6", "m18")
    arms = [bo.Arm(f"p_{h}", f"y_{h}", feats, rounds=20, patience=6) for h in range(1, 7)]
    p = bo.predict(s.where("role = 'test'"), {m["arm"]["name"]: m for m in bo.fit_arms(s, arms)})
    long = p.select("ghi", F.explode(F.array(*[F.struct(F.lit(h * 10).alias("horizon"), C(f"y_{h}").alias("y"), C(f"p_{h}").alias("boosted")) for h in range(1, 7)])).alias("_h"))
    return ev.metrics(long.select("ghi", "_h.*"), "y", ["boosted"], base="ghi", by=["horizon"]).select("horizon", "model", "n", "r2", "rmse", "skill_rmse")


LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query("ml_quantiles", "ML-10 CAL-1")
def _(t: Tables):
    """P10, P50 and P90 under the pinball loss, against the constant bands of the training rows."""
    d = fit_frame(t).withColumn("role", _role(4))
    arms = [bo.Arm(n, Y, tuple(FEATURES), level=v, depth=3, rate=0.2, rounds=10, patience=4) for n, v in LEVELS.items()]
    run = {m["arm"]["name"]: m for m in bo.fit_arms(d, arms)}
    p = bo.predict(d.where("role = 'test'"), run)
    p = p.select("site", Y, *bo.uncrossed(list(LEVELS)), *[F.lit(run[n]["base"]).cast("double").alias(f"band_{n}") for n in LEVELS])
    inside = C(Y).between(C("p10"), C("p90")).cast("double")
    return p.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.count_if((C("p10") > C("p50")) | (C("p50") > C("p90"))).alias("crossings"),
                                 *[bo.pinball(Y, n, v).alias(f"loss_{n}") for n, v in LEVELS.items()],
                                 *[bo.pinball(Y, f"band_{n}", v).alias(f"band_loss_{n}") for n, v in LEVELS.items()])


_HIST = ["ghi_now", "kt_now", "clp_cot", "hour_sin"]
_EDGES = {"ghi_now": [100.0 * k for k in range(1, 13)], "kt_now": [0.125 * k for k in range(1, 9)], "clp_cot": [float(k) for k in range(1, 25, 2)], "hour_sin": [-0.75, -0.5, -0.25, 0.0]}


def _hist_sql() -> str:
    bins = ", ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 + len(list_filter({_EDGES[f]}::DOUBLE[], lambda e: e < {f})) END" for f in _HIST)
    return f"""{_FIT}, tr AS (SELECT *, [{bins}] AS bins FROM fr WHERE block < 4 AND day(ts) <= 18), q AS (SELECT {', '.join(f'quantile_cont({Y}, {v}) AS {n}' for n, v in LEVELS.items())} FROM tr),
u AS (SELECT unnest(bins) AS bin, unnest({_HIST}) AS feature, {Y} AS y FROM tr)"""


@query("ml_quantile_histogram", "ML-10 AGG-1", f"WITH {_hist_sql()} " + " UNION ALL ".join(
    f"SELECT '{n}' AS arm, feature, bin::INTEGER AS bin, count(*)::DOUBLE AS n, {rd(f'sum(CASE WHEN y > {n} THEN {v}::DOUBLE ELSE {v}::DOUBLE - 1 END)', 'g', 4)} FROM u, q GROUP BY 2, 3" for n, v in LEVELS.items()))
def _(t: Tables):
    """The first level's histogram of the quantile trees: counts and slopes of the pinball loss per bin."""
    d = fit_frame(t).withColumn("role", _role(4))
    arms = [bo.Arm(n, Y, tuple(_HIST), level=v) for n, v in LEVELS.items()]
    cells = bo.first_histogram(d, arms, _EDGES)
    return round_all(cells.select("arm", "feature", "bin", "n", "g"), ["g"], 4)


@query("ml_random_search", "ML-15")
def _(t: Tables):
    """Twenty parameter draws as one race: the better half of the trials goes on after 4, 8 and 16 trees."""
    d = fit_frame(t).withColumn("role", _role(4))
    draws = bo.draws({"depth": [2, 3, 4], "rate": [0.05, 0.1, 0.15, 0.2, 0.3], "min_leaf": [5, 10, 20], "shrink": [0.5, 1.0, 5.0]}, 20, seed=42)
    arms = [bo.Arm(f"trial_{k:02d}", "delta_point", tuple(FEATURES), rounds=16, patience=16, **p) for k, p in enumerate(draws)]
    _, table = bo.race(d, arms, first=4)
    rows = [(name, stage, trees, loss, kept, *[float(draws[int(name[-2:])][c]) for c in ("depth", "rate", "min_leaf", "shrink")]) for name, stage, trees, loss, kept in table]
    return t.spark.createDataFrame(rows, "trial string, stage int, trees int, stop_mse double, kept boolean, depth double, rate double, min_leaf double, shrink double")


@query("ml_regimes", "ML-9 CMP-6")
def _(t: Tables):
    """A model per cloud regime with enough rows, and the model of all rows for the others, in one run."""
    d = fit_frame(t).withColumn("role", _role(4)).withColumn("regime", ev.cloud_regime("clp_cot"))
    names = ["clear", "partly", "overcast"]
    sizes = {r["regime"]: r["n"] for r in d.where("role = 'train'").groupBy("regime").agg(F.count("*").alias("n")).where(C("regime").isin(names)).collect()}
    own = [n for n in names if sizes.get(n, 0) >= 40]
    for n in own:
        d = d.withColumn(f"role_{n}", F.when(C("regime") == n, C("role")).otherwise("other"))
    arms = [bo.Arm("all", "delta_point", tuple(FEATURES), rounds=15, patience=6)]
    arms += [bo.Arm(n, "delta_point", tuple(FEATURES), role=f"role_{n}", rounds=15, patience=6) for n in own]
    models = {m["arm"]["name"]: m for m in bo.fit_arms(d, arms)}
    p = bo.predict(d.where("role = 'test'"), {f"m_{n}": m for n, m in models.items()}, now={f"m_{n}": "ghi_now" for n in models})
    routed = C("m_all")
    for n in own:
        routed = F.when(C("regime") == n, C(f"m_{n}")).otherwise(routed)
    p = p.select("regime", Y, "smart_persist", C("m_all").alias("one_model"), routed.alias("by_regime"))
    return ev.metrics(p, Y, ["smart_persist", "one_model", "by_regime"], base="smart_persist", by=["regime"]).select("regime", "model", "n", "r2", "rmse", "skill_rmse")


# ---- categories -----------------------------------------------------------------

_SKY = "CASE WHEN clp_cot IS NULL THEN 'no_data' WHEN clp_cot <= 5 THEN 'thin' WHEN clp_cot <= 15 THEN 'medium' ELSE 'thick' END"


@query("ml_target_statistics", "ML-8 PRJ-10", f"""WITH {_FIT}, s AS (SELECT *, {_SKY} AS sky FROM fr), g AS (SELECT site, sum({Y}) OVER z AS gs, count({Y}) OVER z AS gn, ts, sky,
sum({Y}) OVER c AS cs, count({Y}) OVER c AS cn FROM s WINDOW z AS (PARTITION BY site ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING),
c AS (PARTITION BY site, sky ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING))
SELECT site, ts, sky, cn AS n_before, {rd('(coalesce(cs, 0) + 20 * gs / nullif(gn, 0)) / (cn + 20)', 'sky_mean', 4)} FROM g""")
def _(t: Tables):
    """The target's mean over earlier rows of the same sky class whose target was known an hour ago, drawn to the mean of all."""
    d = fit_frame(t).withColumn("sky", ev.cot_class("clp_cot"))
    e = ordered_target_mean(d, "sky", Y, delay_s=3600, prior=20.0)
    return round_all(e.select("site", "ts", "sky", "n_before", "sky_mean"), ["sky_mean"], 4)


@query("ml_categorical_feature", "ML-8 PRJ-10")
def _(t: Tables):
    """Boosting with the sky class as an ordered target statistic, and without it."""
    d = fit_frame(t).withColumn("role", _role(4)).withColumn("sky", ev.cot_class("clp_cot"))
    d = materialize(ordered_target_mean(d, "sky", Y, delay_s=3600, prior=20.0), "encoded")
    arms = [bo.Arm("without", "delta_point", tuple(FEATURES), rounds=15, patience=6), bo.Arm("with_sky", "delta_point", (*FEATURES, "sky_mean"), rounds=15, patience=6)]
    models = {m["arm"]["name"]: m for m in bo.fit_arms(d, arms)}
    p = bo.predict(d.where("role = 'test'"), models, now={n: "ghi_now" for n in models})
    return ev.metrics(p, Y, ["smart_persist", *models], base="smart_persist").select("model", "n", "r2", "mae", "rmse", "skill_rmse")


# ---- published result tables ------------------------------------------------------

_METRICS = ["r2", "mae", "rmse", "skill_rmse"]
_TARGET_SQL = " UNION ALL ".join(f"SELECT site, block, '{target}' AS target, {label} AS y, ghi_now AS persist, {smart} AS smart FROM fr"
                                 for target, label, smart in (("point_t60", Y, "smart_persist"), ("avg_t10_t60", "ghi_avg_t10_t60", "smart_persist_avg")))
_BASE_SQL = f"""{_FIT}, ta AS ({_TARGET_SQL}), lg AS (SELECT site, block, target, y, persist, unnest(['persist', 'smart']) AS model, unnest([persist, smart]) AS p FROM ta)"""
_SCORES_SQL = f"""count(*) AS n, {rd('1 - sum((p - y) * (p - y)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)', 'r2', 5)}, {rd('avg(abs(p - y))', 'mae', 5)},
{rd('sqrt(avg((p - y) * (p - y)))', 'rmse', 5)}, {rd('1 - sqrt(avg((p - y) * (p - y))) / nullif(sqrt(avg((persist - y) * (persist - y))), 0)', 'skill_rmse', 5)}"""


def _baseline_scores(d, by):
    """Scores of both baselines on both targets."""
    parts = [d.select(*by, F.lit(target).alias("target"), C(label).alias("y"), C("ghi_now").alias("persist"), C(smart).alias("smart"))
             for target, label, smart in (("point_t60", Y, "smart_persist"), ("avg_t10_t60", "ghi_avg_t10_t60", "smart_persist_avg"))]
    m = ev.metrics(parts[0].unionByName(parts[1]), "y", ["persist", "smart"], base="persist", by=[*by, "target"])
    return round_all(m.select(*by, "target", "model", "n", *_METRICS), _METRICS, 5)


@query("cmp_table_test", "CMP-4 SET-1", f"WITH {_BASE_SQL} SELECT target, site, model, {_SCORES_SQL} FROM lg WHERE block >= 4 AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2, 3")
def _(t: Tables):
    return rt.test_table(_baseline_scores(fit_frame(t).where("block >= 4"), ["site"]), _METRICS)


@query("cmp_table_walk_forward", "CMP-4 AGG-15", f"""WITH {_BASE_SQL}, f AS (SELECT site, block, {_SCORES_SQL} FROM lg WHERE block >= 1 AND target = 'point_t60' AND model = 'smart' AND y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2),
u AS (SELECT site, unnest({_METRICS}) AS metric, unnest([{', '.join(_METRICS)}]) AS value FROM f)
SELECT site, metric, count(value) AS n_folds, {rd('avg(value)', 'mean', 4)}, {rd('stddev_samp(value)', 'std', 4)} FROM u WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    s = _baseline_scores(fit_frame(t).where("block >= 1"), ["site", "block"]).where("target = 'point_t60' AND model = 'smart'")
    return round_all(rt.summary_table(s, _METRICS), ["mean", "std"], 4)


@query("cmp_table_feature_value", "CMP-4 CMP-1", f"""WITH {_PAIR}, r AS (SELECT site, {rd(_R2.replace('p)', 'p1)'), 'r2_F1', 4)}, {rd(_R2, 'r2_F2', 4)} FROM pr WHERE fold = 4 AND feature = 'kt_now' GROUP BY 1)
SELECT site, 'point_t60' AS target, r2_F1, r2_F2, {rd('r2_F2 - r2_F1', 'delta_r2', 4)}, CASE WHEN r2_F2 - r2_F1 > 0.010 THEN 'high' WHEN r2_F2 - r2_F1 > 0.005 THEN 'medium' ELSE 'low' END AS value FROM r""")
def _(t: Tables):
    train, held = _folds(t, WHOLE)
    s = sm.subset_scores(train.where("fold = 4"), held.where("fold = 4"), WHOLE, {"F1": ["ghi_now"], "F2": ["ghi_now", "kt_now"]}, ["site"], alpha=ALPHA)
    s = s.where(C("r2").isNotNull()).select("site", F.lit("point_t60").alias("target"), C("subset").alias("features"), rc("r2", "r2", 4))
    return round_all(rt.feature_value_table(s, "F1", "F2"), ["delta_r2"], 4)


@query("cmp_table_seeds", "CMP-4 CMP-3", f"""WITH {_seed_sql()}, sr AS (SELECT site, model, seed, {rsql('sqrt(avg((y - p) * (y - p)))', 6)} AS rmse FROM pr GROUP BY 1, 2, 3)
SELECT sc.site, sc.model, count(*) AS n_seeds, {rd('avg(r2)', 'r2_mean', 4)}, {rd('stddev_samp(r2)', 'r2_std', 4)}, {rd('avg(rmse)', 'rmse_mean', 4)}, {rd('stddev_samp(rmse)', 'rmse_std', 4)}
FROM sc JOIN sr ON sr.site = sc.site AND sr.model = sc.model AND sr.seed = sc.seed WHERE sc.model <> 'smart' OR sc.seed = 0 GROUP BY 1, 2""")
def _(t: Tables):
    s = _seed_scores(t).select("site", C("subset").alias("model"), "seed", rc("r2", "r2"), rc("rmse", "rmse"))
    out = rt.seed_table(s, ["r2", "rmse"], single=["smart"])
    return round_all(out, ["r2_mean", "r2_std", "rmse_mean", "rmse_std"], 4)


@query("cmp_table_pruning", "CMP-4 ML-14")
def _(t: Tables):
    train, held = _folds(t, FEATURES, NULLABLE)
    steps = sm.eliminate(train.where("fold = 4"), held.where("fold = 4"), FEATURES, ["site"], every=True, nullable=NULLABLE, alpha=ALPHA, tolerance=0.0003, min_features=3)
    return rt.pruning_table(steps, FEATURES)
