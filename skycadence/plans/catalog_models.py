"""Queries that fit and score models. Most have no SQL twin; tests check invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import timeline as tl
from skycadence.operators import anchors as an
from skycadence.operators import evaluate as ev
from skycadence.operators import modeling as md
from skycadence.operators.analogs import analog_ensemble, standardize
from skycadence.operators.windows import lag
from skycadence.plans.catalog_features import recipe
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import rc, rd, round_all, series
from skycadence.session import scratch_path
from skycadence.sources.sinks import materialize
from skycadence.spec import CLOUD_FEATURES, FEATURES, FUTURE_FEATURES, LEVEL_FEATURES, RATIO_FEATURES, TIME_FEATURES

C = F.col
LEAN = ["ghi_now", "ghi_lag_10m", "ghi_roll_60m_mean", "ghi_roll_180m_mean", "kt_now", "clp_cot", "hour_sin", "hour_cos", "ghi_cs_t60", "smart_persist"]
FAST = {"rounds": 20, "depth": 3}


def training_frame(t: Tables, extra=()):
    """Recipe rows with a chronological role, written once for the fits that follow."""
    r = recipe(t, extra=extra).where(C("ghi_point_t60").isNotNull())
    role = F.when(tl.before("ts", "2024-01-20"), "train").when(tl.before("ts", "2024-01-25"), "valid").otherwise("test")
    return materialize(r.withColumn("role", role).withColumn("weight", F.when(C("clp_cot").isNull(), 0.7).otherwise(1.0)), "recipe")


def _scores(df, preds, label="ghi_point_t60", by=()):
    m = ev.metrics(df, label, preds, base="smart_persist", by=list(by))
    return m.select(*by, "model", "n", "r2", "mae", "rmse", "skill_rmse")


@query("ml_forest_and_stacking", "ML-4 ML-5 ML-7")
def _(t: Tables):
    d = training_frame(t)
    train, valid, test = [d.where(C("role") == r) for r in ("train", "valid", "test")]
    forest = md.fit_forest(train, LEAN, "ghi_point_t60", trees=8, depth=4, weight="weight")
    boost = md.fit_boosted(train, LEAN, "delta_point", weight="weight", **FAST)
    def both(x):
        return md.predict(boost, md.predict(forest, x, LEAN, "forest"), LEAN, "boost", now="ghi_now")
    p = md.stack(both(valid), both(test), ["forest", "boost"], "ghi_point_t60")
    return _scores(p, ["forest", "boost", "stacked"])


@query("ml_ridge_windows", "ML-6 WIN-24")
def _(t: Tables):
    cols = [f"w{k}" for k in range(18)]
    s = series(t, lambda g, w: g.select("*", C("ghi").alias("w0"), *[lag("ghi", k, w).alias(f"w{k}") for k in range(1, 18)], *an.target_columns("ghi", w)), back=17, ahead=6)
    s = materialize(s.where(C("w17").isNotNull() & C("ghi").isNotNull() & C("y_6").isNotNull()))
    m = md.fit_ridge(s.where(tl.before("ts", "2024-01-22")), cols, "y_6")
    p = md.predict(m, s.where(tl.on_or_after("ts", "2024-01-22")), cols, "ridge")
    return ev.metrics(p, "y_6", ["ridge", "ghi"], base="ghi", by=["site"]).select("site", "model", "n", "r2", "rmse", "skill_rmse")


@query("ml_importance", "ML-11 SRT-2")
def _(t: Tables):
    d = training_frame(t)
    return md.importances(md.fit_boosted(d, FEATURES, "delta_point", role="role", **FAST), FEATURES, t.spark)


@query("ml_pca_curve", "ML-16 SRT-3")
def _(t: Tables):
    d = training_frame(t).where(C("role") == "train")
    blocks = {"level": LEVEL_FEATURES, "ratio": RATIO_FEATURES, "cloud": CLOUD_FEATURES, "time": TIME_FEATURES, "future": FUTURE_FEATURES}
    out = None
    for name, feats in blocks.items():
        part = md.components_needed(md.pca_curve(d, feats)).withColumn("block", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("ml_pca_walk_forward", "ML-17 SPL-5")
def _(t: Tables):
    d = training_frame(t).drop("role")
    f = materialize(an.folds_by_count(d, 5, order=("ts",)), "folds")
    out = None
    for i in range(1, 6):
        part = f.where(C("fold") == i)
        m = md.fit_pca_ridge(part.where(C("role") == "train"), LEAN, "ghi_point_t60", 5)
        s = _scores(md.predict(m, part.where(C("role") == "test"), LEAN, "pca_ridge"), ["pca_ridge"]).withColumn("fold", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


@query("ml_save_and_score", "ML-19 ML-20")
def _(t: Tables):
    d = training_frame(t)
    path = scratch_path(t.spark, "model")
    md.save_model(t.spark, md.fit_boosted(d, LEAN, "delta_point", role="role", rounds=4, depth=3), path, {"features": LEAN, "target": "delta_point"})
    model, meta = md.load_model(t.spark, path)
    return md.predict(model, d.where(C("role") == "test"), meta["features"], "pred", now="ghi_now").select("site", "ts", "pred")


_ZSQL = """e AS (SELECT vec_id, label, embedding, (vec_id * 2654435761 + 3 * 40503) % 4294967296 < 858993459 AS is_query FROM embeddings),
d AS (SELECT vec_id, label, is_query, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e), st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM d WHERE NOT is_query GROUP BY 1),
z AS (SELECT vec_id, any_value(label) AS label, any_value(is_query) AS is_query, list((v - m) / s ORDER BY i) AS z FROM d JOIN st USING (i) GROUP BY 1),
p AS (SELECT a.vec_id, b.label, list_distance(a.z, b.z) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.z, b.z), b.vec_id) AS rn FROM z a, z b WHERE a.is_query AND NOT b.is_query)"""


@query("ml_analog_ensemble", "ML-18", f"WITH {_ZSQL} SELECT vec_id, count(*) AS n, {rd('avg(label)', 'analog_mean')}, {rd('max(dist)', 'farthest', 5)} FROM p WHERE rn <= 30 GROUP BY 1")
def _(t: Tables):
    e = t.embeddings.withColumn("is_query", an.scrambled("vec_id", 3) < 858993459)
    e = standardize(e, "embedding", ~C("is_query"))
    out = analog_ensemble(e.where("is_query"), e.where(~C("is_query")), qid="vec_id", xid="vec_id", vec="z", y="label", k=30, rows_per_block=512)
    return out.select(C("qid").alias("vec_id"), "n", rc(C("analog_mean"), "analog_mean"), rc(C("farthest"), "farthest", 5))
