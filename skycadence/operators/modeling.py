"""Forecast models on Spark ML: residual and direct boosting, stacking, regimes,
feature pruning, parameter search and persistence of fitted models."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycadence.functions.exprs import clip
from skycadence.spec import VALID_MAX, VALID_MIN

C = F.col


def _front(features: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Median imputation, category indexing and assembly, all fitted on training rows."""
    numeric = [f for f in features if f not in categorical]
    filled = [f"{f}__filled" for f in numeric]
    stages = [Imputer(strategy="median", relativeError=0.0, inputCols=numeric, outputCols=filled)]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__ix" for c in categorical], handleInvalid="keep"))
    return [*stages, VectorAssembler(inputCols=[*filled, *[f"{c}__ix" for c in categorical]], outputCol="features", handleInvalid="keep")]


def _usable(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[C(f).cast("double").alias(f) if f in features and t not in ("string",) else C(f) for f, t in df.dtypes])


def boosted(label: str, *, rounds: int = 40, depth: int = 5, rate: float = 0.1, weight: str | None = None, stop: str | None = None,
            subsample: float = 0.8, seed: int = 42, bins: int = 32) -> GBTRegressor:
    g = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=bins,
                     subsamplingRate=subsample, featureSubsetStrategy="0.8", seed=seed)
    if weight:
        g = g.setWeightCol(weight)
    return g.setValidationIndicatorCol(stop) if stop else g


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, *, role: str | None = None, categorical: Sequence[str] = (),
                **kw) -> PipelineModel:
    """Boosted trees with early stopping on ``role == 'valid'`` rows when ``role`` is given."""
    d = _usable(df, features).where(C(label).isNotNull())
    front = _front(features, categorical)
    if role is None:
        return Pipeline(stages=[*front, boosted(label, **kw)]).fit(d)
    d = d.where(C(role).isin("train", "valid")).withColumn("_stop", C(role) == "valid")
    prep = Pipeline(stages=front).fit(d.where(~C("_stop")))  # imputer sees training rows only
    model = boosted(label, stop="_stop", **kw).fit(prep.transform(d))
    return PipelineModel([*prep.stages, model])


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str, *, now: str | None = None,
            lo: float = VALID_MIN, hi: float = VALID_MAX) -> DataFrame:
    """Clipped prediction; with ``now`` the model output is a residual on top of it."""
    p = model.transform(_usable(df, features))
    raw = C("prediction") if now is None else C(now) + C("prediction")
    return p.select(*df.columns, clip(raw, lo, hi).alias(out))


def fit_horizons(df: DataFrame, features: Sequence[str], labels: dict[int, str], **kw) -> dict[int, PipelineModel]:
    """One model per lead time, fitted concurrently as separate Spark jobs."""
    with ThreadPoolExecutor(min(len(labels), 4)) as pool:
        jobs = {h: pool.submit(fit_boosted, df, features, c, **kw) for h, c in labels.items()}
        return {h: j.result() for h, j in jobs.items()}


def fit_forest(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 20, depth: int = 6, weight: str | None = None,
               seed: int = 42) -> PipelineModel:
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    rf = rf.setWeightCol(weight) if weight else rf
    return Pipeline(stages=[*_front(features), rf]).fit(_usable(df, features).where(C(label).isNotNull()))


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> PipelineModel:
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha, elasticNetParam=0.0, solver="normal")
    return Pipeline(stages=[*_front(features), lr]).fit(_usable(df, features).where(C(label).isNotNull()))


def stack(valid: DataFrame, test: DataFrame, preds: Sequence[str], label: str, out: str = "stacked") -> DataFrame:
    """Ridge meta-learner over base predictions, fitted on the validation rows."""
    return predict(fit_ridge(valid, preds, label), test, preds, out)


def fit_regimes(df: DataFrame, features: Sequence[str], label: str, regime: str, names: Sequence[str], min_rows: int,
                fit: Callable = fit_boosted, **kw) -> dict[str, PipelineModel]:
    """One model per regime with enough rows, and ``"*"`` for all rows as fallback."""
    sizes = {r[regime]: r["count"] for r in df.where(C(regime).isin(list(names))).groupBy(regime).count().collect()}
    models = {"*": fit(df, features, label, **kw)}
    for name in names:
        if sizes.get(name, 0) >= min_rows:
            models[name] = fit(df.where(C(regime) == name), features, label, **kw)
    return models


def predict_regimes(models: dict[str, PipelineModel], df: DataFrame, features: Sequence[str], regime: str, out: str,
                    now: str | None = None) -> DataFrame:
    """Every row is scored by the model of its regime, else by the fallback."""
    own = [n for n in models if n != "*"]
    rest = F.coalesce(~C(regime).isin(own), F.lit(True)) if own else F.lit(True)
    parts = [predict(models["*"], df.where(rest), features, out, now=now)]
    parts += [predict(models[n], df.where(C(regime) == n), features, out, now=now) for n in own]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Built-in importance per feature, largest first."""
    scores = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(features, scores, strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, f, float(s)) for i, (f, s) in enumerate(ranked)], "rank int, feature string, importance double")


def r2_on(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str) -> float:
    p = model.transform(_usable(df, features).where(C(label).isNotNull()))
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2").evaluate(p)


def _order_by_importance(model: PipelineModel, features: Sequence[str]) -> list[str]:
    scores = model.stages[-1].featureImportances.toArray().tolist()
    return [f for f, _ in sorted(zip(features, scores, strict=True), key=lambda x: (-x[1], x[0]))]


def topk_sweep(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, sizes: Sequence[int], epsilon: float = 0.001,
               **kw) -> DataFrame:
    """Validation score of the k most important features, and the smallest k within epsilon."""
    full = fit_boosted(train, features, label, **kw)
    ranked, base = _order_by_importance(full, features), r2_on(full, valid, features, label)
    rows = [(len(features), base)]
    for k in sizes:
        rows.append((k, r2_on(fit_boosted(train, ranked[:k], label, **kw), valid, ranked[:k], label)))
    best = min(k for k, s in rows if s >= base - epsilon)
    return train.sparkSession.createDataFrame([(k, float(s), k == best) for k, s in sorted(rows)], "k int, r2 double, chosen boolean")


def backward_elimination(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, *, epsilon: float = 0.001,
                         min_features: int = 1, state_path: str | None = None, **kw) -> DataFrame:
    """Drop the least important feature while the score stays within epsilon of the start.

    Each step is appended to a small table at ``state_path`` when given, so an
    interrupted search can be inspected and resumed by the caller.
    """
    spark, keep, rows = train.sparkSession, list(features), []
    model = fit_boosted(train, keep, label, **kw)
    base = r2_on(model, valid, keep, label)
    rows.append((0, len(keep), None, float(base), True))
    while len(keep) > min_features:
        victim = _order_by_importance(model, keep)[-1]
        trial = [f for f in keep if f != victim]
        model = fit_boosted(train, trial, label, **kw)
        score = r2_on(model, valid, trial, label)
        ok = score >= base - epsilon
        rows.append((len(rows), len(trial), victim, float(score), ok))
        if state_path:
            spark.createDataFrame([rows[-1]], "step int, n_features int, dropped string, r2 double, accepted boolean").write.mode("append").parquet(state_path)
        if not ok:
            break
        keep = trial
    return spark.createDataFrame(rows, "step int, n_features int, dropped string, r2 double, accepted boolean")


def greedy_search(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, *, tolerance: float = 0.0003,
                  min_features: int = 3, fit: Callable = fit_ridge, parallel: int = 4, **kw) -> DataFrame:
    """Try every single drop per step (concurrent jobs), take the best while it does not hurt.

    Ends on the score, or with ``min_features`` left."""
    def score(names):
        return r2_on(fit(train, names, label, **kw), valid, names, label)
    keep, rows = list(features), []
    best = score(keep)
    rows.append((0, len(keep), None, float(best)))
    while len(keep) > min_features:
        with ThreadPoolExecutor(parallel) as pool:
            scores = list(pool.map(lambda f: score([x for x in keep if x != f]), keep))
        top = max(range(len(keep)), key=lambda i: (scores[i], -i))
        if scores[top] < best - tolerance:
            break
        dropped, best = keep[top], max(best, scores[top])
        keep = [f for f in keep if f != dropped]
        rows.append((len(rows), len(keep), dropped, float(scores[top])))
    return train.sparkSession.createDataFrame(rows, "step int, n_features int, dropped string, r2 double")


def random_search(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, space: dict[str, Sequence], trials: int,
                  seed: int = 42, parallel: int = 4, **kw) -> DataFrame:
    """Random parameter draws scored on the validation rows."""
    rng = random.Random(seed)
    draws = [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(trials)]
    def run(p):
        return r2_on(fit_boosted(train, features, label, **{**kw, **p}), valid, features, label)
    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(run, draws))
    rows = [(i, json.dumps(d, sort_keys=True), float(s)) for i, (d, s) in enumerate(zip(draws, scores, strict=True))]
    return train.sparkSession.createDataFrame(rows, "trial int, params string, r2 double")


def pca_curve(df: DataFrame, features: Sequence[str], k: int | None = None) -> DataFrame:
    """Explained and cumulative variance of the standardised features."""
    pipe = Pipeline(stages=[*_front(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            PCA(k=k or len(features), inputCol="scaled", outputCol="pcs")])
    share = pipe.fit(_usable(df, features)).stages[-1].explainedVariance.toArray().tolist()
    cum, rows = 0.0, []
    for i, s in enumerate(share, 1):
        cum += s
        rows.append((i, float(s), float(cum)))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def components_needed(curve: DataFrame, levels: Sequence[float] = (0.90, 0.95, 0.975, 0.99)) -> DataFrame:
    """First component count reaching each share (an exact 1.0 may fall short by rounding)."""
    c = curve.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return c.where(C("cumulative") >= C("share") - 1e-9).groupBy("share").agg(F.min("component").alias("components"))


def fit_pca_ridge(df: DataFrame, features: Sequence[str], label: str, k: int, alpha: float = 1.0) -> PipelineModel:
    """Scaling, PCA and regression fitted together on one fold's training rows."""
    return Pipeline(stages=[*_front(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            PCA(k=k, inputCol="scaled", outputCol="pcs"),
                            LinearRegression(featuresCol="pcs", labelCol=label, regParam=alpha, elasticNetParam=0.0, solver="normal")]
                    ).fit(_usable(df, features).where(C(label).isNotNull()))


def save_model(spark, model: PipelineModel, path: str, meta: dict) -> None:
    """Model and one metadata row next to it."""
    model.write().overwrite().save(f"{path}/model")
    row = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    return PipelineModel.load(f"{path}/model"), meta
