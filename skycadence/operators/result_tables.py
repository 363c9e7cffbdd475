"""The published result tables, compiled from score tables of any number of sites: test scores, walk-forward summary,
value of a feature set, seeds by model, and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def test_table(scores: DataFrame, metrics: Sequence[str] = ("r2", "mae", "rmse", "skill_rmse")) -> DataFrame:
    """Table 2a: one row per target, site and model, in that order."""
    return scores.select("target", "site", "model", "n", *metrics).orderBy("target", "site", "model")


def summary_table(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """Table 2b: (by..., metric, n_folds, mean, std) over folds; folds without a score do not count."""
    long = folds.unpivot(list(by), list(metrics), "metric", "value").where(C("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*by, "metric").agg(F.count("value").alias("n_folds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def feature_value_table(scores: DataFrame, small: str, large: str, by: Sequence[str] = ("site", "target"), *, high: float = 0.010,
                        medium: float = 0.005) -> DataFrame:
    """Table 2a, second form: what the larger feature set adds to R2, classed high above ``high``, medium above ``medium``."""
    p = scores.groupBy(*by).agg(*[F.max(F.when(C("features") == name, C("r2"))).alias(f"r2_{name}") for name in (small, large)])
    gain = C(f"r2_{large}") - C(f"r2_{small}")
    return p.where(gain.isNotNull()).select("*", gain.alias("delta_r2"), F.when(gain > high, "high").when(gain > medium, "medium").otherwise("low").alias("value"))


def seed_table(runs: DataFrame, metrics: Sequence[str], *, single: Sequence[str] = (), by: Sequence[str] = ("site",)) -> DataFrame:
    """Table 2c: mean and spread over seeds per model; models named in ``single`` are not random and count with seed 0 only."""
    used = runs.where(~C("model").isin(list(single)) | (C("seed") == 0)) if single else runs
    return used.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n_seeds"), *[f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))])


def pruning_table(steps: DataFrame, features: Sequence[str], by: Sequence[str] = ("site",), top: int = 5) -> DataFrame:
    """Table 2d: how many features a search kept, and the first of them, in the order of ``features``.

    ``steps`` is the list of drops with their acceptance, as the searches give it."""
    gone = steps.where(C("accepted") & C("dropped").isNotNull())
    g = steps.select(*by).distinct().join(gone.groupBy(*by).agg(F.collect_set("dropped").alias("_gone")), list(by), "left")
    kept = F.array_except(F.array(*[F.lit(f) for f in features]), F.coalesce("_gone", F.array().cast("array<string>")))
    n = F.size(kept)
    return g.select(*by, n.alias("n_kept"), F.lit(len(features)).alias("n_total"), (F.lit(100.0) * (1 - n / len(features))).alias("reduction_pct"),
                    F.array_join(F.slice(kept, 1, top), ", ").alias("top_features"))
