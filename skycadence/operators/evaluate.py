"""Scores, stratified evaluation, comparisons and compiled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycadence.functions.exprs import cut
from skycadence.functions.weather import oktas_class
from skycadence.operators.ranks import exact_quantiles

C = F.col


def to_long(df: DataFrame, preds: Sequence[str], keep: Sequence[str], name: str = "model", value: str = "pred") -> DataFrame:
    """Wide predictions to one row per model."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(p).alias(name), C(p).cast("double").alias(value)) for p in preds])).alias("_m")).select(*keep, f"_m.{name}", f"_m.{value}")


def score_columns(y: str = "y", p: str = "pred", base: str | None = None) -> list[Column]:
    """All scores of one model as combining aggregates (one pass, no self join)."""
    e, yc, pc = C(p) - C(y), C(y), C(p)
    n = F.count(F.lit(1))
    sst = F.var_pop(yc) * n
    mse = F.avg(e * e)
    out = [n.alias("n"), (F.lit(1.0) - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"),
           F.sqrt(mse).alias("rmse"), F.avg(e).alias("mbe"),
           (F.lit(100.0) * F.sqrt(mse) / (F.avg(yc) + F.lit(1e-6))).alias("nrmse_pct"),
           F.avg(F.when(yc > 50, F.lit(100.0) * F.abs(e / yc))).alias("mape_pct")]
    if base is not None:
        b = C(base) - yc
        base_mse = F.avg(b * b)
        r2b = F.lit(1.0) - F.sum(b * b) / F.nullif(sst, F.lit(0.0))
        r2 = F.lit(1.0) - F.sum(e * e) / F.nullif(sst, F.lit(0.0))
        out += [(F.lit(1.0) - F.sqrt(mse) / F.nullif(F.sqrt(base_mse), F.lit(0.0))).alias("skill_rmse"),
                (F.lit(1.0) - mse / F.nullif(base_mse, F.lit(0.0))).alias("skill_mse"),
                ((r2 - r2b) / F.nullif(F.lit(1.0) - r2b, F.lit(0.0))).alias("skill_r2")]
    return out


def metrics(df: DataFrame, y: str, preds: Sequence[str], *, base: str | None = None, by: Sequence[str] = (),
            min_n: int = 1) -> DataFrame:
    """Scores per model and group over the rows where target and prediction exist.

    ``base`` adds the three skill forms against a baseline on the same rows.
    Groups with fewer than ``min_n`` rows keep their count and lose their scores.
    """
    keep = [*by, C(y).cast("double").alias("_y"), *([C(base).cast("double").alias("_b")] if base else [])]
    wide = df.select(*keep, *[C(p).cast("double").alias(f"_p_{p}") for p in preds])
    names = [c for c in wide.columns if not c.startswith("_p_")]
    long = wide.select(*names, F.explode(F.array(*[
        F.struct(F.lit(p).alias("model"), C(f"_p_{p}").alias("pred")) for p in preds])).alias("_m")).select(*names, "_m.*")
    full = long.where(C("_y").isNotNull() & C("pred").isNotNull() & (C("_b").isNotNull() if base else F.lit(True)))
    out = full.groupBy(*by, "model").agg(*score_columns("_y", "pred", "_b" if base else None))
    if min_n > 1:
        out = out.select(*by, "model", "n", *[F.when(C("n") >= min_n, C(c)).alias(c)
                                               for c in out.columns if c not in (*by, "model", "n")])
    return out


def describe(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max per group."""
    basic = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("avg"), F.stddev_samp(col).alias("std"),
                                F.min(col).alias("low"), F.max(col).alias("high"))
    q = exact_quantiles(df, col, by, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(q, list(by), "left")


def interval_scores(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    inside = C(y).between(C(lo), C(hi))
    return df.where(C(y).isNotNull() & C(lo).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(C(hi) - C(lo)).alias("width"))


def cloud_regime(cot: str, cloud_present: str | None = None) -> Column:
    """clear < 1 <= partly < 8 <= overcast; the cloud flag only decides where COT is NULL."""
    c = C(cot)
    out = F.when(c < 1, "clear").when(c < 8, "partly").when(c >= 8, "overcast")
    return out.when(C(cloud_present) == 0, "clear").otherwise("partly") if cloud_present else out.otherwise("no_data")


def cot_class(cot: str) -> Column:
    return cut(cot, [float("-inf"), 5, 15, float("inf")], ["thin", "medium", "thick"], missing="no_data")


def sky_class(oktas: str) -> Column:
    return oktas_class(oktas)


def value_bin(y: str, edges=(0, 100, 300, 600, 900, 1200, 1500)) -> Column:
    return cut(y, list(edges), [f"{a}-{b}" for a, b in zip(edges[:-1], edges[1:], strict=True)])


def horizon_average(per_horizon: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return per_horizon.groupBy(*by).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def score_matrix(long: DataFrame, rows: str | Sequence[str], columns: str, levels: Sequence, value: str) -> DataFrame:
    """Model x horizon matrix with the row mean."""
    m = long.groupBy(*([rows] if isinstance(rows, str) else rows)).pivot(columns, list(levels)).agg(F.first(value))
    mean = sum([C(str(x)) for x in levels[1:]], C(str(levels[0]))) / F.lit(float(len(levels)))
    return m.withColumn("row_mean", mean)


def mean_and_std(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def ablation(scores: DataFrame, arm: str, base: str, other: str, value: str, by: Sequence[str],
             high: float = 0.015, medium: float = 0.005) -> DataFrame:
    """Difference between two arms with a relevance class."""
    p = scores.groupBy(*by).pivot(arm, [base, other]).agg(F.first(value))
    d = C(other) - C(base)
    return p.select(*by, C(base), C(other), d.alias("delta"),
                    F.when(F.abs(d) >= high, "HIGH").when(F.abs(d) >= medium, "MEDIUM").otherwise("NEGLIGIBLE").alias("relevance"))


def incremental_gain(scores: DataFrame, step: str, value: str, by: Sequence[str]) -> DataFrame:
    """Gain of each step over the previous one and over the first (a short result table)."""
    w = Window.partitionBy(*by).orderBy(step)
    return scores.select("*", (C(value) - F.lag(value).over(w)).alias("gain"),
                         (C(value) - F.first(value).over(w)).alias("gain_total"))


def seed_summary(scores: DataFrame, value: str, by: Sequence[str], rank_within: Sequence[str] = ()) -> DataFrame:
    """Mean, spread (sample and population) over seeds, ranked by mean."""
    g = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg(value).alias("avg"),
                                F.stddev_samp(value).alias("std"), F.stddev_pop(value).alias("std_pop"))
    w = Window.partitionBy(*rank_within).orderBy(F.desc("avg"), *by)
    return g.withColumn("rank", F.row_number().over(w))


def blend_grid(df: DataFrame, y: str, a: str, b: str, weights: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Score of ``w a + (1 - w) b`` for every weight, in one aggregate over sums.

    The squared error is a quadratic in w, so three sums per group serve all
    weights and the data are not multiplied by the grid.
    """
    ea, eb = C(a) - C(y), C(b) - C(y)
    s = df.where(C(y).isNotNull() & C(a).isNotNull() & C(b).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ea * ea).alias("_aa"), F.avg(ea * eb).alias("_ab"), F.avg(eb * eb).alias("_bb"))
    g = s.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights])))
    w, v = C("weight"), F.lit(1.0) - C("weight")
    mse = w * w * C("_aa") + F.lit(2.0) * w * v * C("_ab") + v * v * C("_bb")
    return g.select(*by, "weight", "n", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))


def distribution(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    base = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("avg"), F.stddev_samp(col).alias("std"), F.max(col).alias("high"))
    return base.join(exact_quantiles(df, col, by, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), list(by), "left")
