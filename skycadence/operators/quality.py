"""Audits: runs, sentinels, closure, volatility, cross-correlation, contradictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycadence.functions.exprs import floor_bucket
from skycadence.functions.timeline import DAY
from skycadence.operators.chunks import KEYS, carry_last
from skycadence.operators.ranks import exact_quantiles


def run_lengths(df: DataFrame, col: str, *, order: Sequence[str] = ("ts",), width_s: int = 7 * DAY,
                keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Maximal runs of equal consecutive values: ``keys, run_start.., value, n``.

    A row starts a run when its value differs from the previous row's, or either
    is NULL. The start position is carried forward, so a run may be of any length
    and is counted with map-side combine.
    """
    d = df.select(*keys, *order, col)
    d = carry_last(d, {"_prev": F.struct(F.col(col).alias("v"))}, width_s=width_s, order=order, keys=keys,
                   ts=ts, include_current=False)
    same = F.coalesce(F.col("_prev.v") == F.col(col), F.lit(False))
    d = d.withColumn("_new", ~same).drop("_prev")
    d = carry_last(d, {"_start": F.when(F.col("_new"), F.struct(*order))}, width_s=width_s, order=order,
                   keys=keys, ts=ts)
    return d.groupBy(*keys, "_start").agg(F.max(col).alias("value"), F.count(F.lit(1)).alias("n"))


def closure_error(ghi="ghi", dhi="dhi", dni="dni", elev="elev", floor: float = 20.0) -> Column:
    """Relative mismatch between the global value and its components."""
    g = F.col(ghi)
    return F.abs(F.col(dhi) + F.col(dni) * F.sin(F.radians(F.col(elev))) - g) / F.greatest(g, F.lit(floor))


def closure_report(day: DataFrame, limit: float = 0.15, by: Sequence[str] = KEYS) -> DataFrame:
    e = closure_error()
    return (day.select(*by, e.alias("_e")).where(F.col("_e").isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_checked"),
                 (F.lit(100.0) * F.avg((F.col("_e") > limit).cast("double"))).alias("violation_pct")))


def sentinel_report(df: DataFrame, cols: Sequence[str], codes: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Non-NULL and sentinel counts per column, from one pass."""
    one = df.groupBy(*by).agg(*[F.struct(F.count(c).alias("n"), F.count_if(F.col(c).isin(list(codes))).alias("k")).alias(c)
                                for c in cols])
    long = one.unpivot(list(by), list(cols), "column", "_s")
    return long.select(*by, "column", F.col("_s.n").alias("n_nonnull"), F.col("_s.k").alias("sentinel_n"),
                       (F.lit(100.0) * F.col("_s.k") / F.greatest(F.col("_s.n"), F.lit(1))).alias("sentinel_pct"))


def stuck_report(df: DataFrame, cols: Sequence[str], min_run: int = 6, *, keys: Sequence[str] = KEYS, ts: str = "ts",
                 width_s: int = 7 * DAY) -> DataFrame:
    """Rows inside runs of at least ``min_run`` equal, non-zero values.

    Give it daytime rows only, so that valid zeros at night do not count.
    """
    long = df.select(*keys, ts, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_c"))
    long = long.select(*keys, ts, "_c.column", "_c.x")
    runs = run_lengths(long, "x", keys=[*keys, "column"], ts=ts, order=(ts,), width_s=width_s)
    hit = (F.col("n") >= min_run) & F.col("value").isNotNull() & (F.col("value") != 0)
    return runs.groupBy(*keys, "column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_nonnull"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("stuck_n"))


def volatility_report(df: DataFrame, target: str, feature: str, *, keys: Sequence[str] = KEYS, ts: str = "ts",
                      width_s: int = 7 * DAY) -> DataFrame:
    """mean |step| / std of a target and a feature, and their ratio."""
    d = carry_last(df.select(*keys, ts, target, feature),
                   {"_p": F.struct(F.col(target).alias("t"), F.col(feature).alias("f"))}, width_s=width_s,
                   order=(ts,), keys=keys, ts=ts, include_current=False)
    vt = F.avg(F.abs(F.col(target) - F.col("_p.t"))) / F.stddev_samp(target)
    vf = F.avg(F.abs(F.col(feature) - F.col("_p.f"))) / F.stddev_samp(feature)
    return d.groupBy(*keys).agg(vt.alias("vol_target"), vf.alias("vol_feature"), (vt / vf).alias("vol_ratio"))


def lagged_correlation(shifted: DataFrame, x: str, lag_cols: dict[int, str], *, keys: Sequence[str] = KEYS,
                       min_pairs: int = 50) -> DataFrame:
    """corr(x_t, y_{t+lag}) per lag from columns that already hold the shifted y."""
    ok = {m: F.col(x).isNotNull() & F.col(c).isNotNull() for m, c in lag_cols.items()}
    agg = shifted.groupBy(*keys).agg(*[F.struct(
        F.lit(m).alias("lag_min"), F.count_if(ok[m]).alias("pairs"),
        F.corr(F.when(ok[m], F.col(x)), F.when(ok[m], F.col(c))).alias("r")).alias(f"_{i}")
        for i, (m, c) in enumerate(lag_cols.items())])
    long = agg.select(*keys, F.explode(F.array(*[f"_{i}" for i in range(len(lag_cols))])).alias("_s")).select(*keys, "_s.*")
    return long.withColumn("r", F.when(F.col("pairs") > min_pairs, F.col("r")))


def peak_lag(corr: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lag with the largest |r|; the smallest lag wins ties."""
    at = F.struct(F.abs("r"), -F.col("lag_min"))
    return corr.where(F.col("r").isNotNull()).groupBy(*keys).agg(F.max_by("lag_min", at).alias("peak_lag"), F.max_by("r", at).alias("peak_r"))


def contradiction_report(day: DataFrame, cot: str = "cot", kt: str = "kt", *, high_kt: float = 0.7, low_kt: float = 0.3,
                         by: Sequence[str] = KEYS) -> DataFrame:
    """Thick cloud with a bright sky, or thin cloud with a dark one."""
    q = exact_quantiles(day, cot, by, {"p25": 0.25, "p75": 0.75})
    d = day.where(F.col(cot).isNotNull() & F.col(kt).isNotNull()).select(*by, cot, kt).join(q, list(by))
    odd = ((F.col(cot) > F.col("p75")) & (F.col(kt) > high_kt)) | ((F.col(cot) < F.col("p25")) & (F.col(kt) < low_kt))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(odd).alias("n_contradiction"),
                              (F.lit(100.0) * F.avg(odd.cast("double"))).alias("contradiction_pct"),
                              F.max("p25").alias("p25"), F.max("p75").alias("p75"))


def two_product_report(a: DataFrame, b: DataFrame, cloudy: str, clear: str, kt: str, *, keys: Sequence[str] = ("site", "ts"),
                       by: Sequence[str] = KEYS, high_kt: float = 0.7) -> DataFrame:
    """Disagreement between a cloud flag and another product's clear-sky flag."""
    m = a.join(b, list(keys)).where(F.col(cloudy).isNotNull() & F.col(clear).isNotNull())
    c, s = F.col(cloudy).cast("boolean"), F.col(clear).cast("boolean")
    total = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"))
    hits = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n_checked"), (F.lit(100.0) * F.avg((c == s).cast("double"))).alias("disagreement_pct"),
                              F.count_if(c & s & (F.col(kt) > high_kt)).alias("n_false"))
    return hits.join(total, list(by)).select(*by, "n_checked", "disagreement_pct",
                                             (F.lit(100.0) * F.col("n_false") / F.col("n_all")).alias("false_positive_pct"))


def repair_diffuse(df: DataFrame, elev: str, *, keys: Sequence[str] = KEYS, ts: str = "ts", ghi: str = "ghi",
                   dhi: str = "dhi") -> DataFrame:
    """Replace impossible diffuse values by climatology times the global value.

    The climatology is the median diffuse fraction of clean rows per month and 10
    degree elevation bucket, falling back to the series median.
    """
    g, d = F.col(ghi), F.col(dhi)
    bad = (d > g) & (g > 0)
    work = df.select("*", F.month(ts).alias("_mon"), floor_bucket(elev, 10).alias("_alt"), F.coalesce(bad, F.lit(False)).alias("_bad"),
                     F.when(g > 0, d / g).alias("_kd"))
    clean = work.where(~F.col("_bad") & (g > 0) & (F.col(elev) > 5))
    cells = exact_quantiles(clean, "_kd", [*keys, "_mon", "_alt"], {"_cell": 0.5})
    overall = exact_quantiles(clean, "_kd", keys, {"_all": 0.5})
    w = work.join(cells, [*keys, "_mon", "_alt"], "left").join(overall, list(keys), "left")
    zero = F.coalesce((g == 0) & (d > 0), F.lit(False))
    fixed = (F.when(F.col("_bad"), F.least(F.coalesce("_cell", "_all") * g, g)).when(zero, F.lit(0.0)).otherwise(d))
    return w.select(*[c for c in df.columns if c != dhi], d.alias(f"{dhi}_original"), fixed.alias(dhi),
                    (F.col("_bad") | zero).alias("corrected"))


def minute_probe(df: DataFrame, candidate: str, target: str, ts: str = "ts", by: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of a candidate with the target per minute of the hour: a value
    that knows the whole hour correlates best at the hour's start."""
    return df.groupBy(*by, F.minute(ts).alias("minute")).agg(F.corr(candidate, target).alias("r"), F.count(candidate).alias("n"))
