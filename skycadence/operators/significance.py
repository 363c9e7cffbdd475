"""Paired moving-block bootstrap, pair tests and rolling conformal calibration."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycadence.functions.timeline import DAY, US, micros, month_start
from skycadence.operators.anchors import recent_subset
from skycadence.operators.chunks import KEYS, ordinal
from skycadence.operators.ranks import exact_quantiles, quantile_at
from skycadence.session import parallelism
from skycadence.sources.sinks import materialize

C = F.col


def draw(b: Column, k: Column, seed: int, choices: Column) -> Column:
    """Reproducible start in [0, choices) for block ``k`` of resample ``b``: 60 bits of a hash, for any number of rows."""
    text = F.concat_ws(":", b.cast("string"), k.cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), choices)


POSITIONS = 100_000  # starts of one task of the block sums


def block_sums(clean: DataFrame, sums: dict[str, Column], sizes: DataFrame, *, block: int, order: Sequence[str], keys: Sequence[str], ts: str,
               width_s: int) -> DataFrame:
    """(keys, start, last, sums...): for each start of a block, from 0, the sums over its rows, in full and cut short as the last one.

    Rows are numbered, dealt by number and copied into the task before, a block's length far; sums run inside a task only,
    so no difference of sums over a whole series is taken."""
    rows = ordinal(clean.select(*keys, ts, *[c for c in order if c not in (*keys, ts)], *[e.alias(n) for n, e in sums.items()]),
                   width_s=width_s, order=order, keys=keys, ts=ts, name="pos").where(C("pos").isNotNull()).withColumn("pos", C("pos") - 1)
    home = F.call_function("div", C("pos"), F.lit(POSITIONS))
    first = F.greatest(F.lit(0).cast("long"), F.call_function("div", C("pos") - F.lit(block - 1), F.lit(POSITIONS)))
    rows = rows.select(*keys, "pos", *sums, home.alias("_home"), F.explode(F.sequence(first, home)).alias("_part"))
    upto = Window.partitionBy(*keys, "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "_part", "_home", "pos", *sums, *[F.sum(n).over(upto).alias(f"_to_{n}") for n in sums])
    starts = rows.where(C("_home") == C("_part")).join(sizes.select(*keys, "_n", "_blk", "_nb"), list(keys))
    starts = starts.where(C("pos") <= C("_n") - C("_blk"))
    lengths = F.array(F.struct(F.lit(False).alias("last"), C("_blk").alias("len")), F.struct(F.lit(True).alias("last"), (C("_n") - (C("_nb") - 1) * C("_blk")).alias("len")))
    starts = starts.select(*keys, "_part", C("pos").alias("start"), F.explode(lengths).alias("_l"), *[(C(f"_to_{n}") - C(n)).alias(f"_before_{n}") for n in sums])
    starts = starts.select("*", "_l.last", (C("start") + C("_l.len") - 1).alias("pos"))
    ends = rows.select(*keys, "_part", "pos", *[C(f"_to_{n}") for n in sums])
    return starts.join(ends, [*keys, "_part", "pos"]).select(*keys, "start", "last", *[(C(f"_to_{n}") - C(f"_before_{n}")).alias(n) for n in sums])


def block_bootstrap(df: DataFrame, y: str, preds: Sequence[str], *, resamples: int = 5000, block: int = 78, seed: int = 42,
                    order: Sequence[str] = ("ts",), keys: Sequence[str] = KEYS, ts: str = "ts", width_s: int = 30 * DAY) -> DataFrame:
    """R2 of every model on every resample: ``keys, b, r2_<model>...``.

    A resample is a list of blocks. The sums of every possible block are taken once per start; a drawn block is one
    narrow row (series, resample, start) that meets them and is summed with map-side combine: resampled rows are never
    formed, and a long series spreads over its starts. The target is centred per series first, so that the squared
    deviations of a resample do not cancel. Rows without target, key or time take no part.
    """
    # The dump of targets and predictions is read three times below.
    clean = materialize(df.where(C(y).isNotNull() & C(ts).isNotNull()).select(*keys, *order, y, *preds), "predictions")
    size = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean"))
    size = size.withColumn("_blk", F.least(F.lit(block).cast("long"), C("_n")))
    size = size.withColumn("_nb", F.call_function("div", C("_n") + C("_blk") - 1, C("_blk")))
    gap = C(y) - C("_mean")
    sums = {"s_y": gap, "s_yy": gap * gap, **{f"s_{p}": (C(y) - C(p)) * (C(y) - C(p)) for p in preds}}
    table = block_sums(clean.join(size.select(*keys, "_mean"), list(keys)), sums, size, block=block, order=order, keys=keys, ts=ts, width_s=width_s)

    runs = size.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b"))
    runs = runs.repartition(parallelism(df.sparkSession), *keys, "b")
    blocks = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("_nb") - 1)).alias("_k"))
    drawn = blocks.select(*keys, "b", draw(C("b"), C("_k"), seed, C("_n") - C("_blk") + 1).alias("start"), (C("_k") == C("_nb") - 1).alias("last"))
    total = drawn.join(table, [*keys, "start", "last"]).groupBy(*keys, "b").agg(*[F.sum(s).alias(s) for s in sums])
    total = total.join(size.select(*keys, "_n"), list(keys))
    sst = C("s_yy") - C("s_y") * C("s_y") / C("_n")
    return total.select(*keys, "b", *[(F.lit(1.0) - C(f"s_{p}") / F.nullif(sst, F.lit(0.0))).alias(f"r2_{p}") for p in preds])


def pair_tests(boot: DataFrame, preds: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """CI of the R2 difference per pair, two-sided p, and whether 0 is outside."""
    pairs = [(a, b) for a, b in combinations(preds, 2)]
    long = boot.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("pair"), (C(f"r2_{a}") - C(f"r2_{b}")).alias("d")) for a, b in pairs])).alias("_p"))
    long = long.select(*keys, "_p.pair", "_p.d")
    ci = exact_quantiles(long, "d", [*keys, "pair"], {"ci_lo": 0.025, "ci_hi": 0.975})
    share = long.groupBy(*keys, "pair").agg(F.avg((C("d") > 0).cast("double")).alias("_f"))
    p = F.lit(2.0) * F.least(C("_f"), F.lit(1.0) - C("_f"))
    return ci.join(share, [*keys, "pair"]).select(*keys, "pair", "ci_lo", "ci_hi", p.alias("p"),
                                                  ((C("ci_lo") > 0) | (C("ci_hi") < 0)).alias("significant"))


def spread_test(boot: DataFrame, preds: Sequence[str], limit: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distribution of best minus worst R2 over the resamples."""
    cols = [C(f"r2_{p}") for p in preds]
    s = boot.select(*keys, (F.greatest(*cols) - F.least(*cols)).alias("spread"))
    q = exact_quantiles(s, "spread", keys, {"lo": 0.025, "median": 0.5, "hi": 0.975})
    small = s.groupBy(*keys).agg(F.avg((C("spread") <= limit).cast("double")).alias("p_small"))
    return q.join(small, list(keys))


def holm(pairs: DataFrame, alpha: float = 0.05, keys: Sequence[str] = KEYS, step_down: bool = True) -> DataFrame:
    """Holm's correction over the pairs of a series (a handful of rows).

    ``step_down=False`` marks every pair that passes its own threshold, without
    stopping at the first failure.
    """
    per = Window.partitionBy(*keys)
    w = per.orderBy("p", "pair")
    r = pairs.withColumn("_rank", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(per))
    ok = C("p") <= F.lit(alpha) / (C("_m") - C("_rank") + 1)
    r = r.withColumn("_ok", ok.cast("int"))
    hit = F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) if step_down else C("_ok")
    return r.select(*pairs.columns, hit.alias("holm_pass"))


def conformal_level(n: Column, alpha: float) -> Column:
    return F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)) / n, F.lit(1.0))


def rolling_corrections(df: DataFrame, y: str, lo: str, hi: str, *, days: int = 60, alpha: float = 0.2, min_n: int = 30,
                        keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Conformal correction per (series, month) from the scores of earlier months.

    A month uses scores no older than ``days`` before its first row. Each score can
    serve only the few following months, so it is sent to those and filtered; the
    quantile level depends on the number of scores found. Months with fewer than
    ``min_n`` scores keep the previous correction; the first has 0.
    """
    # Scores feed the month list and both halves of the quantile: written once.
    d = materialize(df.where(C(y).isNotNull() & C(lo).isNotNull()).select(
        *keys, ts, F.greatest(C(lo) - C(y), C(y) - C(hi)).alias("_score"), month_start(ts).alias("month")), "scores")
    months = d.groupBy(*keys, "month").agg(F.min(ts).alias("_first"))
    reach = days // 28 + 2
    # A month's first row is not before its start, so a score can only serve months that start within ``days`` of it.
    months_ahead = F.array(*[F.add_months("month", i).cast("timestamp_ntz") for i in range(1, reach + 1)])
    within = F.filter(months_ahead, lambda m: micros(ts) >= micros(m) - F.lit(days * DAY * US))
    sent = d.select(*keys, ts, "_score", F.explode(within).alias("month"))
    used = sent.join(months, [*keys, "month"]).where(micros(ts) >= micros("_first") - F.lit(days * DAY * US))
    q = quantile_at(used, "_score", [*keys, "month"], {"_q": lambda n: conformal_level(n, alpha)}, size="_n")
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    fresh = F.when(C("_n") >= min_n, C("_q"))
    return (months.join(q, [*keys, "month"], "left")
            .select(*keys, "month", F.coalesce("_n", F.lit(0)).alias("n_scores"),
                    F.coalesce(F.last(fresh, ignorenulls=True).over(w), F.lit(0.0)).alias("correction")))


def rolling_conformal(df: DataFrame, y: str, lo: str, hi: str, *, keys: Sequence[str] = KEYS, ts: str = "ts", **kw) -> DataFrame:
    """The intervals widened (or narrowed) by their month's correction."""
    c = rolling_corrections(df, y, lo, hi, keys=keys, ts=ts, **kw)
    j = df.withColumn("month", month_start(ts)).join(c.drop("n_scores"), [*keys, "month"], "left")
    return j.select(*df.columns, "correction", (C(lo) - C("correction")).alias(f"{lo}_adj"), (C(hi) + C("correction")).alias(f"{hi}_adj"))


def calibration_window(train: DataFrame, share: float = 0.2, days: int = 60, *, order: Sequence[str] = ("ts",), keys: Sequence[str] = KEYS,
                       ts: str = "ts", width_s: int = 30 * DAY) -> DataFrame:
    """The last ``share`` of each series' training rows, and of those the last ``days`` days."""
    late = recent_subset(train, share, order=order, width_s=width_s, keys=keys, ts=ts)
    ends = late.groupBy(*keys).agg(F.max(ts).alias("_end"))
    return late.join(ends, list(keys)).where(micros(ts) >= micros("_end") - F.lit(days * DAY * US)).drop("_end")


def static_correction(cal: DataFrame, y: str, lo: str, hi: str, *, alpha: float = 0.2, keys: Sequence[str] = KEYS) -> DataFrame:
    """One split-conformal correction per series from a calibration set."""
    s = cal.where(C(y).isNotNull()).select(*keys, F.greatest(C(lo) - C(y), C(y) - C(hi)).alias("_score"))
    return quantile_at(s, "_score", keys, {"correction": lambda n: conformal_level(n, alpha)}, size="n_scores")


def residual_bands(train: DataFrame, residual: str, by: Sequence[str], lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Empirical residual quantiles per stratum: the interval model used for bands."""
    return exact_quantiles(train, residual, by, {"q_lo": lo, "q_mid": 0.5, "q_hi": hi}, size="n_band")
