"""Forecast anchors, targets, segments and chronological splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from skycadence.functions.exprs import clip, flag, inside, strict_mean
from skycadence.functions.timeline import DAY, before, day_start, on_or_after, seconds_between, shift
from skycadence.operators.chunks import KEYS, carry_last, ordinal, running_total
from skycadence.operators.ranks import first_n
from skycadence.operators.windows import lead, valid_within
from skycadence.spec import MIN_ELEVATION, STEP_S, VALID_MAX, VALID_MIN


@dataclass(frozen=True)
class AnchorRule:
    """What makes a grid row a usable forecast issue time.

    ``present`` names the column that is NULL on empty slots. ``strict_history``
    asks for in-range values on all history rows, not just their presence.
    """

    back: int = 18
    ahead: int = 6
    check_future: bool = True
    min_elev: float | None = MIN_ELEVATION
    elev_at_target: bool = True
    lo: float = VALID_MIN
    hi: float = VALID_MAX
    target_in_range: bool = True
    strict_history: bool = False
    present: str = "n"
    value: str = "ghi"


PROTOCOL = AnchorRule()


def is_anchor(rule: AnchorRule, w: WindowSpec, elev_at: Callable[[int], Column], step_s: int = STEP_S) -> Column:
    """The rule as one boolean column over a gap-free grid window."""
    there = F.col(rule.present).isNotNull()
    ok = valid_within(there, rule.back, 0, w) == rule.back + 1
    if rule.strict_history:
        ok = ok & (valid_within(inside(rule.value, rule.lo, rule.hi), rule.back, 0, w) == rule.back + 1)
    if rule.check_future:
        ok = ok & (valid_within(there, -1, rule.ahead, w) == rule.ahead)
    ok = ok & inside(rule.value, rule.lo, rule.hi)
    if rule.target_in_range:
        ok = ok & inside(lead(rule.value, rule.ahead, w), rule.lo, rule.hi)
    if rule.min_elev is not None:
        ok = ok & (elev_at(0) > F.lit(rule.min_elev))
        if rule.elev_at_target:
            ok = ok & (elev_at(rule.ahead * step_s) > F.lit(rule.min_elev))
    return F.coalesce(ok, F.lit(False))


def is_trusted(source: str, trusted: Sequence[str], there: Column, w: WindowSpec, elev_at: Callable[[int], Column], *,
               min_elev: float = 10.0, back: int = 18, ahead: int = 6, step_s: int = STEP_S) -> Column:
    """Anchor and target come from a trusted sensor, all slots from ``back`` to ``ahead`` are there, and the sun is up at both ends."""
    ok = F.col(source).isin(list(trusted)) & lead(source, ahead, w).isin(list(trusted))
    ok = ok & (valid_within(there, back, ahead, w) == back + ahead + 1)
    ok = ok & (elev_at(0) >= F.lit(min_elev)) & (elev_at(ahead * step_s) >= F.lit(min_elev))
    return F.coalesce(ok, F.lit(False))


def not_imputed(tier: str, imputed: Sequence[int]) -> Column:
    """The value is known and was not filled in by a model."""
    return F.coalesce(~F.col(tier).isin(list(imputed)), F.lit(False))


def strict_quality(tier: str, quality: str, tiers: Sequence[int] = (0, 1), floor: float = 0.9) -> Column:
    return F.coalesce(F.col(tier).isin(list(tiers)) & (F.col(quality) >= floor), F.lit(False))


def target_columns(value: str, w: WindowSpec, horizons: Sequence[int] = range(1, 7), lo: float = VALID_MIN,
                   hi: float = VALID_MAX) -> list[Column]:
    """Point targets per horizon, the mean target and their residual forms."""
    steps = [lead(value, h, w) for h in horizons]
    mean = strict_mean(steps, lo, hi)
    return [*[s.alias(f"y_{h}") for h, s in zip(horizons, steps, strict=True)], mean.alias("y_mean"),
            (steps[-1] - F.col(value)).alias("d_point"), (mean - F.col(value)).alias("d_mean")]


def from_residual(now, delta, lo: float = VALID_MIN, hi: float = VALID_MAX) -> Column:
    return clip(F.col(now) + F.col(delta), lo, hi)


def next_window_mean(mean: str, count: str, w: WindowSpec, hours: int = 1, min_n: int = 1) -> Column:
    """Mean over the next ``hours`` grid rows; NULL unless each is present and thick enough."""
    parts = [F.when(lead(count, h, w) >= min_n, lead(mean, h, w)) for h in range(1, hours + 1)]
    return strict_mean(parts)


def reconcile(counts: DataFrame, expected: DataFrame, by: Sequence[str], tolerance_pct: float = 1.0) -> DataFrame:
    """Recounted anchors against published counts."""
    e = expected.select(*by, F.col("n").alias("n_expected"))
    c = counts.select(*by, F.col("n").alias("n_found")).join(e, list(by), "full")
    found, want = F.coalesce("n_found", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    dev = F.when(want > 0, F.lit(100.0) * (found - want) / want)
    return c.select(*by, found.alias("n_found"), want.alias("n_expected"), dev.alias("deviation_pct"),
                    F.when(F.abs(dev) <= tolerance_pct, "match").otherwise("differs").alias("verdict"))


def segments(df: DataFrame, max_gap_s: float, *, split_on_date: bool = True, width_s: int = 7 * DAY,
             keys: Sequence[str] = KEYS, ts: str = "ts", order: Sequence[str] = ("ts",), name: str = "seg") -> DataFrame:
    """Number unbroken stretches; a break is a long gap or a new calendar day."""
    d = carry_last(df, {"_prev": F.col(ts)}, width_s=width_s, order=order, keys=keys, ts=ts, include_current=False)
    brk = seconds_between(ts, "_prev") > F.lit(float(max_gap_s))
    if split_on_date:
        brk = brk | (day_start(ts) != day_start("_prev"))
    d = d.withColumn("_brk", F.when(F.col("_prev").isNotNull() & brk, 1).otherwise(0)).drop("_prev")
    return running_total(d, {name: F.col("_brk")}, width_s=width_s, order=order, keys=keys, ts=ts).drop("_brk")


def split_by_dates(ts: str, train_end: str, valid_end: str) -> Column:
    return (F.when(before(ts, train_end), "train").when(before(ts, valid_end), "valid").otherwise("test"))


def split_by_years(ts: str, train: Sequence[int], valid: Sequence[int], test: Sequence[int]) -> Column:
    y = F.year(ts)
    return (F.when(y.isin(list(train)), "train").when(y.isin(list(valid)), "valid")
            .when(y.isin(list(test)), "test"))


def split_by_fraction(df: DataFrame, train: float, valid: float, *, order: Sequence[str] = ("ts",),
                      width_s: int = 30 * DAY, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Chronological fractions by row count, cut positions truncated to integers; a row without key or time has no part."""
    d = ordinal(df, width_s=width_s, order=order, keys=keys, ts=ts, name="_i", total="_n")
    first = F.floor(F.col("_n") * F.lit(train))
    second = F.floor(F.col("_n") * F.lit(train + valid))
    role = F.when(F.col("_i") <= first, "train").when(F.col("_i") <= second, "valid").when(F.col("_i") > second, "test")
    return d.withColumn("split", role).drop("_i", "_n")


def folds_by_date(df: DataFrame, folds: Sequence[tuple[str, str | None]], *, es_months: int = 3,
                  ts: str = "ts") -> DataFrame:
    """Expanding walk-forward: each row once per fold it takes part in, with its role.

    ``train`` up to the early-stopping cut, ``stop`` for the last months before the
    test period, ``test`` inside it. A last fold without an end is open.
    """
    entries = []
    for i, (start, end) in enumerate(folds, 1):
        at = F.expr(f"timestamp_ntz'{start} 00:00:00'")
        cut = F.expr(f"timestamp_ntz'{start} 00:00:00' - make_ym_interval(0, {es_months})")
        role = F.when(F.col(ts) < cut, "train").when(F.col(ts) < at, "stop")
        role = role.when(before(ts, end), "test") if end else role.otherwise("test")
        entries.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    both = F.filter(F.array(*entries), lambda e: e["role"].isNotNull())
    return df.withColumn("_f", F.explode(both)).select(*df.columns, "_f.fold", "_f.role")


def usable_folds(df: DataFrame, min_train: int, min_test: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fold sizes, and whether the fold is large enough to be fitted."""
    n = df.groupBy(*keys, "fold").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "stop", "test")])
    return n.withColumn("usable", (F.col("n_train") + F.col("n_stop") >= min_train) & (F.col("n_test") >= min_test))


def folds_by_count(df: DataFrame, k: int, *, order: Sequence[str] = ("ts",), width_s: int = 30 * DAY,
                   keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Expanding folds of ``n // (k + 1)`` rows by position."""
    d = ordinal(df, width_s=width_s, order=order, keys=keys, ts=ts, name="_i", total="_n")
    size = F.call_function("div", F.col("_n"), F.lit(k + 1))
    entries = [F.struct(F.lit(f).alias("fold"), F.when(F.col("_i") <= size * f, "train")
                        .when(F.col("_i") <= F.least(size * (f + 1), F.col("_n")), "test").alias("role"))
               for f in range(1, k + 1)]
    both = F.filter(F.array(*entries), lambda e: e["role"].isNotNull())
    return d.withColumn("_f", F.explode(both)).select(*df.columns, "_f.fold", "_f.role")


def scrambled(key, seed: int = 0) -> Column:
    """Reproducible pseudo-random integer in [0, 2^32) of a key of up to 63 bits, one-to-one on keys below 2^32.

    The key's halves are multiplied in 16-bit steps, so that no product leaves 64 bits."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    low, high = F.pmod(k, F.lit(1 << 32)), F.shiftright(k, 32)
    upper = F.pmod(F.shiftright(low, 16) * F.lit(2654435761), F.lit(1 << 16)) * F.lit(1 << 16)
    lower = low.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(2654435761)
    return F.pmod(upper + lower + F.pmod(high, F.lit(1 << 31)) * F.lit(2246822519) + F.lit(seed * 40503), F.lit(1 << 32))


def random_split(key, fraction: float, seed: int = 0) -> Column:
    return F.when(scrambled(key, seed) < F.lit(int(fraction * 4294967296)), "train").otherwise("test")


def random_subset(df: DataFrame, key: str, fraction: float, keys: Sequence[str] = KEYS, seed: int = 0) -> DataFrame:
    """Exactly ``int(n * fraction)`` rows per series, chosen by scrambled key."""
    return first_n(df, scrambled(key, seed), F.floor(F.col("_n") * F.lit(fraction)), keys, tie=(key,))


def recent_subset(df: DataFrame, fraction: float, *, order: Sequence[str] = ("ts",), width_s: int = 30 * DAY,
                  keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    d = ordinal(df, width_s=width_s, order=order, keys=keys, ts=ts, name="_i", total="_n")
    return d.where(F.col("_i") > F.col("_n") - F.floor(F.col("_n") * F.lit(fraction))).drop("_i", "_n")
