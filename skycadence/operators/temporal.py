"""Joins in time: as-of, nearest, interval, shifted and exact-offset lookups.

None of them is a range join. Observations are reduced to the slots they can
serve before the shuffle, or both sides are merged into one ordered stream per
(key, chunk), so no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycadence.functions.timeline import DAY, US, ceil_to, floor_div, from_micros, micros, seconds_between, shift
from skycadence.operators.chunks import CHUNK, HOME, KEYS, ROWS_PER_CHUNK, carry_last, carry_next, halo


def asof_join(left: DataFrame, right: DataFrame, cols: Sequence[str], *, tolerance_s: int | None = None,
              strict: bool = False, age: str | None = None, age_unit_s: float = 60.0,
              tiebreak: Sequence[str] = (), width_s: int = 7 * DAY, keys: Sequence[str] = KEYS,
              ts: str = "ts", rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Latest right row at or before each left row.

    Both sides are merged into one ordered stream in balanced chunks, and the last
    value of each chunk is carried over. With a tolerance and ``rows_per_chunk=None``
    the right rows are copied one chunk forward instead. ``strict`` makes the
    tolerance bound exclusive. Right rows sharing a key and time are reduced to
    one (greatest ``tiebreak``) first. A left row without key or time is kept and finds
    nothing; such a right row is never found.
    """
    at = F.struct(*(tiebreak or cols))
    right = right.where(_known(keys, ts))
    r = right.groupBy(*keys, ts).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), at).alias("_r"))
    r = r.select(*keys, ts, F.struct(F.col(ts).alias("_rts"), "_r").alias("_hit"), F.lit(0).alias("_side"))
    keep = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.struct(*keep).alias("_l") if keep else F.lit(None).alias("_l"),
                    F.lit(1).alias("_side"))
    if tolerance_s is not None and rows_per_chunk is None:
        width = max(width_s, tolerance_s)
        lcut = l.withColumn(CHUNK, floor_div(micros(ts), width * US))
        rcut = halo(r, width, back_s=tolerance_s, ts=ts).drop(HOME)
        both = lcut.unionByName(rcut, allowMissingColumns=True)
        w = (Window.partitionBy(*keys, CHUNK).orderBy(ts, "_side")
             .rowsBetween(Window.unboundedPreceding, 0))
        merged = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    else:
        both = l.unionByName(r, allowMissingColumns=True)
        merged = carry_last(both, {"_hit": F.col("_hit")}, width_s=width_s, order=(ts, "_side"), keys=keys, ts=ts,
                            rows_per_chunk=rows_per_chunk)
        merged = merged.where(F.col("_side") == 1)
    if tolerance_s is not None:
        gap = seconds_between(ts, "_hit._rts")
        fresh = (gap < F.lit(float(tolerance_s))) if strict else (gap <= F.lit(float(tolerance_s)))
        merged = merged.withColumn("_hit", F.when(fresh, F.col("_hit")))
    out = merged.select(*keys, ts, *[F.col(f"_l.{c}").alias(c) for c in keep],
                        *[F.col(f"_hit._r.{c}").alias(c) for c in cols],
                        *([(seconds_between(ts, "_hit._rts") / F.lit(age_unit_s)).alias(age)] if age else []))
    return out


def _known(keys: Sequence[str], ts: str) -> Column:
    """The row has a key and a time."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, ts)])


def latest_per_slot(df: DataFrame, step_s: int, cols: Sequence[str], *, tiebreak: Sequence[str] = (),
                    keys: Sequence[str] = KEYS, ts: str = "ts", name: str = "report") -> DataFrame:
    """Reports reduced to the newest one per grid slot (first slot at or after it).

    Feeds ``on_grid``: an as-of lookup there is ``last(report)`` over the frame.
    """
    at = F.struct(ts, *tiebreak)
    return (df.groupBy(*keys, ceil_to(ts, step_s).alias("_slot"))
            .agg(F.max_by(F.struct(F.col(ts).alias("at"), *cols), at).alias(name))
            .withColumnRenamed("_slot", ts))


def nearest_per_slot(df: DataFrame, step_s: int, tolerance_s: int, cols: Sequence[str], *,
                     tiebreak: Sequence[str] = (), keys: Sequence[str] = KEYS, ts: str = "ts",
                     distance: str = "gap_s") -> DataFrame:
    """Closest observation within the tolerance of each grid slot.

    Each observation is sent to the few slots it can serve and the best one is
    kept by a combining aggregate. Ties: earlier observation, then ``tiebreak``.
    """
    us, step, tol = micros(ts), step_s * US, tolerance_s * US
    lo = us - F.lit(tol) + F.pmod(-(us - F.lit(tol)), F.lit(step).cast("long"))
    hi = us + F.lit(tol) - F.pmod(us + F.lit(tol), F.lit(step).cast("long"))
    cand = df.select("*", us.alias("_at"), F.explode(
        F.when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("long")))).alias("_slot"))
    dist = F.abs(F.col("_slot") - F.col("_at"))
    best = cand.groupBy(*keys, "_slot").agg(F.min_by(
        F.struct((dist / F.lit(float(US))).alias(distance), *cols), F.struct(dist, F.col("_at"), *tiebreak)).alias("_b"))
    return best.select(*keys, from_micros(F.col("_slot")).alias(ts), "_b.*")


def nearest_join(left: DataFrame, right: DataFrame, cols: Sequence[str], *, tolerance_s: int,
                 tiebreak: Sequence[str] = (), width_s: int = 7 * DAY, keys: Sequence[str] = KEYS,
                 ts: str = "ts", distance: str = "gap_s") -> DataFrame:
    """Closest right row within the tolerance of each (irregular) left row."""
    at = F.struct(*(tiebreak or cols))
    right = right.where(_known(keys, ts))
    r = right.groupBy(*keys, ts).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), at).alias("_r"))
    r = r.select(*keys, ts, F.struct(F.col(ts).alias("_rts"), "_r").alias("_hit"), F.lit(0).alias("_side"))
    keep = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.struct(*keep).alias("_l"), F.lit(1).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    m = carry_last(both, {"_b": F.col("_hit")}, width_s=width_s, order=(ts, "_side"), keys=keys, ts=ts)
    m = carry_next(m, {"_a": F.col("_hit")}, width_s=width_s, order=(ts, "_side"), keys=keys, ts=ts).where(F.col("_side") == 1)
    gb, ga = seconds_between(ts, "_b._rts"), seconds_between("_a._rts", ts)
    hit = F.when(gb <= F.coalesce(ga, gb), F.col("_b")).when(ga.isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    m = m.withColumn("_hit", hit)
    gap = F.abs(seconds_between(ts, "_hit._rts"))
    m = m.withColumn("_hit", F.when(gap <= F.lit(float(tolerance_s)), F.col("_hit")))
    return m.select(*keys, ts, *[F.col(f"_l.{c}").alias(c) for c in keep],
                    *[F.col(f"_hit._r.{c}").alias(c) for c in cols],
                    F.abs(seconds_between(ts, "_hit._rts")).alias(distance))


def interval_agg(anchors: DataFrame, obs: DataFrame, span_s: int, aggs: Sequence[Column], *, step_s: int,
                 keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """For each anchor on a ``step_s`` grid, aggregate observations in ``(T - span, T]``.

    An observation belongs to ``span/step`` anchors; it is sent to those directly
    and aggregated with map-side combine before meeting the anchors.
    """
    us, step = micros(ts), step_s * US
    first = us + F.pmod(-us, F.lit(step).cast("long"))
    last = us + F.lit(span_s * US) - F.lit(1)
    cand = obs.withColumn("_slot", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))
    binned = cand.groupBy(*keys, from_micros(F.col("_slot")).alias(ts)).agg(*aggs)
    return anchors.join(binned, [*keys, ts], "left")


def shift_key(df: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """Move the join key; a +600 s shift makes a 10-minute-old value join now."""
    return df.withColumn(ts, shift(ts, seconds))


def lookup_at(df: DataFrame, offset_s: int, cols: dict[str, str], *, source: DataFrame | None = None,
              keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Value at exactly ``ts + offset``; ``cols`` maps source column to output name."""
    src = (df if source is None else source)
    then = shift_key(src.select(*keys, ts, *[F.col(a).alias(b) for a, b in cols.items()]), -offset_s, ts)
    return df.join(then, [*keys, ts], "left")


def period_join(df: DataFrame, periods: DataFrame, period_of: Column, cols: Sequence[str], *,
                keys: Sequence[str] = KEYS, period_col: str = "period", how: str = "left") -> DataFrame:
    """Join fine rows to a coarser table on a truncated time key."""
    p = periods.select(*keys, F.col(period_col).alias("_period"), *cols)
    return df.withColumn("_period", period_of).join(p, [*keys, "_period"], how).drop("_period")


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    """Full outer join on a shared, coalesced key."""
    return a.join(b, list(keys), "full")


def align_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    """Rows both models predicted."""
    return a.join(b, list(keys), "inner")


def keep_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    return df.join(wanted.select(*keys), list(keys), "left_semi")
