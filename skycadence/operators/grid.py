"""De-duplication, binning, complete grids and gap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycadence.functions.exprs import lookup
from skycadence.functions.timeline import US, DAY, ceil_to, from_micros, label, micros, seconds_between, shift
from skycadence.operators.chunks import CHUNK, KEYS, SLOT, carry_last, grid_slots, halo_windows, on_grid, series_bounds


def dedup_by_priority(df: DataFrame, source: str, ranking: dict[str, int], *, tiebreak: Sequence[str],
                      default_rank: int = 99, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    """One row per key, best-ranked source first, ``tiebreak`` among equals.

    Written as ``min_by`` over a struct: it combines before the shuffle, so a key
    repeated in a third of all rows costs one row per input partition.
    """
    prio = lookup(source, ranking, default_rank)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(prio.alias("_p"), *tiebreak)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("site", "ts")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def source_distribution(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def resample(df: DataFrame, step_s: int, aggs: Sequence[Column], *, side: str = "left", min_n: int = 0,
             keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Bin aggregates. ``side="right"`` labels a bin by its end, and a row exactly
    on a boundary belongs to the next label. ``min_n`` drops thin bins."""
    out = df.groupBy(*keys, label(ts, step_s, side).alias(ts)).agg(
        *aggs, *([F.count(F.lit(1)).alias("_n")] if min_n else []))
    return out.where(F.col("_n") >= min_n).drop("_n") if min_n else out


def interval_bins(df: DataFrame, step_s: int, aggs: Sequence[Column], *, keys: Sequence[str] = KEYS,
                  ts: str = "ts") -> DataFrame:
    """Aggregates over ``(T - step, T]`` labelled ``T``."""
    return df.groupBy(*keys, ceil_to(ts, step_s).alias(ts)).agg(*aggs)


def regular_grid(df: DataFrame, step_s: int, *, chunk_steps: int = 1008, bounds: DataFrame | None = None,
                 keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """The frame on a complete inclusive grid; missing slots become NULL rows."""
    b = series_bounds(df, step_s, keys, ts) if bounds is None else bounds
    return on_grid([df], step_s=step_s, bounds=b, chunk_steps=chunk_steps, keys=keys, ts=ts)


def daily_grid(df: DataFrame, *, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    return regular_grid(df, DAY, chunk_steps=366, keys=keys, ts=ts)


def gap_histogram(df: DataFrame, *, unit_s: float = 60.0, width_s: int = 7 * DAY,
                  keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Distribution of the distance between consecutive rows."""
    d = carry_last(df.select(*keys, ts), {"_prev": F.col(ts)}, width_s=width_s, order=(ts,), keys=keys,
                   ts=ts, include_current=False)
    gap = seconds_between(ts, "_prev") / F.lit(unit_s)
    return d.where(F.col("_prev").isNotNull()).groupBy(*keys, gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))


def missing_slots(df: DataFrame, step_s: int, *, chunk_steps: int = 1008, keys: Sequence[str] = KEYS,
                  ts: str = "ts") -> DataFrame:
    """Grid slots without a row."""
    slots = grid_slots(series_bounds(df, step_s, keys, ts), step_s, chunk_steps, keys=keys)
    slots = slots.select(*keys, from_micros(F.col(SLOT)).alias(ts))
    return slots.join(df.select(*keys, ts), [*keys, ts], "left_anti")


def point_sample(df: DataFrame, step_s: int, cols: Sequence[str], *, tiebreak: Sequence[str] = (),
                 keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """First reading of each bin instead of the bin mean."""
    at = F.struct(ts, *tiebreak)
    return df.groupBy(*keys, label(ts, step_s).alias("_bin")).agg(
        *[F.min_by(c, at).alias(c) for c in cols]).withColumnRenamed("_bin", ts)
