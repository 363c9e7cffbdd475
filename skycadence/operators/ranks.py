"""Exact order statistics of groups of any size.

``percentile`` keeps every distinct value of a group in one task's buffer.
Here equal values are combined first, the distinct values are spread over
log-scaled buckets, and a small histogram turns the position inside a bucket
into the position inside the group. Results are exact; the bucket width only
affects how evenly the work is spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycadence.sources.sinks import materialize

_LOG_WIDTH = math.log(1.001)
_LOG_SHIFT = 800_000  # |ln(double)| / ln(1.001) stays below this


def value_bucket(v: Column) -> Column:
    """Order-preserving bucket number with about 0.1 % relative width."""
    size = F.floor(F.log(F.abs(v)) / F.lit(_LOG_WIDTH)).cast("long") + F.lit(_LOG_SHIFT)
    size = F.when(F.abs(v) == F.lit(math.inf), F.lit(2 * _LOG_SHIFT)).otherwise(size)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL, as in GROUP BY; the keys of the left side are kept."""
    if not keys:  # one row on the right
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def ranked_values(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group with the rank range ``[_lo, _hi)`` each one covers
    and the group size ``_n``. NULL and NaN values are left out; a NULL key is a group."""
    keys = list(keys)
    v = F.col(col).cast("double")
    vals = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_bucket(F.col("_v")))
            .where(F.col("_b").isNotNull()))
    hist = vals.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    per_key = Window.partitionBy(*keys)
    below = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*keys, "_b", F.coalesce(F.sum("_bc").over(below), F.lit(0)).alias("_off"),
                          F.sum("_bc").over(per_key).alias("_n"))
    # The cumulative count runs before the join: whichever side the join broadcasts,
    # the values have been sorted per bucket, not per key.
    w = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = vals.select("*", F.sum("_c").over(w).alias("_cum"))
    hi = F.col("_off") + F.col("_cum")
    return _same(local, offsets, [*keys, "_b"]).select(*keys, "_v", "_c", "_n", (hi - F.col("_c")).alias("_lo"), hi.alias("_hi"))


def _pick(position: Column) -> tuple[Column, Column]:
    at = F.floor(position)
    low = F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col("_v")))
    up = F.ceil(position)
    high = F.max(F.when((F.col("_lo") <= up) & (up < F.col("_hi")), F.col("_v")))
    return low, high


def quantile_at(df: DataFrame, col: str, keys: Sequence[str],
                levels: dict[str, Callable[[Column], Column] | float],
                size: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles; a level may be a function of group size."""
    ranked = ranked_values(df, col, keys)
    n = F.col("_n")
    aggs = [F.max(n).alias("_size")]
    level_of = {}
    for name, level in levels.items():
        p = level(n) if callable(level) else F.lit(float(level))
        low, high = _pick(p * (n - 1))
        aggs += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}")]
        size_col = F.col("_size")
        level_of[name] = (level(size_col) if callable(level) else F.lit(float(level))) * (size_col - 1)
    got = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for name, pos in level_of.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    extra = [F.col("_size").alias(size)] if size else []
    return got.select(*keys, *extra, *cols)


def exact_quantiles(df: DataFrame, col: str, keys: Sequence[str] = (),
                    probs: dict[str, float] | None = None, size: str | None = None) -> DataFrame:
    return quantile_at(df, col, keys, probs or {"median": 0.5}, size)


CELLS = 65_536         # parts of a bucket that holds a wanted rank
FEW_TARGETS = 100_000  # open buckets and cells that are broadcast; more of them are joined by shuffling


def _near(rows: DataFrame, targets: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows whose cell is wanted. A few wanted cells are broadcast, so no other row is moved."""
    other = targets.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return rows.join(F.broadcast(other) if few else other, on).drop(*[f"_r_{k}" for k in keys])


def _wanted(cells: DataFrame, within: Sequence[str], order: str, start: Column, ranks: Column) -> DataFrame:
    """Cells with the wanted ranks they hold (``_want``, counted in the group) and the number of values before them."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_before", start + F.sum("_c").over(w) - F.col("_c"))
    want = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    return cells.withColumn("_want", want).where(F.size("_want") > 0)


def refined_quantiles(df: DataFrame, col: str, keys: Sequence[str] = (), probs: dict[str, float] | None = None, size: str | None = None) -> DataFrame:
    """Exact interpolated quantiles by narrowing in on the wanted ranks: ``keys, [size], <probs>``.

    The first pass counts values per log-scaled bucket, the second cuts the buckets that hold a wanted rank into 65,536
    parts between their smallest and largest value, and only values of parts that hold a wanted rank are shuffled, spread
    over those parts. Counts combine on the map side, so values that lie close together (a pressure, a temperature) are
    never all moved as ``exact_quantiles`` moves them. The input is read three times: write it first if it is dear.
    NULL and NaN are left out; a NULL key is a group; groups without values give no row.
    """
    probs = probs or {"median": 0.5}
    keys = list(keys)
    base = df.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", value_bucket(F.col("_v")))
    every = [*keys, "_all"]
    base = base.withColumn("_all", F.lit(0))
    part = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    hist = materialize(base.groupBy(*every, "_b").agg(*part), "buckets")
    hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*every)))
    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in positions])))
    hist = hist.withColumn("_ranks", ranks)
    open_ = materialize(_wanted(hist, every, "_b", F.lit(0), F.col("_ranks")), "open")
    few = open_.count() <= FEW_TARGETS
    found = open_.where(F.col("_lo") == F.col("_hi")).select(*every, "_n", "_want", F.col("_lo").alias("_v"))

    wide = open_.where(F.col("_lo") < F.col("_hi")).select(*every, "_b", "_n", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"),
                                                           F.col("_before").alias("_start"), F.col("_want").alias("_ranks"))
    spread = F.col("_v") / 2 - F.col("_from") / 2, F.col("_to") / 2 - F.col("_from") / 2  # halves cannot overflow
    at = F.least(F.floor(spread[0] / spread[1] * CELLS), F.lit(CELLS - 1)).cast("long")
    inside = _near(base, wide, [*every, "_b"], few).withColumn("_cell", at)
    cells = inside.groupBy(*every, "_b", "_cell", "_n", "_start", "_ranks").agg(*part)
    cells = materialize(_wanted(cells, [*every, "_b"], "_cell", F.col("_start"), F.col("_ranks")), "cells")
    found = found.unionByName(cells.where(F.col("_lo") == F.col("_hi")).select(*every, "_n", "_want", F.col("_lo").alias("_v")))

    last = cells.where(F.col("_lo") < F.col("_hi")).select(*every, "_b", "_cell", F.col("_before").alias("_base"), F.col("_want").alias("_last"))
    values = _near(inside.select(*every, "_b", "_cell", "_n", "_v"), last, [*every, "_b", "_cell"], few)
    values = values.groupBy(*every, "_b", "_cell", "_n", "_base", "_last", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = _wanted(values, [*every, "_b", "_cell"], "_v", F.col("_base"), F.col("_last"))
    found = found.unionByName(values.select(*every, "_n", "_want", "_v"))

    aggs = [F.max("_n").alias("_n")]
    for k, p in enumerate(positions):
        aggs += [F.max(F.when(F.array_contains("_want", F.floor(p).cast("long")), F.col("_v"))).alias(f"_low_{k}"),
                 F.max(F.when(F.array_contains("_want", F.ceil(p).cast("long")), F.col("_v"))).alias(f"_high_{k}")]
    got = found.groupBy(*every).agg(*aggs)
    between = [(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (p - F.floor(p))).alias(name) for k, (name, p) in enumerate(zip(probs, positions))]
    return got.select(*keys, *([F.col("_n").alias(size)] if size else []), *between)


def first_n(df: DataFrame, order: Column, n: Column | int, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of each group with the smallest numeric ``order`` value, equal values by the ``tie`` columns.

    The cut-off value is found from ranks, so no group is sorted in one task: only
    rows that equal the cut-off value, a handful for a hash, are put in order.
    """
    d = df.withColumn("_order", order.cast("double"))
    ranked = ranked_values(d, "_order", keys)
    limit = F.lit(n) if isinstance(n, int) else n
    cut = ranked.where(F.col("_lo") < limit).groupBy(*keys).agg(
        F.max("_v").alias("_cut"), F.max_by(limit - F.col("_lo"), "_v").alias("_room"))
    near = _same(d, cut, list(keys)).where(F.col("_order") <= F.col("_cut"))
    at = Window.partitionBy(*keys, "_order").orderBy(*(tie or ["_order"]))
    edge = near.where(F.col("_order") == F.col("_cut")).withColumn("_place", F.row_number().over(at))
    kept = near.where(F.col("_order") < F.col("_cut")).unionByName(edge.where(F.col("_place") <= F.col("_room")).drop("_place"))
    return kept.drop("_order", "_cut", "_room")
