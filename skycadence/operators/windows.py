"""Named window expressions for gap-free grid series.

Each helper takes the ``WindowSpec`` handed over by ``on_grid`` or
``halo_windows`` and returns a column, so any number of them share one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from skycadence.functions.timeline import seconds_between


def _as(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(x, k: int, w: WindowSpec) -> Column:
    return F.lag(_as(x), k).over(w)


def lead(x, k: int, w: WindowSpec) -> Column:
    return F.lead(_as(x), k).over(w)


def rolling(x, k: int, fn: str, w: WindowSpec, *, min_periods: int = 1, skip_current: bool = False) -> Column:
    """Trailing statistic over ``k`` rows, NULL below ``min_periods`` values.

    ``min_periods=k`` is the full-window rule; ``skip_current`` ends one row back.
    """
    frame = w.rowsBetween(-k, -1) if skip_current else w.rowsBetween(-k + 1, 0)
    x = _as(x)
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    if fn == "range":
        out = F.max(x).over(frame) - F.min(x).over(frame)
    else:
        out = fns[fn](x).over(frame)
    if min_periods > 1:
        out = F.when(F.count(x).over(frame) >= F.lit(min_periods), out)
    return out


def rolling_std_or_zero(x, k: int, w: WindowSpec) -> Column:
    return F.coalesce(rolling(x, k, "std", w), F.lit(0.0))


def valid_behind(ok: Column, k: int, w: WindowSpec) -> Column:
    """Number of rows meeting ``ok`` among the ``k`` rows before this one."""
    return F.sum(F.when(ok, F.lit(1)).otherwise(F.lit(0))).over(w.rowsBetween(-k, -1))


def valid_within(ok: Column, back: int, ahead: int, w: WindowSpec) -> Column:
    return F.sum(F.when(ok, F.lit(1)).otherwise(F.lit(0))).over(w.rowsBetween(-back, ahead))


def diff(x, k: int, w: WindowSpec, head=None) -> Column:
    d = _as(x) - lag(x, k, w)
    return d if head is None else F.coalesce(d, F.lit(head))


def guarded_lag(x, k: int, w: WindowSpec, *, step_s: int, tolerance_s: float, ts="ts") -> Column:
    """Row lag that is NULL unless it is ``k`` steps old within the tolerance."""
    off = seconds_between(_as(ts), lag(ts, k, w)) - F.lit(float(k * step_s))
    return F.when(F.abs(off) <= F.lit(float(tolerance_s)), lag(x, k, w))


def guarded_lead(x, k: int, w: WindowSpec, *, step_s: int, tolerance_s: float, ts="ts") -> Column:
    off = seconds_between(lead(ts, k, w), _as(ts)) - F.lit(float(k * step_s))
    return F.when(F.abs(off) <= F.lit(float(tolerance_s)), lead(x, k, w))


def step_seconds(w: WindowSpec, ts="ts") -> Column:
    return seconds_between(_as(ts), lag(ts, 1, w))


def sequence_of(cols, k: int, w: WindowSpec) -> Column:
    """The last ``k`` rows as an array of structs, oldest first."""
    return F.collect_list(F.struct(*cols)).over(w.rowsBetween(-k + 1, 0))


def mean_of_lags(x, ks, w: WindowSpec) -> Column:
    parts = [lag(x, k, w) for k in ks]
    return reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))


def forward_fill(x, limit: int, w: WindowSpec) -> Column:
    return F.last(_as(x), ignorenulls=True).over(w.rowsBetween(-limit, 0))


def backward_fill(x, limit: int, w: WindowSpec) -> Column:
    return F.first(_as(x), ignorenulls=True).over(w.rowsBetween(0, limit))


def asof_value(report, w: WindowSpec, back: int) -> Column:
    """Most recent non-NULL report struct among this slot and ``back`` before it."""
    return F.last(_as(report), ignorenulls=True).over(w.rowsBetween(-back, 0))
