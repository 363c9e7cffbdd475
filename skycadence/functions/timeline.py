"""Zone-free arithmetic on wall-clock timestamps.

All series carry ``timestamp_ntz`` local wall time. Spark's ``date_trunc`` and
``unix_micros`` go through the session time zone, so binning here is integer
arithmetic on microseconds since 1970-01-01 00:00:00 wall time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
MINUTE = 60
HOUR = 3600
DAY = 86400


def _origin() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _whole(interval: Column) -> Column:
    """A day-time interval as whole microseconds."""
    return F.call_function("div", interval, F.expr("interval '0.000001' second"))


def micros(ts: Column | str) -> Column:
    return _whole(_col(ts) - _origin())


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, _origin())


def as_instant(ts: Column | str) -> Column:
    """Wall time as the instant with the same reading in UTC (watermarks need instants)."""
    return F.timestamp_micros(micros(ts))


def as_wall(instant: Column | str) -> Column:
    return from_micros(F.unix_micros(_col(instant)))


def shift(ts: Column | str, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(int(seconds)), _col(ts))


def floor_div(us: Column, width_us: int) -> Column:
    """Floor division that is also right for negative values; stays a long."""
    w = F.lit(int(width_us)).cast("long")
    return F.call_function("div", us - F.pmod(us, w), w)


def floor_to(ts: Column | str, step_s: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(step_s * US).cast("long")))


def ceil_to(ts: Column | str, step_s: int) -> Column:
    us = micros(ts)
    return from_micros(us + F.pmod(-us, F.lit(step_s * US).cast("long")))


def label(ts: Column | str, step_s: int, side: str = "left") -> Column:
    """Bin label. ``left`` = bin start, ``right`` = start of the next bin."""
    start = floor_to(ts, step_s)
    return start if side == "left" else shift(start, step_s)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Signed difference in seconds, sub-second part kept."""
    return _whole(_col(later) - _col(earlier)) / F.lit(float(US))


def month_start(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "month").cast("timestamp_ntz")


def day_start(ts: Column | str) -> Column:
    return _col(ts).cast("date").cast("timestamp_ntz")


def clock_hours(ts: Column | str) -> Column:
    """Hour of day with the minutes as a fraction."""
    return F.hour(_col(ts)) + F.minute(_col(ts)) / F.lit(60.0)


def on_or_after(ts: Column | str, day: str) -> Column:
    return _col(ts) >= F.expr(f"timestamp_ntz'{day} 00:00:00'")


def before(ts: Column | str, day: str) -> Column:
    return _col(ts) < F.expr(f"timestamp_ntz'{day} 00:00:00'")


def year_range(ts: Column | str, first: int, last: int) -> Column:
    """``YEAR(ts) BETWEEN first AND last`` in a form Parquet can prune on."""
    return on_or_after(ts, f"{first}-01-01") & before(ts, f"{last + 1}-01-01")
