"""Solar geometry, clear-sky irradiance and the ratios built on them.

Everything is a ``Column -> Column`` builder, so it stays inside whole-stage
code generation. Formulas: Cooper (1969) declination, local solar time from
the station meridian, and the clear-sky forms named in each function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycadence.functions.exprs import clip, floor_at


def _as(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(float(c)))


def _sql(x) -> str:
    """A number, column name or SQL expression as SQL text."""
    return f"{float(x)!r}D" if isinstance(x, (int, float)) else f"({x})"


def _ahead(ts: str, seconds: int) -> str:
    return f"timestampadd(SECOND, {int(seconds)}, {ts})" if seconds else ts


def _elevation_sql(ts: str, lat: str, clock_shift_h: str) -> str:
    """Elevation from sin a = sin f sin d + cos f cos d cos H.

    One SQL text per call: the formula has some forty nodes, and building it node
    by node from Python costs more than running it on small data.
    """
    decl = f"radians(23.45D * sin(radians(360.0D * (284.0D + dayofyear({ts})) / 365.0D)))"
    angle = f"radians((hour({ts}) + minute({ts}) / 60.0D + {clock_shift_h} - 12.0D) * 15.0D)"
    phi = f"radians({lat})"
    s = f"sin({phi}) * sin({decl}) + cos({phi}) * cos({decl}) * cos({angle})"
    # greatest/least skip NULL, so an unknown position is ruled out first.
    return f"CASE WHEN {lat} IS NOT NULL AND {ts} IS NOT NULL THEN degrees(asin(least(greatest({s}, -1.0D), 1.0D))) END"


def elevation_deg(ts: str, lat, lon, meridian=105.0, ahead_s: int = 0) -> Column:
    """Solar elevation in degrees, ``ahead_s`` seconds after local wall time ``ts``.

    ``ts`` is a column name; the position is a number or a column / SQL expression.
    """
    shift_h = f"4.0D * ({_sql(lon)} - {_sql(meridian)}) / 60.0D"
    return F.expr(_elevation_sql(_ahead(ts, ahead_s), _sql(lat), shift_h))


def elevation_deg_utc(ts: str, lat, lon, utc_offset_hours: float = 7.0) -> Column:
    """Variant that goes back to UTC and uses ``lon/15``; never below zero."""
    e = _elevation_sql(_ahead(ts, -int(utc_offset_hours * 3600)), _sql(lat), f"{_sql(lon)} / 15.0D")
    return floor_at(F.expr(e), 0.0)


def sin_elev(elev: Column | str) -> Column:
    return F.sin(F.radians(_as(elev)))


def clear_sky(elev: Column | str, kind: str = "flat", *, doy: Column | None = None,
              water: Column | None = None, aerosol: Column | None = None) -> Column:
    """Clear-sky irradiance by named form.

    flat        1100 * max(sin a, 0)
    power       950 * max(sin a, 0)^1.1, at least 1
    power_dark  950 * max(sin a, 0)^1.1, zero at night
    toa         1366.1 * (1 + 0.033 cos(2 pi doy/365)) * sin a
    attenuated  power_dark * (5/water)^0.15 * exp(-1.5 aerosol)
    """
    up = floor_at(sin_elev(elev), 0.0)
    if kind == "flat":
        return F.lit(1100.0) * up
    if kind == "power":
        return floor_at(F.lit(950.0) * F.pow(up, F.lit(1.1)), 1.0)
    if kind == "power_dark":
        return F.lit(950.0) * F.pow(up, F.lit(1.1))
    if kind == "toa":
        return (F.lit(1366.1)
                * (F.lit(1.0) + F.lit(0.033) * F.cos(F.lit(2 * math.pi) * doy / F.lit(365.0)))
                * sin_elev(elev))
    if kind == "attenuated":
        return (F.lit(950.0) * F.pow(up, F.lit(1.1))
                * F.pow(F.lit(5.0) / water, F.lit(0.15)) * F.exp(F.lit(-1.5) * aerosol))
    raise ValueError(f"unknown clear-sky form: {kind}")


def clearness(x: Column | str, cs: Column, floor: float = 20.0,
              upper: float | None = None, dark_zero: Column | None = None) -> Column:
    """Clearness index ``x / max(cs, floor)``, optionally clipped to [0, upper]."""
    kt = _as(x) / floor_at(cs, floor)
    if upper is not None:
        kt = clip(kt, 0.0, upper)
    if dark_zero is not None:
        kt = F.when(dark_zero, F.lit(0.0)).otherwise(kt)
    return kt


def clearness_point(x: Column | str, elev: Column | str) -> Column:
    """History form of the index: the sine is floored at 0.02 before scaling,
    so the effective denominator floor is 22 rather than 20."""
    base = F.lit(1100.0) * floor_at(sin_elev(elev), 0.02)
    return _as(x) / floor_at(base, 20.0)


def clearness_toa(x: Column | str, elev: Column | str, doy: Column, min_elev: float = 5.0) -> Column:
    toa = clear_sky(elev, "toa", doy=doy)
    return F.when(_as(elev) > F.lit(min_elev), _as(x) / F.nullif(toa, F.lit(0.0)))


def persistence_by_sine(x, sin_now: Column, sin_then: Column) -> Column:
    """Scale the current value by the ratio of sines; ratio 1 near the horizon."""
    return _as(x) * F.when(sin_now > F.lit(0.05), sin_then / sin_now).otherwise(F.lit(1.0))


def persistence_by_clear_sky(x, cs_now: Column, cs_then: Column, floor: float = 10.0) -> Column:
    return F.when(cs_now > F.lit(floor), _as(x) * cs_then / cs_now).otherwise(_as(x))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def acceleration(x, near, far) -> Column:
    """Second difference ``x - 2 near + far``."""
    return _as(x) - F.lit(2.0) * _as(near) + _as(far)


def season_two(month: Column, dry=(4, 9)) -> Column:
    return F.when(month.between(*dry), F.lit("dry")).otherwise(F.lit("wet"))


def season_three(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), F.lit("wet"))
            .when(month.isin(6, 7, 8, 9), F.lit("dry"))
            .otherwise(F.lit("transition")))
