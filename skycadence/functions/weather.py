"""Observer codes: cloud types, present and past weather, sky cover classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycadence.functions.exprs import _as, flag

# Synoptic code groups.
CUMULONIMBUS, CUMULUS, STRATOCUMULUS = [3, 9], [1, 2, 8], [4, 5]
RAIN_CODES, THUNDER_CODES, PAST_RAIN_CODES = (50, 99), [17, 29, 95, 96, 97, 98, 99], (5, 9)


def cloud_type_flags(code) -> list[Column]:
    c = _as(code)
    return [flag(c.isin(CUMULONIMBUS)).alias("is_cb"), flag(c.isin(CUMULUS)).alias("is_cu"),
            flag(c.isin(STRATOCUMULUS)).alias("is_sc")]


def weather_code_flags(present, past) -> list[Column]:
    p, q = _as(present), _as(past)
    return [flag(p.between(*RAIN_CODES)).alias("is_rain"), flag(p.isin(THUNDER_CODES)).alias("is_thunder"),
            flag(q.between(*PAST_RAIN_CODES)).alias("past_rain")]


def sky_flags(oktas) -> list[Column]:
    """Continuous classes without holes for fractional means."""
    o = _as(oktas)
    return [flag(o <= 2).alias("sky_clear"), flag((o > 2) & (o <= 5)).alias("sky_part"),
            flag((o > 5) & (o < 8)).alias("sky_most"), flag(o >= 8).alias("sky_over")]


def oktas_class(oktas) -> Column:
    o = _as(oktas)
    return (F.when(o <= 2, "clear").when(o <= 5, "scattered").when(o < 8, "broken").when(o >= 8, "overcast")
            .otherwise("missing"))
