"""The two feature tables, built from the tables of published columns in ``spec``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycadence.functions.exprs import flag, floor_at, strict_mean
from skycadence.functions.solar import clear_sky, clearness, clearness_point, cyclic, sin_elev
from skycadence.functions.timeline import clock_hours, seconds_between, shift
from skycadence.operators.chunks import on_grid
from skycadence.operators.grid import resample
from skycadence.operators.temporal import latest_per_slot
from skycadence.operators.windows import asof_value, lag, lead, rolling, valid_behind
from skycadence.spec import FEATURES, HISTORY, HISTORY_STEPS, MEASURES, RECIPE, SOURCES, STEP_S, VALID_MAX, VALID_MIN, Entry

_C = F.col
REPORT_MAX_AGE_S = 6 * 3600
_STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "any": lambda c: F.max(flag(c)),
               "hits": lambda c: F.sum(flag(c)), "rows": lambda c: F.count(F.lit(1))}


def bins(readings: DataFrame, source: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """The published measures of one source per 10-minute bin; ``derived`` are fields that are expressions."""
    fields = derived or {}
    return resample(readings.withColumns(fields) if fields else readings, STEP_S, [
        _STATISTICS[how](_C(field)).alias(name) for name, origin, field, how in MEASURES if origin == source])


def radiation_cells(rad: DataFrame, elev: Column) -> DataFrame:
    return bins(rad, "radiation", {"net": _C("ghi") - _C("reflected"), "elevation": elev, "good": _C("data_flag") == 0})


def cloud_cells(cloud: DataFrame) -> DataFrame:
    kind = _C("cloud_class")
    classes = {"thin": "thin_cloud", "moderate": "moderate_cloud", "thick": "thick_cloud"}
    return bins(cloud, "cloud", {"present": _C("cloud_present"), "clear": kind.startswith("clear"),
                                 **{field: kind == name for field, name in classes.items()}})


def weather_cells(met: DataFrame) -> DataFrame:
    return bins(met, "weather")


def history(e: Entry, w, now: str, past: str | None = None) -> Column:
    """One column of a table of entries: ``now`` is its current value, ``past`` the series its history is read from."""
    past = past or now
    made = {
        "now": lambda: _C(now),
        "lag": lambda: lag(past, e.steps, w),
        "lead": lambda: lead(past, e.steps, w),
        "delta": lambda: _C(now) - lag(past, e.steps, w),
        "apart": lambda: _C(now) - rolling(past, e.steps, "mean", w),
        "accel": lambda: _C(now) - 2 * lag(past, e.steps, w) + lag(past, 2 * e.steps, w),
    }
    return (made[e.how]() if e.how in made else rolling(past, e.steps, e.how, w)).alias(e.name)


def _wide_windows(g: DataFrame, w) -> DataFrame:
    """Reports, history and target in one window pass."""
    g = g.withColumn("_rep", asof_value("report", w, REPORT_MAX_AGE_S // STEP_S))
    fresh = seconds_between("ts", "_rep.at") <= F.lit(float(REPORT_MAX_AGE_S))
    reports = [F.when(fresh, _C(f"_rep.{field}")).alias(name) for name, source, field, _ in MEASURES if source == "report"]
    return g.select("*", *reports, *[history(e, w, e.source) for e in HISTORY],
                    valid_behind(_C("ghi_now").isNotNull(), HISTORY_STEPS, w).alias("_behind"))


def wide_table(radiation: DataFrame, cloud: DataFrame, weather: DataFrame, reports: DataFrame, elev: Column,
               bounds: DataFrame, chunk_steps: int = 1008) -> DataFrame:
    """The 102-column 10-minute table: calendar, measures, flags, history and target.

    Four sources meet on one grid with a single shuffle after their bin
    aggregates; the observer reports ride along as structs for the as-of lookup.
    """
    fields = [field for _, source, field, _ in MEASURES if source == "report"]
    rep = latest_per_slot(reports, STEP_S, fields, tiebreak=["event_id"])
    g = on_grid([radiation_cells(radiation, elev), cloud_cells(cloud), weather_cells(weather), rep], _wide_windows,
                step_s=STEP_S, bounds=bounds, back=REPORT_MAX_AGE_S // STEP_S, ahead=6, chunk_steps=chunk_steps)
    g = g.withColumns({has: _C(shown).isNotNull() for has, _, shown in SOURCES.values()})
    ts = _C("ts")
    calendar = {part: fn(ts).cast("long") for part, fn in (
        ("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute))}
    waves = {f"{name}_{kind}": wave for name, at, period in (("hour", clock_hours(ts), 24.0), ("month", F.month(ts), 12.0))
             for kind, wave in zip(("sin", "cos"), cyclic(at, period))}
    complete = _C("_behind") == HISTORY_STEPS
    quality = {state: F.when(_C(has), "ok").otherwise("missing") for has, state, _ in SOURCES.values()}
    flags = {
        "daylight_flag": flag(_C("solar_elev_deg") > 0), "sun_above_5deg_flag": flag(_C("solar_elev_deg") > 5),
        "has_continuous_3h_history": flag(complete),
        "is_model_ready": flag(complete & _C("has_asrs") & _C("target_ghi_1h_ahead").isNotNull()),
        "master_qc_status": F.when(~_C("has_asrs"), "missing_radiation").when(_C("has_clp"), "ok").otherwise("partial_no_clp"),
    }
    made = {**calendar, **waves, **flags, **quality}
    return g.select("site", ts.alias("ts_wib"), shift(ts, 3600).alias("target_ts_wib"), *[c.alias(n) for n, c in made.items()],
                    *[m[0] for m in MEASURES], *[has for has, _, _ in SOURCES.values()], *[e.name for e in HISTORY])


# Current value and history of the recipe's sources: the ratio's history keeps a floor under the sun's sine.
_SERIES = {"ghi": ("ghi_now", "ghi_now"), "kt": ("kt_now", "kt_point"), "cot": ("clp_cot", "clp_cot")}


def recipe_windows(g: DataFrame, w, elev_at) -> DataFrame:
    """History part of the recipe. ``elev_at(s)`` builds the elevation ``s`` seconds ahead."""
    g = g.withColumn("solar_elev_deg", elev_at(0))
    g = g.withColumns({"kt_point": clearness_point("ghi_now", "solar_elev_deg"), "kt_now": clearness("ghi_now", clear_sky("solar_elev_deg"))})
    made = [history(e, w, *_SERIES[e.source]) for e in RECIPE if e.source in _SERIES and e.how != "now"]
    ahead = [lead("ghi_now", k, w).alias(f"ghi_lead_{k * 10}m") for k in range(1, 7)]
    return g.select("*", *made, *ahead, valid_behind(_C("ghi_now").isNotNull(), HISTORY_STEPS, w).alias("_behind"))


def recipe_columns(df: DataFrame, elev_at) -> DataFrame:
    """Row-wise part of the recipe: cycles, known future, targets."""
    ts = _C("ts")
    waves = {f"{name}_{kind}": wave for name, at, period in (
        ("hour", clock_hours(ts), 24.0), ("doy", F.dayofyear(ts), 365.25), ("month", F.month(ts), 12.0))
        for kind, wave in zip(("sin", "cos"), cyclic(at, period))}
    future = [clear_sky(elev_at(k * STEP_S)) for k in range(1, 7)]
    mean_cs = sum(future[1:], future[0]) / F.lit(6.0)
    leads = [_C(f"ghi_lead_{k * 10}m") for k in range(1, 7)]
    df = df.withColumns({
        **waves, "ghi_cs_t60": future[5], "elev_sin_t60": floor_at(sin_elev(elev_at(3600)), 0.0), "ghi_cs_avg_t10_t60": mean_cs,
        "ghi_point_t60": leads[5], "ghi_avg_t10_t60": strict_mean(leads, VALID_MIN, VALID_MAX)})
    return df.withColumns({
        "smart_persist": _C("kt_now") * _C("ghi_cs_t60"), "smart_persist_avg": _C("kt_now") * _C("ghi_cs_avg_t10_t60"),
        "delta_point": _C("ghi_point_t60") - _C("ghi_now"), "delta_avg": _C("ghi_avg_t10_t60") - _C("ghi_now")})


def recipe50(sources, bounds: DataFrame, elev_at, *, chunk_steps: int = 1008, ready_only: bool = True,
             extra: tuple[str, ...] = ()) -> DataFrame:
    """The 50 features with targets, one row per anchor.

    ``sources`` are binned frames providing ``ghi_now`` and the cloud columns. The
    readiness filter comes after the windows, so lags stay calendar-correct.
    """
    g = on_grid(sources, lambda d, w: recipe_windows(d, w, elev_at), step_s=STEP_S, bounds=bounds,
                back=HISTORY_STEPS, ahead=6, chunk_steps=chunk_steps)
    if ready_only:
        g = g.where((_C("_behind") == HISTORY_STEPS) & _C("ghi_now").between(VALID_MIN, VALID_MAX)
                    & _C("ghi_lead_60m").isNotNull() & (_C("solar_elev_deg") > 5))
    return recipe_columns(g, elev_at).select(
        "site", "ts", *FEATURES, "ghi_point_t60", "ghi_avg_t10_t60", "delta_point", "delta_avg", "solar_elev_deg", *extra)
