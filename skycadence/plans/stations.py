"""Station observations derived from the ``events`` table, and their SQL twin.

Three stations: the network as a whole (``all``, holding half of all rows) and two
halves by user parity. Every event is a radiation reading; purchases double as
satellite retrievals, clicks as surface weather and signups as observer reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycadence.functions.solar import elevation_deg
from skycadence.operators.chunks import on_grid, series_bounds
from skycadence.operators.grid import resample
from skycadence.plans.registry import Tables
from skycadence.spec import STEP_S, SiteSpec, per_site

SITES = [SiteSpec("all", -3.86, 102.34), SiteSpec("even", -1.60, 103.65), SiteSpec("odd", -6.28, 106.56)]


def observations(t: Tables) -> DataFrame:
    """Readings at the logger's resolution of 1/64, once per station they count for."""
    half = F.when(F.col("user_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    return t.events.select(
        F.explode(F.array(F.lit("all"), half)).alias("site"), "ts", "event_id", "user_id", "event_type",
        (F.floor(F.col("value") * 64.0 + 0.5) / 64.0).alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def radiation(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    return observations(t).select(
        "site", "ts", "event_id", (v * 10.0).alias("ghi"), (v * k / 8.0).alias("dhi"), (v * 8.0).alias("dni"),
        (v * 2.0).alias("reflected"), (F.col("event_id") % 4).alias("data_flag"))


def cloud(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    cot = v / 4.0
    return observations(t).where(F.col("event_type") == "purchase").select(
        "site", "ts", "event_id", cot.alias("cot"), (k * 100.0).alias("cth"), (F.lit(300.0) - k).alias("ctt"),
        (F.lit(5.0) + k / 8.0).alias("cer"), (v > 20).alias("cloud_present"),
        F.when(cot < 2, "clear_or_very_thin").when(cot < 6, "thin_cloud").when(cot < 15, "moderate_cloud")
        .otherwise("thick_cloud").alias("cloud_class"))


def weather(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    return observations(t).where(F.col("event_type") == "click").select(
        "site", "ts", "event_id", (F.lit(20.0) + k / 8.0).alias("temp"), v.alias("rh"),
        (F.lit(1000.0) + k / 8.0).alias("pressure"), (k / 16.0).alias("ws"), (k / 8.0).alias("ws_max"),
        (k * 3.625).alias("wd"), (v / 128.0).alias("rain"), (v * 9.0).alias("sr"))


def reports(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("k")
    return observations(t).where(F.col("event_type") == "signup").select(
        "site", "ts", "event_id", (F.lit(22.0) + k / 8.0).alias("temp"), (F.lit(15.0) + k / 16.0).alias("dewpoint"),
        v.alias("rh"), (k / 8.0).alias("wind"), (k * 3.625).alias("wind_dir"),
        (F.lit(10.0) - k / 16.0).alias("visibility"), (v / 8.0).alias("rain24"), (v * 3.0).alias("rad24"),
        (k * 0.09375).alias("oktas"))


def _logged(x: Column) -> Column:
    return F.floor(x * 64.0 + 0.5) / 64.0


def _cell_aggs() -> list[Column]:
    v, k, kind = F.col("value"), F.col("k"), F.col("event_type")
    bought, clicked, joined = kind == "purchase", kind == "click", kind == "signup"
    return [_logged(F.avg(v * 10.0)).alias("ghi"), _logged(F.avg(v * k / 8.0)).alias("dhi"),
            _logged(F.avg(v * 8.0)).alias("dni"), _logged(F.avg(F.when(bought, v / 4.0))).alias("cot"),
            F.max(F.when(bought, (v > 20).cast("int"))).alias("cp"),
            _logged(F.avg(F.when(clicked, F.lit(20.0) + k / 8.0))).alias("temp"),
            F.sum(F.when(clicked, v / 128.0)).alias("rain"), _logged(F.avg(F.when(joined, k * 0.09375))).alias("oktas"),
            F.count(F.lit(1)).alias("n")]


def cells(t: Tables, step_s: int = STEP_S, side: str = "left", min_n: int = 0) -> DataFrame:
    """Binned series: one scan, one combining aggregate for all measures."""
    return resample(observations(t), step_s, _cell_aggs(), side=side, min_n=min_n)


def series(t: Tables, fn: Callable | None = None, *, back: int = 0, ahead: int = 0, step_s: int = STEP_S,
           chunk_steps: int = 1008) -> DataFrame:
    """The binned series on its complete grid, with windows applied by ``fn``."""
    return on_grid([cells(t, step_s)], fn, step_s=step_s, bounds=series_bounds(observations(t), step_s),
                   back=back, ahead=ahead, chunk_steps=chunk_steps)


def elevation(ahead_s: int = 0) -> Column:
    """Elevation at each row's own station, now or some seconds ahead."""
    return elevation_deg("ts", per_site(SITES, "lat"), per_site(SITES, "lon"), per_site(SITES, "meridian"), ahead_s)


# ---- SQL twins -----------------------------------------------------------

_V = "floor(value * 64.0::DOUBLE + 0.5::DOUBLE) / 64.0::DOUBLE"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
OBS = f"""obs AS (
  SELECT 'all' AS site, ts, event_id, user_id, event_type, {_V} AS value, {_K} AS k FROM events
  UNION ALL
  SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, ts, event_id, user_id, event_type, {_V}, {_K} FROM events)"""


def _logged_sql(x: str) -> str:
    return f"floor({x} * 64.0::DOUBLE + 0.5::DOUBLE) / 64.0::DOUBLE"


_AGG = f"""{_logged_sql('avg(value * 10.0::DOUBLE)')} AS ghi, {_logged_sql('avg(value * k / 8.0::DOUBLE)')} AS dhi,
  {_logged_sql('avg(value * 8.0::DOUBLE)')} AS dni,
  {_logged_sql("avg(CASE WHEN event_type = 'purchase' THEN value / 4.0::DOUBLE END)")} AS cot,
  max(CASE WHEN event_type = 'purchase' THEN CAST(value > 20 AS INTEGER) END) AS cp,
  {_logged_sql("avg(CASE WHEN event_type = 'click' THEN 20.0::DOUBLE + k / 8.0::DOUBLE END)")} AS temp,
  sum(CASE WHEN event_type = 'click' THEN value / 128.0::DOUBLE END) AS rain,
  {_logged_sql("avg(CASE WHEN event_type = 'signup' THEN k * 0.09375::DOUBLE END)")} AS oktas,
  count(*) AS n"""


def cells_sql(step: str = "10 MINUTE", name: str = "c10", side: str = "left") -> str:
    at = f"time_bucket(INTERVAL {step}, ts)" + (f" + INTERVAL {step}" if side == "right" else "")
    return f"{name} AS (SELECT site, {at} AS ts, {_AGG} FROM obs GROUP BY 1, 2)"


def grid_sql(step: str = "10 MINUTE", cells_name: str = "c10", name: str = "s10") -> str:
    return f"""{name}_g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts
  FROM {cells_name} GROUP BY site),
{name} AS (SELECT g.site, g.ts, ghi, dhi, dni, cot, cp, temp, rain, oktas, n
  FROM {name}_g g LEFT JOIN {cells_name} c ON c.site = g.site AND c.ts = g.ts)"""


S10 = ",\n".join([OBS, cells_sql(), grid_sql()])
S1H = ",\n".join([OBS, cells_sql("1 HOUR", "c1h"), grid_sql("1 HOUR", "c1h", "s1h")])


def case_sql(attr: str) -> str:
    whens = " ".join(f"WHEN '{s.name}' THEN {getattr(s, attr)}::DOUBLE" for s in SITES)
    return f"CASE site {whens} END"


def elev_sql(ts: str = "ts") -> str:
    lat, lon, mer = case_sql("lat"), case_sql("lon"), case_sql("meridian")
    h = f"(extract(hour FROM {ts}) + extract(minute FROM {ts}) / 60.0::DOUBLE)"
    decl = f"radians(23.45::DOUBLE * sin(radians(360.0::DOUBLE * (284.0::DOUBLE + dayofyear({ts})) / 365.0::DOUBLE)))"
    ha = f"radians((({h} + 4.0::DOUBLE * ({lon} - {mer}) / 60.0::DOUBLE) - 12.0::DOUBLE) * 15.0::DOUBLE)"
    return (f"degrees(asin(least(greatest(sin(radians({lat})) * sin({decl}) + "
            f"cos(radians({lat})) * cos({decl}) * cos({ha}), -1.0::DOUBLE), 1.0::DOUBLE)))")


W = "OVER (PARTITION BY site ORDER BY ts)"


def frame(lo: int, hi: int) -> str:
    def end(k):
        return "CURRENT ROW" if k == 0 else (f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING")
    return f"OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN {end(lo)} AND {end(hi)})"


# Both engines round through the same floating-point steps; their own ``round``
# functions disagree on decimal ties, and 0.501 keeps such ties off the boundary.

def rsql(expr: str, digits: int = 6) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"floor(({expr}) * {scale} + 0.501::DOUBLE) / {scale}"


def rd(expr: str, alias: str, digits: int = 6) -> str:
    return f"{rsql(expr, digits)} AS {alias}"


def rcol(col: Column | str, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    scale = F.lit(float(10 ** digits))
    return F.floor(c * scale + F.lit(0.501)) / scale


def rc(col: Column | str, alias: str, digits: int = 6) -> Column:
    return rcol(col, digits).alias(alias)


def round_all(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    todo = set(cols)
    return df.select(*[rc(c, c, digits) if c in todo else F.col(c) for c in df.columns])
