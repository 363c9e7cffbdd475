"""Station description and the feature recipe."""

from __future__ import annotations

from dataclasses import dataclass, field

STEP_S = 600
HISTORY_STEPS = 18
HORIZON_STEPS = 6
VALID_MIN, VALID_MAX = 0.0, 1400.0
MIN_ELEVATION = 5.0


@dataclass(frozen=True)
class SiteSpec:
    """One station: position, canonical column mapping and usable years."""

    name: str
    lat: float
    lon: float
    meridian: float = 105.0
    columns: dict[str, str] = field(default_factory=dict)  # canonical -> source
    utc_shift_hours: int = 0
    first_year: int | None = None
    last_year: int | None = None


def per_site(specs, attr: str, site: str = "site") -> str:
    """SQL text giving the attribute of each row's station (NULL if unknown)."""
    whens = " ".join(f"WHEN '{s.name}' THEN {float(getattr(s, attr))!r}D" for s in specs)
    return f"CASE {site} {whens} END"


@dataclass(frozen=True)
class Entry:
    """One published column: its name, what it is made of, how, and over how many steps."""

    name: str
    source: str
    how: str
    steps: int


def _entries(text: str) -> list[Entry]:
    return [Entry(name, source, how, int(steps)) for name, source, how, steps in (line.split() for line in text.split("\n") if line.strip())]


# The published column names of the 50-feature recipe, in the published order. Users switch with
# models that are keyed by these names. name, source, transform, steps of 10 minutes.
RECIPE = _entries("""
ghi_now                  ghi    now     0
ghi_lag_10m              ghi    lag     1
ghi_lag_20m              ghi    lag     2
ghi_lag_30m              ghi    lag     3
ghi_lag_60m              ghi    lag     6
ghi_lag_120m             ghi    lag     12
ghi_lag_180m             ghi    lag     18
ghi_roll_30m_mean        ghi    mean    3
ghi_roll_30m_std         ghi    std     3
ghi_roll_60m_mean        ghi    mean    6
ghi_roll_60m_std         ghi    std     6
ghi_roll_180m_mean       ghi    mean    18
ghi_roll_180m_std        ghi    std     18
ghi_delta_10m            ghi    delta   1
ghi_delta_60m            ghi    delta   6
accel_ghi_20m            ghi    accel   1
kt_now                   kt     now     0
kt_lag_10m               kt     lag     1
kt_lag_20m               kt     lag     2
kt_lag_30m               kt     lag     3
kt_lag_60m               kt     lag     6
kt_roll30m_mean          kt     mean    3
kt_roll30m_std           kt     std     3
kt_roll60m_mean          kt     mean    6
accel_kt_20m             kt     accel   1
clp_cot                  cot    now     0
clp_cot_lag_10m          cot    lag     1
clp_cot_lag_20m          cot    lag     2
clp_cot_lag_30m          cot    lag     3
clp_cot_lag_60m          cot    lag     6
clp_cot_delta_10m        cot    delta   1
clp_cot_delta_30m        cot    delta   3
clp_cot_delta_60m        cot    delta   6
clp_cot_delta_180m       cot    apart   18
clp_cot_roll_180m_mean   cot    mean    18
accel_clp_cot_20m        cot    accel   1
clp_cth_m                cloud  now     0
clp_ctt_k                cloud  now     0
clp_cer                  cloud  now     0
clp_cloud_present        cloud  now     0
hour_sin                 clock  sin     0
hour_cos                 clock  cos     0
doy_sin                  clock  sin     0
doy_cos                  clock  cos     0
month_sin                clock  sin     0
month_cos                clock  cos     0
ghi_cs_t60               sky    ahead   6
elev_sin_t60             sky    ahead   6
smart_persist            sky    ahead   6
smart_persist_avg        sky    ahead   6
""")
FEATURES = [e.name for e in RECIPE]
LEVEL_FEATURES, RATIO_FEATURES, CLOUD_FEATURES, TIME_FEATURES, FUTURE_FEATURES = (
    [e.name for e in RECIPE if e.source in kinds] for kinds in (("ghi",), ("kt",), ("cot", "cloud"), ("clock",), ("sky",)))

# The published names of the wide table's measures. name, source, field, statistic of the 10-minute bin.
MEASURES = [tuple(line.split()) for line in """
ghi_now                   radiation  ghi        mean
dhi_now                   radiation  dhi        mean
dni_now                   radiation  dni        mean
reflected_now             radiation  reflected  mean
nett_rad_now              radiation  net        mean
solar_elev_deg            radiation  elevation  mean
asrs_n_obs_1min           radiation  ghi        rows
asrs_ok_obs               radiation  good       hits
aws_temp_c                weather    temp       mean
aws_temp_min_c            weather    temp       min
aws_temp_max_c            weather    temp       max
aws_rh_pct                weather    rh         mean
aws_pressure_hpa          weather    pressure   mean
aws_ws_avg                weather    ws         mean
aws_ws_max                weather    ws_max     max
aws_wd_deg                weather    wd         mean
aws_rain_mm               weather    rain       sum
aws_sr_avg_w_m2           weather    sr         mean
clp_cot                   cloud      cot        mean
clp_cth_m                 cloud      cth        mean
clp_ctt_k                 cloud      ctt        mean
clp_cer                   cloud      cer        mean
clp_cloud_present         cloud      present    any
clp_clear_flag            cloud      clear      any
clp_thin_cloud_flag       cloud      thin       any
clp_moderate_cloud_flag   cloud      moderate   any
clp_thick_cloud_flag      cloud      thick      any
synop_temp_c              report     temp       latest
synop_dewpoint_c          report     dewpoint   latest
synop_rh_pct              report     rh         latest
synop_wind_speed          report     wind       latest
synop_wind_dir_deg        report     wind_dir   latest
synop_visibility          report     visibility latest
synop_rainfall_24h_mm     report     rain24     latest
synop_solar_rad_24h       report     rad24      latest
""".split("\n") if line.strip()]
# The published names of the flags and states, by source, with the measure that shows the source is there.
SOURCES = {"radiation": ("has_asrs", "asrs_qc_status", "ghi_now"), "weather": ("has_aws", "aws_qc_status", "aws_temp_c"),
           "cloud": ("has_clp", "clp_qc_status", "clp_cot"), "report": ("has_synop", "synop_qc_status", "synop_temp_c")}
# The published names of the wide table's history and target columns.
HISTORY = _entries("""
observed_target_ts_wib    ts                lead   6
target_ghi_1h_ahead       ghi_now           lead   6
lag_10m_ts                ts                lag    1
lag_30m_ts                ts                lag    3
lag_60m_ts                ts                lag    6
lag_120m_ts               ts                lag    12
lag_180m_ts               ts                lag    18
ghi_lag_10m               ghi_now           lag    1
ghi_lag_30m               ghi_now           lag    3
ghi_lag_60m               ghi_now           lag    6
ghi_lag_120m              ghi_now           lag    12
ghi_lag_180m              ghi_now           lag    18
dhi_lag_60m               dhi_now           lag    6
dni_lag_60m               dni_now           lag    6
aws_temp_lag_60m          aws_temp_c        lag    6
aws_rh_lag_60m            aws_rh_pct        lag    6
aws_pressure_lag_60m      aws_pressure_hpa  lag    6
clp_cot_lag_60m           clp_cot           lag    6
clp_cth_lag_60m           clp_cth_m         lag    6
ghi_roll_30m_mean         ghi_now           mean   3
ghi_roll_30m_min          ghi_now           min    3
ghi_roll_30m_max          ghi_now           max    3
ghi_roll_30m_std          ghi_now           std    3
ghi_roll_60m_mean         ghi_now           mean   6
ghi_roll_60m_min          ghi_now           min    6
ghi_roll_60m_max          ghi_now           max    6
ghi_roll_60m_std          ghi_now           std    6
ghi_roll_180m_mean        ghi_now           mean   18
ghi_roll_180m_min         ghi_now           min    18
ghi_roll_180m_max         ghi_now           max    18
ghi_roll_180m_std         ghi_now           std    18
dhi_roll_180m_mean        dhi_now           mean   18
dni_roll_180m_mean        dni_now           mean   18
aws_temp_roll_180m_mean   aws_temp_c        mean   18
aws_rh_roll_180m_mean     aws_rh_pct        mean   18
aws_ws_roll_180m_mean     aws_ws_avg        mean   18
aws_rain_sum_180m         aws_rain_mm       sum    18
clp_cot_roll_180m_mean    clp_cot           mean   18
clp_cth_roll_180m_mean    clp_cth_m         mean   18
ghi_delta_10m             ghi_now           delta  1
ghi_delta_60m             ghi_now           delta  6
aws_temp_delta_60m        aws_temp_c        delta  6
aws_rh_delta_60m          aws_rh_pct        delta  6
""")

# Codes that stand for "no measurement".
SENTINELS = [9999.0, -9999.0, 999.0, -999.0, 99999.0, -99999.0]
