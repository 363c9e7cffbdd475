"""Queries over binning, grids, de-duplication and gap reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.functions import timeline as tl
from skycadence.operators import grid
from skycadence.operators.chunks import on_grid, series_bounds
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, W, cells, cells_sql, grid_sql, observations, rc, rd, reports,
                                       round_all, series)

MEASURES = ["ghi", "dhi", "dni", "cot", "temp", "rain", "oktas"]
_M = ", ".join(rd(c, c) for c in MEASURES)


@query("rsm_10min_bins", "RSM-1 RSM-2 AGG-1 AGG-6 AGG-7", f"WITH {OBS}, {cells_sql()} SELECT site, ts, {_M}, cp, n FROM c10")
def _(t: Tables):
    return round_all(cells(t), MEASURES).select("site", "ts", *MEASURES, "cp", "n")


@query("grd_10min_grid", "GRD-2 JN-2", f"WITH {S10} SELECT site, ts, {_M}, cp, n FROM s10")
def _(t: Tables):
    return round_all(series(t), MEASURES).select("site", "ts", *MEASURES, "cp", "n")


@query("grd_hourly_grid", "GRD-1 RSM-3 RSM-7", f"""WITH {OBS}, {cells_sql("1 HOUR", "h0", "right")},
h AS (SELECT * FROM h0 WHERE n >= 3), {grid_sql("1 HOUR", "h", "s")} SELECT site, ts, {_M}, n FROM s""")
def _(t: Tables):
    h = cells(t, 3600, side="right", min_n=3)
    g = on_grid([h], step_s=3600, bounds=series_bounds(h, 3600), chunk_steps=720)
    return round_all(g, MEASURES).select("site", "ts", *MEASURES, "n")


_DAILY_CTE = """d AS (SELECT l_returnflag AS site, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, avg(l_extendedprice) AS x
  FROM lineitem GROUP BY 1, 2),
g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY site)"""


def daily(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("site"), tl.day_start("l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("x"))


@query("grd_daily_grid", "GRD-3", f"WITH {_DAILY_CTE} SELECT g.site, g.ts, {rd('x', 'x', 4)} FROM g LEFT JOIN d USING (site, ts)")
def _(t: Tables):
    return round_all(grid.daily_grid(daily(t)), ["x"], 4).select("site", "ts", "x")


@query("grd_gap_histogram", "GRD-4 SRT-2", f"""WITH {OBS}, {cells_sql()},
g AS (SELECT site, epoch(ts - lag(ts) {W}) / 60.0::DOUBLE AS gap FROM c10)
SELECT site, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    return grid.gap_histogram(cells(t).select("site", "ts"))


@query("grd_top_gaps", "GRD-4 SRT-2", f"""WITH {OBS}, {cells_sql()},
g AS (SELECT site, epoch(ts - lag(ts) {W}) / 60.0::DOUBLE AS gap FROM c10)
SELECT site, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, site, gap LIMIT 10""")
def _(t: Tables):
    h = grid.gap_histogram(cells(t).select("site", "ts"))
    return h.orderBy(F.desc("n"), "site", "gap").limit(10)


@query("grd_missing_slots", "GRD-5", f"WITH {S10} SELECT site, ts FROM s10 WHERE n IS NULL")
def _(t: Tables):
    return grid.missing_slots(cells(t).select("site", "ts"), 600)


@query("rsm_right_label_hour", "RSM-3", f"""WITH {OBS} SELECT site, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts,
{rd('avg(value)', 'x')}, count(*) AS n FROM obs GROUP BY 1, 2""")
def _(t: Tables):
    return grid.resample(observations(t), 3600, [rc(F.avg("value"), "x"), F.count(F.lit(1)).alias("n")], side="right")


@query("rsm_left_label_hour_min_samples", "RSM-4 RSM-7", f"""WITH {OBS} SELECT site, date_trunc('hour', ts) AS ts,
{rd('avg(value)', 'x')} FROM obs GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(t: Tables):
    return grid.resample(observations(t), 3600, [rc(F.avg("value"), "x")], min_n=5)


@query("rsm_multi_width_bins", "RSM-5", f"WITH {OBS} " + " UNION ALL ".join(
    f"SELECT {h} AS hours, site, time_bucket(INTERVAL {h} HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(sum(value), 4) / count(*) AS x, count(*) AS n FROM obs GROUP BY 2, 3"
    for h in (1, 2, 3, 6)))
def _(t: Tables):
    # Wider bins are built from the hourly sums, so the raw rows shuffle once.
    hourly = grid.resample(observations(t), 3600, [F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")])
    wide = hourly.select("*", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3, 6)])).alias("hours"))
    us = tl.micros("ts")
    start = tl.from_micros(us - F.pmod(us, F.col("hours") * F.lit(3600 * tl.US).cast("long")))
    return wide.groupBy("hours", "site", start.alias("ts")).agg(
        (F.round(F.sum("s"), 4) / F.sum("n")).alias("x"), F.sum("n").alias("n"))


@query("rsm_point_sample", "RSM-6 AGG-4", f"""WITH {OBS} SELECT site, date_trunc('hour', ts) AS ts,
arg_min(value, ts) AS value, arg_min(event_type, ts) AS event_type FROM obs GROUP BY 1, 2""")
def _(t: Tables):
    return grid.point_sample(observations(t), 3600, ["value", "event_type"], tiebreak=["event_id"])


@query("rsm_downscaled_error", "RSM-8", f"""WITH {OBS}, {cells_sql()},
h AS (SELECT site, date_trunc('hour', ts) AS h, avg(ghi) AS y, avg(dni) AS p FROM c10 GROUP BY 1, 2)
SELECT site, count(*) AS n, {rd('avg(abs(y - p))', 'mae')}, {rd('sqrt(avg((y - p) * (y - p)))', 'rmse')} FROM h GROUP BY site""")
def _(t: Tables):
    h = grid.resample(cells(t), 3600, [F.avg("ghi").alias("y"), F.avg("dni").alias("p")])
    e = F.col("y") - F.col("p")
    return h.groupBy("site").agg(F.count(F.lit(1)).alias("n"), rc(F.avg(F.abs(e)), "mae"), rc(F.sqrt(F.avg(e * e)), "rmse"))


@query("rsm_daily_mean_spread", "RSM-9 JN-9", f"""WITH {S10}, d AS (SELECT site, CAST(ts AS DATE) AS day, avg(cot) AS cot_day
FROM c10 WHERE cp = 1 GROUP BY 1, 2) SELECT s.site, s.ts, {rd('cot_day', 'cot_day')} FROM s10 s
LEFT JOIN d ON d.site = s.site AND d.day = CAST(s.ts AS DATE)""")
def _(t: Tables):
    from skycadence.operators.temporal import period_join
    day = cells(t).where(F.col("cp") == 1).groupBy("site", F.to_date("ts").alias("day")).agg(F.avg("cot").alias("cot_day"))
    out = period_join(series(t), day, F.to_date("ts"), ["cot_day"], period_col="day")
    return out.select("site", "ts", rc(F.col("cot_day"), "cot_day"))


_RANK = {"R": 1, "A": 2, "N": 3}
_DEDUP = """r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 99 END,
    l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)"""


def _winners(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return grid.dedup_by_priority(li, "l_returnflag", _RANK, keys=["l_orderkey"],
                                  tiebreak=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("ddp_priority", "DDP-1 PRJ-2 WIN-11", f"WITH {_DEDUP} SELECT * EXCLUDE (rn) FROM r WHERE rn = 1")
def _(t: Tables):
    return _winners(t)


@query("ddp_residual_duplicates", "DDP-2", """SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t: Tables):
    return grid.duplicate_keys(t.lineitem, ["l_orderkey", "l_returnflag"])


@query("ddp_winner_sources", "DDP-3 AGG-11", f"WITH {_DEDUP} SELECT l_returnflag, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1")
def _(t: Tables):
    return grid.source_distribution(_winners(t), "l_returnflag")
