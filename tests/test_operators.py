"""Micro-frames with hand-computed results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from helpers import T0, at, frame, minutes_series, rows
from skycadence.functions import exprs as ex
from skycadence.functions import solar as so
from skycadence.functions import timeline as tl
from skycadence.functions.weather import sky_flags
from skycadence.operators import anchors as an
from skycadence.operators import evaluate as ev
from skycadence.operators import grid, impute, quality
from skycadence.operators import windows as wn
from skycadence.operators.chunks import on_grid, series_bounds


def gridded(s, f, back=0, ahead=0):
    return on_grid([s], f, step_s=600, bounds=series_bounds(s, 600), back=back, ahead=ahead, chunk_steps=10)


def test_priority_ties_and_ranks(spark):
    df = frame(spark, [("a", at(0), "z", 1, 1.0), ("a", at(0), "good", 9, 2.0), ("a", at(0), "good", 3, 3.0), ("a", at(10), "odd", 1, 4.0)],
               "site string, ts timestamp_ntz, src string, id int, x double")
    got = grid.dedup_by_priority(df, "src", {"good": 1, "z": 2}, tiebreak=["id"])
    assert rows(got, "ts", "src", "x", order=["ts"]) == [(at(0), "good", 3.0), (at(10), "odd", 4.0)]


def test_right_label_puts_the_full_hour_into_the_next(spark):
    s = minutes_series(spark, {59: 1.0, 60: 5.0, 61: 7.0})
    got = grid.resample(s, 3600, [F.sum("x").alias("x")], side="right")
    assert rows(got, "ts", "x", order=["ts"]) == [(at(60), 1.0), (at(120), 12.0)]
    closed = grid.interval_bins(s, 3600, [F.sum("x").alias("x")])
    assert rows(closed, "ts", "x", order=["ts"]) == [(at(60), 6.0), (at(120), 7.0)]


def test_missing_slots_and_gaps(spark):
    s = minutes_series(spark, {0: 1.0, 10: 1.0, 40: 1.0})
    assert [r[0] for r in rows(grid.missing_slots(s, 600), "ts")] == [at(20), at(30)]
    assert rows(grid.gap_histogram(s), "gap", "n") == [(10.0, 1), (30.0, 1)]


def test_times_before_1970_floor_down(spark):
    df = frame(spark, [(dt.datetime(1969, 12, 31, 23, 55),)], "ts timestamp_ntz")
    assert df.select(tl.floor_to("ts", 600)).first()[0] == dt.datetime(1969, 12, 31, 23, 50)


def test_bins_do_not_depend_on_the_session_zone(spark):
    df = frame(spark, [(dt.datetime(2024, 3, 10, 2, 35),)], "ts timestamp_ntz")  # inside a US clock change
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(tl.floor_to("ts", 600)).first()[0] == dt.datetime(2024, 3, 10, 2, 30)
        assert df.select(tl.as_wall(tl.as_instant("ts"))).first()[0] == dt.datetime(2024, 3, 10, 2, 35)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_guarded_lag_across_a_gap(spark):
    s = minutes_series(spark, {m: float(m) for m in (*range(0, 100, 10), *range(110, 200, 10))})
    from pyspark.sql import Window
    w = Window.partitionBy("site").orderBy("ts")
    g = s.select("ts", wn.lag("x", 1, w).alias("plain"), wn.guarded_lag("x", 1, w, step_s=600, tolerance_s=90).alias("safe"))
    r = {t: (p, q) for t, p, q in rows(g, "ts", "plain", "safe")}
    assert r[at(110)] == (90.0, None) and r[at(50)] == (40.0, 40.0)


def test_rolling_null_rules(spark):
    s = minutes_series(spark, {0: 1.0, 10: None, 20: 3.0, 30: 5.0})
    g = gridded(s, lambda d, w: d.select("*", wn.rolling("x", 3, "mean", w, min_periods=2).alias("two"), wn.rolling("x", 3, "mean", w, min_periods=3).alias("full"),
                                         wn.rolling("x", 3, "mean", w, min_periods=2, skip_current=True).alias("past"), wn.rolling_std_or_zero("x", 2, w).alias("sd")), back=3)
    assert rows(g, "two", "full", "past", order=["ts"]) == [(None, None, None), (None, None, None), (2.0, None, None), (4.0, None, 2.0)]
    assert [r[0] for r in rows(g, "sd", order=["ts"])][:3] == [0.0, 0.0, 0.0]


def test_runs_zero_and_null(spark):
    vals = [1.0] * 5 + [2.0] * 6 + [0.0] * 8 + [None] + [3.0] * 7 + [3.0, None, 3.0]
    s = minutes_series(spark, {i * 10: v for i, v in enumerate(vals)})
    r = quality.run_lengths(s, "x", width_s=1800)
    assert sorted(((v, n) for v, n in rows(r, "value", "n")), key=str) == sorted([(1.0, 5), (2.0, 6), (0.0, 8), (None, 1), (3.0, 8), (None, 1), (3.0, 1)], key=str)
    rep = quality.stuck_report(s, ["x"], 6, width_s=1800).first()
    assert (rep["stuck_n"], rep["n_nonnull"]) == (14, 28)


def test_elevation_known_values(spark):
    df = frame(spark, [(dt.datetime(2023, 3, 22, 12, 0),), (dt.datetime(2023, 3, 22, 6, 0),), (dt.datetime(2024, 2, 29, 12, 0),), (dt.datetime(2024, 12, 31, 0, 0),), (None,)], "ts timestamp_ntz")
    e = [r[0] for r in df.select(so.elevation_deg("ts", 0.0, 105.0)).collect()]
    assert e[0] == pytest.approx(90.0, abs=0.5) and e[1] == pytest.approx(0.0, abs=0.5)
    assert 75 < e[2] < 90 and e[3] < -50 and e[4] is None
    cs = [r[0] for r in df.withColumn("e", so.elevation_deg("ts", 0.0, 105.0)).select(so.clear_sky("e")).collect()]
    assert cs[3] == 0.0 and cs[0] == pytest.approx(1100, abs=1) and cs[4] is None


def test_elevation_formula(spark):
    when = dt.datetime(2024, 7, 9, 15, 40)
    lat, lon = -3.86, 102.34
    doy = when.timetuple().tm_yday
    decl = math.radians(23.45 * math.sin(math.radians(360 * (284 + doy) / 365)))
    h = math.radians((15 + 40 / 60 + 4 * (lon - 105) / 60 - 12) * 15)
    want = math.degrees(math.asin(math.sin(math.radians(lat)) * math.sin(decl) + math.cos(math.radians(lat)) * math.cos(decl) * math.cos(h)))
    df = frame(spark, [(when - dt.timedelta(hours=1),)], "ts timestamp_ntz")
    assert df.select(so.elevation_deg("ts", lat, lon, ahead_s=3600)).first()[0] == pytest.approx(want, abs=1e-9)


def test_clips_keep_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x double")
    assert [tuple(r) for r in df.select(ex.clip("x", 0.0, 3.0), ex.floor_at("x", 0.0), ex.inside("x", 0, 9)).collect()] == [(None, None, False), (0.0, 0.0, False), (3.0, 5.0, True)]


def test_fractional_oktas_have_a_class(spark):
    df = spark.createDataFrame([(2.5,), (5.5,), (7.5,), (8.0,), (2.0,)], "o double")
    assert all(sum(r) == 1 for r in df.select(*sky_flags("o")).collect())


def test_regime_bounds(spark):
    df = spark.createDataFrame([(0.99, 1), (1.0, 1), (7.99, 0), (8.0, 1), (None, 0), (None, 1)], "c double, p int")
    assert [r[0] for r in df.select(ev.cloud_regime("c", "p")).collect()] == ["clear", "partly", "partly", "overcast", "clear", "partly"]


def test_bounded_fill(spark):
    s = minutes_series(spark, {0: 1.0, 10: None, 20: None, 30: None, 40: None, 50: None, 60: 7.0})
    g = gridded(s, lambda d, w: impute.bounded_fill(d, "x", w, 3, 1), back=4, ahead=1)
    assert [r[0] for r in rows(g, "x_clean", order=["ts"])] == [1.0, 1.0, 1.0, 1.0, None, 7.0, 7.0]


def test_diffuse_repair(spark):
    vals = [(100.0, 50.0), (100.0, 30.0), (100.0, 160.0), (0.0, 5.0), (50.0, 20.0)]
    df = frame(spark, [("a", at(i * 10), g, d, 45.0) for i, (g, d) in enumerate(vals)], "site string, ts timestamp_ntz, ghi double, dhi double, elev double")
    got = rows(quality.repair_diffuse(df, "elev"), "dhi", "corrected", order=["ts"])
    assert got == [(50.0, False), (30.0, False), (40.0, True), (0.0, True), (20.0, False)]


def test_diffuse_repair_without_clean_cell_uses_series_median(spark):
    df = frame(spark, [("a", at(0), 100.0, 30.0, 45.0), ("a", at(10), 100.0, 150.0, 85.0)], "site string, ts timestamp_ntz, ghi double, dhi double, elev double")
    assert rows(quality.repair_diffuse(df, "elev"), "dhi", order=["ts"]) == [(30.0,), (30.0,)]


def test_anchor_around_a_gap(spark):
    present = [m for m in range(0, 500, 10) if m not in (250, 260)]
    s = minutes_series(spark, {m: 100.0 for m in present}).withColumnRenamed("x", "ghi").withColumn("n", F.lit(1))
    rule = an.AnchorRule(min_elev=None)
    g = gridded(s, lambda d, w: d.withColumn("ok", an.is_anchor(rule, w, None)), back=18, ahead=6)
    ok = [r[0] for r in rows(g.where("ok"), "ts", order=["ts"])]
    assert ok == [at(180)]  # 180 sees 0..180 behind and 190..240 ahead; 190 would need 250
    back = an.AnchorRule(min_elev=None, check_future=False, target_in_range=False)
    g = gridded(s, lambda d, w: d.withColumn("ok", an.is_anchor(back, w, None)), back=18, ahead=6)
    assert [r[0] for r in rows(g.where("ok"), "ts", order=["ts"])] == [at(m) for m in (*range(180, 250, 10), *range(450, 500, 10))]


def test_segments_split_on_gap_and_date(spark):
    s = minutes_series(spark, {0: 1.0, 10: 1.0, 25: 1.0, 1430: 1.0, 1440: 1.0})
    assert [r[0] for r in rows(an.segments(s, 720, width_s=3600), "seg", order=["ts"])] == [0, 0, 1, 2, 3]
    assert [r[0] for r in rows(an.segments(s, 900, split_on_date=False), "seg", order=["ts"])] == [0, 0, 0, 1, 1]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 3.0, 1.0), (5.0, 4.0, 5.0), (None, 1.0, 1.0)], "y double, p double, b double")
    r = ev.metrics(df, "y", ["p"], base="b").first()
    assert r["n"] == 3 and r["r2"] == pytest.approx(1 - 2 / 8) and r["mae"] == pytest.approx(2 / 3) and r["mbe"] == pytest.approx(0.0)
    assert r["skill_rmse"] == pytest.approx(1 - math.sqrt(2 / 8)) and r["skill_mse"] == pytest.approx(1 - 2 / 8)


def test_blend_grid_equals_direct(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (3.0, 3.5, 1.0), (5.0, 4.0, 5.5)], "y double, a double, b double")
    for w, rmse in rows(ev.blend_grid(df, "y", "a", "b", [0.0, 0.3, 1.0]), "weight", "rmse"):
        want = math.sqrt(sum((w * a + (1 - w) * b - y) ** 2 for y, a, b in [(1, 2, 0), (3, 3.5, 1), (5, 4, 5.5)]) / 3)
        assert rmse == pytest.approx(want)


def test_walk_forward_roles(spark):
    df = frame(spark, [(i, dt.datetime(2022, 9, 1) + dt.timedelta(days=30 * i)) for i in range(30)], "id int, ts timestamp_ntz")
    f = an.folds_by_date(df, [("2023-01-01", "2023-07-01"), ("2024-01-01", None)])
    by = {(r["fold"], r["role"]): r["n"] for r in f.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert by[(1, "test")] == 6 and by[(1, "stop")] == 4 and by[(1, "train")] == 1  # Oct 1 is the cut itself
    assert by[(2, "train")] + by[(2, "stop")] + by[(2, "test")] == 30
