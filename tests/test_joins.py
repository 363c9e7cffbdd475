"""Boundary cases of the time joins, and agreement with pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, frame, minutes_series, rows
from skycadence.operators import temporal as tm

RIGHT = "site string, ts timestamp_ntz, id int, v double"


def right(spark, pts):
    return frame(spark, [("a", at(m), i, float(v)) for i, (m, v) in enumerate(pts)], RIGHT)


def test_asof_bounds(spark):
    left = minutes_series(spark, {100: 0.0, 164: 0.0, 165: 0.0, 166: 0.0})
    r = right(spark, [(100, 1)])
    def got(**k):
        return dict(rows(tm.asof_join(left, r, ["v"], **k), "ts", "v"))
    strict = got(tolerance_s=65 * 60, strict=True, width_s=3600)
    assert strict == {at(100): 1.0, at(164): 1.0, at(165): None, at(166): None}
    assert got(tolerance_s=65 * 60)[at(165)] == 1.0
    assert set(got().values()) == {1.0}


@pytest.mark.parametrize("tolerance", [None, 900, 7200])
def test_asof_matches_pandas(spark, tolerance):
    rng = random.Random(7)
    lm = sorted(rng.sample(range(0, 60_000), 300))
    rm = sorted(rng.sample(range(0, 60_000), 150))
    left = frame(spark, [("a", at(m / 10), float(m)) for m in lm], "site string, ts timestamp_ntz, x double")
    r = right(spark, [(m / 10, m) for m in rm])
    got = rows(tm.asof_join(left, r, ["v"], tolerance_s=tolerance, width_s=3600), "ts", "v", order=["ts"])
    assert got == rows(tm.asof_join(left, r, ["v"], tolerance_s=tolerance, width_s=36_000, rows_per_chunk=25), "ts", "v", order=["ts"])
    want = pd.merge_asof(pd.DataFrame({"ts": [at(m / 10) for m in lm]}), pd.DataFrame({"ts": [at(m / 10) for m in rm], "v": [float(m) for m in rm]}),
                         on="ts", tolerance=pd.Timedelta(seconds=tolerance) if tolerance else None)
    assert [v for _, v in got] == [None if pd.isna(v) else v for v in want["v"]]


def test_asof_keeps_null_values_of_the_latest_row(spark):
    r = frame(spark, [("a", at(0), 1, 5.0), ("a", at(10), 2, None)], RIGHT)
    left = minutes_series(spark, {12: 0.0})
    assert rows(tm.asof_join(left, r, ["v"], tolerance_s=3600), "v") == [(None,)]
    assert rows(tm.asof_join(left, r, ["v"]), "v") == [(None,)]


def test_asof_duplicate_times_use_tiebreak(spark):
    r = frame(spark, [("a", at(0), 1, 5.0), ("a", at(0), 2, 6.0)], RIGHT)
    assert rows(tm.asof_join(minutes_series(spark, {3: 0.0}), r, ["v"], tolerance_s=600, tiebreak=["id"]), "v") == [(6.0,)]


def test_nearest_ties_prefer_the_earlier(spark):
    r = right(spark, [(5, 1), (15, 2), (16, 3)])
    left = minutes_series(spark, {0: 0.0, 10: 0.0, 20: 0.0, 30: 0.0})
    want = [(at(0), 1.0), (at(10), 1.0), (at(20), 3.0), (at(30), None)]
    assert rows(tm.nearest_join(left, r, ["v"], tolerance_s=300), "ts", "v", order=["ts"]) == want
    grid = left.select("site", "ts").join(tm.nearest_per_slot(r, 600, 300, ["v"], tiebreak=["id"]), ["site", "ts"], "left")
    assert rows(grid, "ts", "v", order=["ts"]) == want


def test_interval_is_left_open_right_closed(spark):
    obs = right(spark, [(0, 1), (0.5, 2), (60, 4), (60.01, 8)])
    anchors = minutes_series(spark, {0: 0.0, 60: 0.0, 120: 0.0}).select("site", "ts")
    got = rows(tm.interval_agg(anchors, obs, 3600, [F.sum("v").alias("s")], step_s=3600), "ts", "s", order=["ts"])
    assert [s for _, s in got] == [1.0, 6.0, 8.0]


def test_lookup_needs_the_exact_time(spark):
    s = minutes_series(spark, {0: 1.0, 60: 2.0, 121: 3.0})
    assert rows(tm.lookup_at(s, 3600, {"x": "y"}), "ts", "y", order=["ts"]) == [(at(0), 2.0), (at(60), None), (at(121), None)]
