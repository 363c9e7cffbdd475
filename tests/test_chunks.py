"""Chunked windows must equal windows over whole series."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import at, frame, minutes_series, rows
from skycadence.operators.chunks import (carry_last, carry_next, halo_windows, on_grid, ordinal, row_windows, running_total,
                                         series_bounds)
from skycadence.operators.windows import lag, lead, rolling


@pytest.fixture(scope="module")
def irregular(spark):
    rng = random.Random(5)
    data = []
    for site, n in (("hot", 900), ("b", 60), ("c", 3)):
        m = 0.0
        for i in range(n):
            m += rng.choice([0.0, 0.5, 7, 10, 25, 4000]) if i % 50 == 0 else rng.choice([0.5, 7, 10, 25])
            data.append((site, at(m), i, None if rng.random() < 0.3 else float(rng.randint(0, 5))))
    df = frame(spark, data, "site string, ts timestamp_ntz, id int, x double")
    return df.cache()


ORD = ("ts", "id")


def whole(df):
    return Window.partitionBy("site").orderBy(*ORD)


def same(a, b, cols):
    assert rows(a, *cols) == rows(b, *cols)


def test_carry_last_equals_unbounded_window(irregular):
    w = whole(irregular)
    want = irregular.withColumn("y", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same(carry_last(irregular, {"y": F.col("x")}, width_s=1800, order=ORD), want, ["site", "id", "y"])
    want = irregular.withColumn("y", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same(carry_last(irregular, {"y": F.col("x")}, width_s=1800, order=ORD, include_current=False), want, ["site", "id", "y"])


def test_carry_next_equals_unbounded_window(irregular):
    want = irregular.withColumn("y", F.first("x", True).over(whole(irregular).rowsBetween(0, Window.unboundedFollowing)))
    same(carry_next(irregular, {"y": F.col("x")}, width_s=1800, order=ORD), want, ["site", "id", "y"])


def test_running_total_and_ordinal(irregular):
    w = whole(irregular)
    want = irregular.select("*", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("site")).alias("n"))
    same(ordinal(irregular, width_s=3600, order=ORD, name="i", total="n"), want, ["site", "id", "i", "n"])
    want = irregular.withColumn("s", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    same(running_total(irregular, {"s": F.col("x")}, width_s=3600, order=ORD), want, ["site", "id", "s"])


def test_overfull_chunks_are_cut_without_changing_results(irregular):
    from skycadence.operators.chunks import CHUNK, with_chunk
    burst = irregular.where("site = 'hot'").select("site", F.timestamp_add("SECOND", F.col("id"), F.expr("timestamp_ntz'2024-01-05'")).alias("ts"), F.col("id") + 10_000, "x").toDF("site", "ts", "id", "x")
    df = irregular.union(burst).cache()
    sizes = with_chunk(df, 86400, rows_per_chunk=100).groupBy("site", CHUNK).count()
    assert with_chunk(df, 86400).groupBy("site", CHUNK).count().agg(F.max("count")).first()[0] >= 900
    assert sizes.agg(F.max("count")).first()[0] <= 101
    w = whole(df)
    want = df.select("*", F.row_number().over(w).alias("i"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    same(ordinal(df, width_s=86400, order=ORD, name="i", rows_per_chunk=20), want, ["site", "id", "i"])
    same(carry_last(df, {"y": F.col("x")}, width_s=86400, order=ORD, rows_per_chunk=20), want, ["site", "id", "y"])
    got = row_windows(df, lambda d, v: d.withColumn("a", F.lag("x", 2).over(v)), back=2, rows_per_chunk=50, width_s=86400, order=ORD)
    same(got, df.withColumn("a", F.lag("x", 2).over(w)), ["site", "id", "a"])


def test_row_windows_across_chunks(irregular):
    def f(d, w):
        return d.select("*", F.lag("x", 3).over(w).alias("a"), F.lead("x", 2).over(w).alias("b"))
    got = row_windows(irregular, f, back=3, ahead=2, rows_per_chunk=7, width_s=3600, order=ORD)
    same(got, f(irregular, whole(irregular)), ["site", "id", "a", "b"])


def test_grid_windows_equal_unchunked(spark):
    rng = random.Random(1)
    data = {m: float(rng.randint(0, 9)) for m in range(0, 30_000, 10) if rng.random() > 0.2}
    data[0] = 1.0
    s = minutes_series(spark, data)
    def f(g, w):
        return g.select("*", lag("x", 18, w).alias("l"), lead("x", 6, w).alias("f"), rolling("x", 18, "mean", w, min_periods=9).alias("m"))
    cols = ["ts", "x", "l", "f", "m"]
    b = series_bounds(s, 600)
    small = on_grid([s], f, step_s=600, bounds=b, back=18, ahead=6, chunk_steps=50)
    large = on_grid([s], f, step_s=600, bounds=b, back=18, ahead=6, chunk_steps=1_000_000)
    assert small.count() == (max(data) - 0) // 10 + 1
    same(small, large, cols)


def test_grid_ignores_rows_outside_its_bounds(spark):
    from skycadence.functions.timeline import micros
    s = minutes_series(spark, {m: float(m) for m in range(0, 200, 10)})
    b = spark.createDataFrame([("a", at(50), at(100))], "site string, lo timestamp_ntz, hi timestamp_ntz").select("site", micros("lo").alias("_lo"), micros("hi").alias("_hi"))
    g = on_grid([s], lambda d, w: d.withColumn("n", lead("x", 1, w)), step_s=600, bounds=b, ahead=1, chunk_steps=4)
    assert rows(g, "x", "n", order=["ts"]) == [(50.0, 60.0), (60.0, 70.0), (70.0, 80.0), (80.0, 90.0), (90.0, 100.0), (100.0, None)]


def test_halo_windows_time_reach(spark):
    s = minutes_series(spark, {m: float(m) for m in range(0, 5000, 10)})
    def f(g, w):
        return g.withColumn("l", F.lag("x", 6).over(w))
    got = halo_windows(s, f, width_s=7200, back_s=3600)
    want = f(s, Window.partitionBy("site").orderBy("ts"))
    same(got, want, ["ts", "l"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4000), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=40, unique_by=lambda x: x[0]))
def test_carry_property(spark, points):
    df = frame(spark, [("a", at(m), v) for m, v in points], "site string, ts timestamp_ntz, x int")
    got = dict(rows(carry_last(df, {"y": F.col("x")}, width_s=3600), "ts", "y"))
    last = None
    for m, v in sorted(points):
        last = v if v is not None else last
        assert got[at(m)] == last


def test_no_feature_sees_the_future(spark):
    base = {m: float(m % 70) for m in range(0, 3000, 10)}
    changed = {m: (v if m <= 2000 else v + 999) for m, v in base.items()}
    def f(g, w):
        return g.select("*", lag("x", 3, w).alias("a"), rolling("x", 6, "std", w).alias("b"), rolling("x", 18, "mean", w).alias("c"))
    def run(d):
        s = minutes_series(spark, d)
        g = on_grid([s], f, step_s=600, bounds=series_bounds(s, 600), back=18, chunk_steps=40)
        return rows(g.where(F.col("ts") <= F.lit(at(2000))), "ts", "x", "a", "b", "c")
    assert run(base) == run(changed)
