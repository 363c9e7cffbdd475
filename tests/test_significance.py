import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, frame
from skycadence.operators import significance as sg


def drawn(b, k, seed, choices):
    return int(hashlib.md5(f"{b}:{k}:{seed}".encode()).hexdigest()[:15], 16) % choices


def test_draws_cover_long_series(spark):
    """Starts reach the whole of a series of 1e12 rows, and no resample number is too large."""
    runs = spark.range(20_000).select(sg.draw(F.col("id") + F.lit(10 ** 15), F.lit(10 ** 12), 1, F.lit(10 ** 12).cast("long")).alias("s"))
    low, high, mean = runs.agg(F.min("s"), F.max("s"), F.avg("s")).first()
    assert low < 10 ** 9 and high > 10 ** 12 - 10 ** 9 and abs(mean / 10 ** 12 - 0.5) < 0.01


@pytest.mark.parametrize("level, part, n", [(100, 100_000, 103), (1e9, 20, 103), (100, 7, 9)])
def test_bootstrap_equals_direct_resampling(spark, monkeypatch, level, part, n):
    """Also around a level beside which the deviations are small, over many parts, and for a series shorter than a block."""
    monkeypatch.setattr(sg, "POSITIONS", part)
    rng = random.Random(2)
    block, B = 13, 25  # the last block is cut short
    y = [rng.gauss(level, 20) for _ in range(n)]
    p = {"a": [v + rng.gauss(0, 5) for v in y], "b": [v + rng.gauss(0, 9) for v in y]}
    df = frame(spark, [("s", at(10 * i), y[i], p["a"][i], p["b"][i]) for i in range(n)], "site string, ts timestamp_ntz, y double, a double, b double")
    boot = sg.block_bootstrap(df, "y", ["a", "b"], resamples=B, block=block, seed=9, width_s=3600)
    got = {r["b"]: (r["r2_a"], r["r2_b"]) for r in boot.collect()}
    block = min(block, n)
    nb = -(-n // block)
    for b in range(B):
        idx = np.concatenate([np.arange(s, s + block) for s in (drawn(b, k, 9, n - block + 1) for k in range(nb))])[:n]
        yy = np.array(y)[idx]
        for j, m in enumerate("ab"):
            e = yy - np.array(p[m])[idx]
            assert got[b][j] == pytest.approx(1 - (e @ e) / ((yy - yy.mean()) ** 2).sum(), abs=1e-6 if level > 1e6 else 1e-9)


def test_holm_stops_at_first_failure(spark):
    p = spark.createDataFrame([("s", "a", 0.001), ("s", "b", 0.04), ("s", "c", 0.045)], "site string, pair string, p double")
    assert {r["pair"]: r["holm_pass"] for r in sg.holm(p).collect()} == {"a": 1, "b": 0, "c": 0}
    assert {r["pair"]: r["holm_pass"] for r in sg.holm(p, step_down=False).collect()} == {"a": 1, "b": 0, "c": 1}


def test_conformal_carry_and_first_month(spark):
    data = []
    for month, n in ((1, 40), (2, 10), (4, 40), (5, 5)):  # March is absent
        for i in range(n):
            data.append(("s", dt.datetime(2024, month, 1) + dt.timedelta(hours=12 * i), float(i % 11) * month, 0.0, 5.0))
    df = frame(spark, data, "site string, ts timestamp_ntz, y double, lo double, hi double")
    got = {r["month"].month: (r["n_scores"], r["correction"]) for r in sg.rolling_corrections(df, "y", "lo", "hi").collect()}
    jan = [max(0 - v, v - 5) for v in [float(i % 11) for i in range(40)]]
    def q(scores):
        n = len(scores)
        return float(np.quantile(scores, min(np.ceil((n + 1) * 0.8) / n, 1.0)))
    assert got[1] == (0, 0.0)
    assert got[2] == (40, pytest.approx(q(jan)))
    used = [max(-r[2], r[2] - 5) for r in data if r[1].month < 4 and r[1] >= dt.datetime(2024, 4, 1) - dt.timedelta(days=60)]
    assert got[4][0] == len(used) == 10 and got[4][1] == pytest.approx(q(jan))  # too few scores: kept
    used = [max(-r[2], r[2] - 5) for r in data if r[1].month < 5 and r[1] >= dt.datetime(2024, 5, 1) - dt.timedelta(days=60)]
    assert got[5] == (len(used), pytest.approx(q(used)))
