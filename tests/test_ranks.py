import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from skycadence.operators.ranks import exact_quantiles, first_n, quantile_at, ranked_values, refined_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    data = {"copies": np.r_[np.full(400, 7.25), rng.normal(0, 1e-6, 300), rng.normal(1e9, 5, 300)],
            "mixed": np.r_[-rng.exponential(3, 200), [0.0] * 50, rng.exponential(100, 333)], "one": np.array([5.0]), "two": np.array([1.0, 2.0])}
    pd_rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    return data, spark.createDataFrame(pd_rows, "g string, x double").cache()


def test_quantiles_match_numpy(skewed):
    data, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 0.975, "f": 1.0}
    for r in exact_quantiles(df, "x", ["g"], probs, size="n").collect():
        want = np.quantile(data[r["g"]], list(probs.values()))
        assert r["n"] == len(data[r["g"]])
        np.testing.assert_allclose([r[p] for p in probs], want, rtol=1e-12, atol=1e-15)


def test_level_may_depend_on_size(skewed):
    data, df = skewed
    got = {r["g"]: r["q"] for r in quantile_at(df, "x", ["g"], {"q": lambda n: F.least(F.ceil((n + 1) * 0.8) / n, F.lit(1.0))}).collect()}
    for g, v in data.items():
        n = len(v)
        assert got[g] == pytest.approx(np.quantile(v, min(np.ceil((n + 1) * 0.8) / n, 1.0)), rel=1e-12)


def test_ranks_cover_every_row_once(skewed):
    data, df = skewed
    for g, lo, hi, n in rows(ranked_values(df, "x", ["g"]).groupBy("g").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.sum("_c").alias("n")), "g", "lo", "hi", "n"):
        assert (lo, hi, n) == (0, len(data[g]), len(data[g]))


def test_null_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    assert exact_quantiles(df, "x", (), {"m": 0.5}).first()["m"] == 2.0


def test_first_n_is_exact(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").alias("k"))
    got = sorted(r["k"] for r in first_n(df, (F.col("k") * 7919) % 100003, 37, ["g"]).collect())
    assert got == sorted(sorted(range(1000), key=lambda k: k * 7919 % 100003)[:37])


def test_null_keys_are_a_group_and_infinity_has_a_rank(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", float("inf")), ("x", float("-inf")), (None, 2.0), (None, 4.0)], "g string, x double")
    got = {r["g"]: (r["lo"], r["m"], r["hi"]) for r in exact_quantiles(df, "x", ["g"], {"lo": 0.0, "m": 0.5, "hi": 1.0}).where("g IS NULL OR true").collect()}
    assert got[None] == (2.0, 3.0, 4.0) and got["x"][1] == 1.0


def test_first_n_cuts_ties_by_key(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)] + [(k + 100, 1) for k in range(5)], "k long, o long").withColumn("g", F.lit(None).cast("string"))
    got = sorted(r["k"] for r in first_n(df, F.col("o"), 13, ["g"], tie=["k"]).collect())
    assert got == sorted([k for k in range(30) if k % 3 == 0] + [1, 4, 7])


def test_scrambled_keys_of_any_size(spark):
    from skycadence.operators.anchors import scrambled
    keys = [0, 1, 12345, 3_400_000_000, 3_500_000_000, (1 << 32) - 1, (1 << 32) + 1, 1 << 62, (1 << 63) - 1]
    got = [r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(scrambled("k", 7).alias("s")).collect()]
    assert all(0 <= s < 1 << 32 for s in got) and len(set(got)) == len(keys)
    assert got[:5] == [(k * 2654435761 + 7 * 40503) % (1 << 32) for k in keys[:5]]


def test_refined_quantiles_match_numpy(skewed, monkeypatch):
    from skycadence.operators import ranks
    data, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 0.975, "f": 1.0}
    for cells, few in ((65_536, 100_000), (3, 0)):
        monkeypatch.setattr(ranks, "CELLS", cells)
        monkeypatch.setattr(ranks, "FEW_TARGETS", few)
        got = refined_quantiles(df.union(df.sparkSession.createDataFrame([("none", None), ("none", float("nan")), (None, 4.0)], "g string, x double")), "x", ["g"], probs, size="n").collect()
        assert {r["g"] for r in got} == {*data, None}
        for r in got:
            v = data[r["g"]] if r["g"] else [4.0]
            assert r["n"] == len(v)
            np.testing.assert_allclose([r[p] for p in probs], np.quantile(v, list(probs.values())), rtol=1e-12, atol=1e-15)
    assert refined_quantiles(df.where("g = 'two'"), "x").first()["median"] == 1.5
    assert refined_quantiles(df.where("false"), "x").count() == 0


def test_close_values_are_counted_in_place_and_few_are_moved(spark):
    """A million distinct values inside one per cent: what is shuffled in the last pass is the parts around the ranks."""
    df = spark.range(1_000_000).select((F.lit(1000.0) + F.col("id") * F.lit(1e-5)).alias("x"))
    r = refined_quantiles(df, "x", (), {"a": 0.1, "b": 0.5, "c": 0.9}, size="n").first()
    assert r["n"] == 1_000_000
    np.testing.assert_allclose([r["a"], r["b"], r["c"]], [1000 + 0.999999 * 1, 1000 + 4.999995, 1000 + 8.999991], rtol=1e-12)
    held = []
    from skycadence.operators import ranks
    plain = ranks.materialize
    try:
        ranks.materialize = lambda d, stem: held.append((stem, plain(d, stem))) or held[-1][1]
        refined_quantiles(df, "x", (), {"a": 0.1}).collect()
    finally:
        ranks.materialize = plain
    tables = dict(held)
    assert tables["buckets"].count() < 20 and tables["cells"].agg(F.sum("_c")).first()[0] < 100  # of a million values
