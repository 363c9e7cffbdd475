import numpy as np
import pytest
from pyspark.sql import functions as F

from skycadence.operators import analogs
from skycadence.operators import modeling as md
from skycadence.operators.analogs import analog_ensemble, standardize


@pytest.mark.parametrize("blocks", [65_536, 3])
def test_analogs_equal_brute_force_with_many_copies(spark, monkeypatch, blocks):
    """Also where only the bounds of groups of blocks are held by the driver."""
    monkeypatch.setattr(analogs, "MAX_BLOCKS", blocks)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[100:200] = x[5]  # a third of the rows are copies of one vector
    x[:, 3] = 2.0  # constant dimension
    q = np.r_[rng.normal(size=(20, 6)), x[5:6], x[5:6] + 50]
    y = rng.normal(size=300)
    df = spark.createDataFrame([(int(i), [float(v) for v in r], float(t), False) for i, (r, t) in enumerate(zip(x, y))]
                               + [(int(1000 + i), [float(v) for v in r], None, True) for i, r in enumerate(q)], "id long, v array<double>, y double, is_q boolean")
    z = standardize(df, "v", ~F.col("is_q"))
    got = {r["qid"]: r for r in analog_ensemble(z.where("is_q"), z.where("NOT is_q"), qid="id", xid="id", vec="z", y="y", k=30, rows_per_block=16, tile=4).collect()}
    sd = x.std(axis=0)
    inv = np.where(sd == 0, 0, 1 / np.where(sd == 0, 1, sd))
    zx, zq = (x - x.mean(axis=0)) * inv, (q - x.mean(axis=0)) * inv
    assert len(got) == len(q)
    for i, v in enumerate(zq):
        d = np.sqrt(((zx - v) ** 2).sum(axis=1))
        near = np.lexsort((np.arange(300), np.round(d, 9)))[:30]
        r = got[1000 + i]
        assert r["n"] == 30
        assert abs(r["farthest"] - np.sort(d)[29]) < 1e-9
        if len(np.unique(np.round(d[near], 9))) == 30:
            assert abs(r["analog_mean"] - y[near].mean()) < 1e-9


def test_analogs_copy_no_query_where_all_blocks_are_open(spark, monkeypatch):
    """All rows lie about as far from the pivot, so it closes no block; a query is moved once, and tiles are bounded."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(700, 24)), rng.normal(size=(90, 24))
    x, q = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    y = rng.normal(size=700)
    rows = [(i, [float(v) for v in r], None if i % 9 == 0 else float(t), False) for i, (r, t) in enumerate(zip(x, y))]
    rows += [(1000 + i, [float(v) for v in r], None, True) for i, r in enumerate(q)] + [(1000, [float(v) for v in q[0]], None, True)]  # one query twice
    df = spark.createDataFrame(rows, "id long, v array<double>, y double, is_q boolean")
    moved, search, tiles, pack = [], analogs._search, spark.sparkContext.accumulator(0), analogs._pack_queries
    monkeypatch.setattr(analogs, "_search", lambda a, *rest: moved.append(a.count()) or search(a, *rest))

    def packed(part):
        assert len(part) <= 64
        tiles.add(1)
        return pack(part)
    monkeypatch.setattr(analogs, "_pack_queries", packed)
    found = analog_ensemble(df.where("is_q"), df.where("NOT is_q"), qid="id", xid="id", vec="v", y="y", k=30, rows_per_block=32, tile=16).collect()
    got = {r["qid"]: r for r in found}
    assert len(found) == len(got) == len(q) and sum(moved) == 91 and tiles.value > 3
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        near = np.argsort(d)[:15 if i == 0 else 30]  # the rows of a query that comes twice count twice
        r = got[1000 + i]
        assert r["n"] == 30 and abs(r["farthest"] - d[near].max()) < 1e-12
        assert abs(r["analog_mean"] - y[near][near % 9 != 0].mean()) < 1e-9


def _signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b, c = rng.normal(), rng.normal(), rng.normal()
        rows.append((float(a), float(b), float(c) if i % 7 else None, float(300 + 100 * a + 20 * b + rng.normal()), 300.0, "train" if i < 250 else "valid" if i < 320 else "test"))
    return spark.createDataFrame(rows, "a double, b double, c double, y double, now double, role string").withColumn("d", F.col("y") - F.col("now"))


def test_boosting_beats_persistence_and_is_clipped(spark):
    d = _signal(spark)
    m = md.fit_boosted(d, ["a", "b", "c"], "d", role="role", rounds=10, depth=3)
    p = md.predict(m, d.where("role = 'test'"), ["a", "b", "c"], "p", now="now", lo=150.0, hi=450.0)
    err = p.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("m"), F.avg(F.pow(F.col("now") - F.col("y"), 2)).alias("b"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert err["m"] < 0.5 * err["b"] and err["lo"] >= 150 and err["hi"] <= 450


def test_elimination_drops_noise_first(spark):
    d = _signal(spark)
    r = md.backward_elimination(d.where("role = 'train'"), d.where("role = 'valid'"), ["a", "b", "c"], "d", epsilon=0.02, rounds=5, depth=3).orderBy("step").collect()
    assert r[0]["n_features"] == 3 and r[1]["dropped"] == "c" and r[1]["accepted"]


def test_pca_components(spark):
    d = _signal(spark)
    curve = md.pca_curve(d, ["a", "b", "c"])
    assert abs(curve.agg(F.max("cumulative")).first()[0] - 1.0) < 1e-9
    assert {r["share"] for r in md.components_needed(curve).collect()} == {0.9, 0.95, 0.975, 0.99}


def test_regime_fallback_covers_every_row(spark):
    d = _signal(spark).withColumn("regime", F.when(F.col("a") > 0.5, "hi").when(F.col("a") > 0, "rare").otherwise(F.lit(None)))
    models = md.fit_regimes(d, ["a", "b"], "y", "regime", ["hi", "rare"], 100, fit=md.fit_ridge)
    assert set(models) == {"*", "hi"}
    assert md.predict_regimes(models, d, ["a", "b"], "regime", "p").where("p IS NOT NULL").count() == d.count()


def test_model_round_trip(spark, tmp_path):
    d = _signal(spark)
    m = md.fit_ridge(d, ["a", "b"], "y")
    md.save_model(spark, m, str(tmp_path), {"features": ["a", "b"]})
    again, meta = md.load_model(spark, str(tmp_path))
    assert meta["features"] == ["a", "b"]
    a = md.predict(m, d, ["a", "b"], "p").agg(F.sum("p")).first()[0]
    assert abs(md.predict(again, d, ["a", "b"], "p").agg(F.sum("p")).first()[0] - a) < 1e-9
