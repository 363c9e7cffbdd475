"""Fits from sums, boosting with shared scans and ordered encodings, against plain numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from skycadence.operators import boosting as bo
from skycadence.operators import sums as sm
from skycadence.operators.encoding import ordered_target_mean

FEATS = list("abcdef")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 900
    x = rng.normal(size=(n, 6)) * [1, 50, .1, 3, 1, 1] + [0, 1000, 0, 5, 0, 7]
    x[:, 5] = 7  # constant
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf["t"] = 3 * x[:, 0] + .02 * x[:, 1] + rng.normal(size=n)
    pdf["g"] = np.where(rng.random(n) < .3, "p", np.where(rng.random(n) < .9, "q", None))
    pdf["block"] = rng.integers(0, 4, n).astype("int32")
    pdf["season"] = np.where(rng.random(n) < .05, "rare", "often")
    pdf.loc[::9, "d"] = np.nan
    pdf.loc[5, "t"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g").isin("p", "q"), F.col("g")))
    return pdf, df.withColumn("d", F.when(~F.isnan("d"), F.col("d"))).repartition(5).cache()


def dense(pdf, centre):
    z = pdf[FEATS].astype(float).copy()
    flag = z["d"].isna().astype(float)
    z["d"] = z["d"].fillna(centre["d"])
    return np.column_stack([z.values, flag])


def ridge(x, y, alpha):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    ok = sd > 1e-9
    w = (x - mean)[:, ok] / sd[ok]
    b = np.zeros(x.shape[1])
    b[ok] = np.linalg.solve(w.T @ w + alpha * np.eye(ok.sum()), w.T @ (y - y.mean())) / sd[ok]
    return b, y.mean() - b @ mean


def test_fits_of_every_group_equal_numpy(table):
    pdf, df = table
    centre = sm.pivots(df, FEATS)
    s = sm.sums(df, FEATS, "t", ["g", "block"], nullable=["d"], centre=centre).cache()
    got = {r["g"]: r for r in sm.fits(sm.merged(s, ["g"]), FEATS, ["g"], nullable=["d"], alpha=2.0).collect()}
    known = pdf[pdf.t.notna()]
    assert set(got) == {"p", "q", None}
    for g, r in got.items():
        mine = known[known.g == g] if g else known[~known.g.isin(["p", "q"])]
        b, _ = ridge(dense(mine, centre), mine.t.values, 2.0)
        assert r["n"] == len(mine) and np.allclose(r["coefficients"], b, atol=1e-9)
    whole = sm.fits(sm.merged(s), FEATS, nullable=["d"], alpha=2.0).first()
    b, b0 = ridge(dense(known, centre), known.t.values, 2.0)
    shifted = b0 + b[:6] @ [centre[f] for f in FEATS]
    assert np.allclose(whole["coefficients"], b, atol=1e-9) and abs(whole["intercept"] - shifted) < 1e-6


def test_walk_forward_scores_need_no_rows(table):
    pdf, df = table
    centre = sm.pivots(df, FEATS)
    train, held = sm.walk_forward(sm.sums(df, FEATS, "t", ["block"], nullable=["d"], centre=centre), "block", 3)
    got = {(r["fold"], r["subset"]): r for r in sm.subset_scores(train, held, FEATS, {"two": ["a", "b"], "all": FEATS}, ["fold"], nullable=["d"]).collect()}
    known = pdf[pdf.t.notna()]
    for fold in (1, 2, 3):
        tr, te = known[known.block < fold], known[known.block == fold]
        for name, cols in (("two", [0, 1]), ("all", list(range(7)))):
            b, b0 = ridge(dense(tr, centre)[:, cols], tr.t.values, 1.0)
            e = te.t.values - b0 - dense(te, centre)[:, cols] @ b
            want = 1 - (e ** 2).sum() / ((te.t - te.t.mean()) ** 2).sum()
            r = got[fold, name]
            assert abs(r["r2"] - want) < 1e-8 and (r["n_train"], r["n_held"]) == (len(tr), len(te))


def test_eliminations_equal_refits(table):
    pdf, df = table
    centre = sm.pivots(df, FEATS)
    s = sm.sums(df, FEATS, "t", ["block"], nullable=["d"], centre=centre)
    train, held = sm.merged(s.where("block < 2")), sm.merged(s.where("block >= 2"))
    known = pdf[pdf.t.notna()]
    tr, te = known[known.block < 2], known[known.block >= 2]

    def score(names):
        cols = [FEATS.index(f) for f in names] + ([6] if "d" in names else [])
        b, b0 = ridge(dense(tr, centre)[:, cols], tr.t.values, 1.0)
        e = te.t.values - b0 - dense(te, centre)[:, cols] @ b
        return 1 - (e ** 2).sum() / ((te.t - te.t.mean()) ** 2).sum()
    for every in (True, False):
        steps = sm.eliminate(train, held, FEATS, every=every, nullable=["d"], tolerance=0.002).orderBy("step").collect()
        keep = list(FEATS)
        assert len(steps) > 2
        for r in steps:
            if r["dropped"]:
                if every:
                    assert abs(max(score([x for x in keep if x != f]) for f in keep) - r["r2"]) < 1e-8
                keep.remove(r["dropped"])
            assert r["n_features"] == len(keep) and abs(score(keep) - r["r2"]) < 1e-8
        assert set("ab") <= set(keep) or not steps[-1]["accepted"]
    one = {r["feature"]: r for r in sm.add_one(train, held, ["a"], ["b", "c", "d"], nullable=["d"]).collect()}
    assert all(abs(one[f]["r2"] - score(["a", f])) < 1e-8 and abs(one[f]["r2_base"] - score(["a"])) < 1e-8 for f in "bcd")
    top = sm.topk_sweep(train, held, FEATS, [1, 2, 4], nullable=["d"]).orderBy("k").collect()
    assert [r["k"] for r in top] == [1, 2, 4, 6] and sum(r["chosen"] for r in top) == 1


def test_season_models_and_their_fallback(table):
    _, df = table
    d = df.where("t = t AND g IS NOT NULL").withColumn("season", F.when(F.col("season") == "often", "often").when(F.col("a") > 0, "rare"))
    s = sm.sums(d, ["a"], "t", ["g", "season"])
    p = sm.group_models(d, s, ["a"], "season", "p", ["g"], min_rows=60)
    n = {(r["g"], r["season"]): (r["n"], r["m"], r["k"]) for r in p.groupBy("g", "season").agg(F.count("*").alias("n"), F.min("p_model").alias("m"), F.count("p").alias("k")).collect()}
    assert sum(v[0] for v in n.values()) == d.count() and all(v[0] == v[2] for v in n.values())
    assert {k[1]: v[1] for k, v in n.items()} == {"often": "often", "rare": "*", None: "*"}


def test_poisson_weights_are_draws_and_weigh_the_sums(spark, table):
    pdf, df = table
    w = df.withColumn("w", sm.poisson_weights(["a", "b"], 3)).cache()
    stats = w.select(F.posexplode("w").alias("seed", "n")).groupBy("seed").agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).collect()
    assert len(stats) == 3 and all(abs(r["m"] - 1) < 0.15 and abs(r["v"] - 1) < 0.25 for r in stats)
    s = {(r["seed"], r["i"], r["j"]): r["s"] for r in sm.sums(w, ["a"], "t", weights="w").collect()}
    for seed in range(3):
        repeated = w.where("t = t").select("a", "t", F.explode(F.expr(f"array_repeat(1, w[{seed}])"))).toPandas()
        assert s[seed, "1", "1"] == len(repeated) and abs(s[seed, "a", "y"] - (repeated.a * repeated.t).sum()) < 1e-6


def test_sums_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, a double, t double")
    s = sm.sums(empty, ["a"], "t", ["g"])
    assert s.count() == 0 and sm.fits(s, ["a"], ["g"]).count() == 0


# boosting

def signal(spark, n=1500):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["y"] = 300 + 100 * np.sin(2 * x[:, 0]) + 50 * (x[:, 1] > 0) + 20 * rng.normal(size=n) * (1 + (x[:, 2] > 0))
    pdf["role"] = np.where(rng.random(n) < .6, "train", np.where(rng.random(n) < .5, "stop", "test"))
    pdf["now"] = 280.0
    pdf["d_y"] = pdf.y - 280
    pdf.loc[::11, "c"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4)


def brute_tree(x, g, depth, least, shrink):
    """Greedy tree on binned columns: leaf number and leaf value of each row."""
    leaf = np.zeros(len(x), int)
    for _ in range(depth):
        new = leaf * 2
        for node in np.unique(leaf):
            mine = leaf == node
            best = None
            for f in range(x.shape[1]):
                for cut in np.unique(x[mine, f]):
                    left = mine & (x[:, f] <= cut)
                    nl, nr = left.sum(), mine.sum() - left.sum()
                    if nl < least or nr < least:
                        continue
                    gl, gt = g[left].sum(), g[mine].sum()
                    gain = gl ** 2 / (nl + shrink) + (gt - gl) ** 2 / (nr + shrink) - gt ** 2 / (mine.sum() + shrink)
                    if gain > 0 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
            if best:
                new[mine & (x[:, best[1]] > best[2])] += 1
        leaf = new
    return leaf


def test_first_trees_equal_a_plain_tree(spark):
    pdf, df = signal(spark, 600)
    run = bo.Forest(df, [bo.Arm("m", "y", tuple("abcd"), rounds=2, rate=0.5), bo.Arm("q", "y", tuple("abcd"), level=0.9, rounds=2, rate=0.5)], bins=8)
    while run.round():
        pass
    train = pdf[pdf.role == "train"]
    x = np.column_stack([np.where(train[f].isna(), 0, np.searchsorted(run.edges[f], train[f], "left") + 1) for f in run.features])
    for fit, level in zip(run.fits, (None, 0.9)):
        p = np.full(len(train), train.y.mean() if level is None else np.quantile(train.y, level))
        assert abs(fit.base - p[0]) < 1e-9
        for tree in fit.trees:
            r = train.y.values - p
            leaf = brute_tree(x, r if level is None else np.where(r > 0, level, level - 1), 3, 5, 1.0)
            for k in np.unique(leaf):
                mine = leaf == k
                want = 0.5 * (r[mine].sum() / (mine.sum() + 1) if level is None else np.quantile(r[mine], level))
                got = np.array(tree.value)[tree.leaves(x[mine])]
                assert np.allclose(got, want, atol=1e-9)
                p[mine] += got


def test_arms_share_a_run_and_beat_their_base(spark, tmp_path):
    pdf, df = signal(spark)
    feats = tuple("abcd")
    arms = [bo.Arm("direct", "y", feats, rounds=25), bo.Arm("residual", "d_y", feats, rounds=12, rate=0.2, depth=2), bo.Arm("none", "y", feats, role="nobody"),
            *[bo.Arm(n, "y", feats, level=v, rounds=12, rate=0.3) for n, v in (("p10", .1), ("p50", .5), ("p90", .9))]]
    d = df.withColumn("nobody", F.lit(None).cast("string"))
    models = {m["arm"]["name"]: m for m in bo.fit_arms(d, arms)}
    alone = bo.fit_arms(d, [arms[1]])[0]
    both = list(zip(alone["trees"], models["residual"]["trees"], strict=True))  # an arm does not see the others
    assert all(a["feature"] == b["feature"] and np.allclose(a["value"], b["value"]) for a, b in both)
    bo.save(spark, models, str(tmp_path / "m"))
    test = df.where("role = 'test'")
    p = bo.predict(test, bo.load(spark, str(tmp_path / "m")), now={"residual": "now"})
    p = p.select("y", "direct", "residual", *bo.uncrossed(["p10", "p50", "p90"])).toPandas()
    spread = ((p.y - p.y.mean()) ** 2).mean()
    assert len(p) == (pdf.role == "test").sum()
    assert all(((p.y - p[c]) ** 2).mean() < 0.3 * spread for c in ("direct", "residual", "p50"))
    assert ((p.p10 <= p.p50) & (p.p50 <= p.p90)).all() and 0.65 < ((p.y >= p.p10) & (p.y <= p.p90)).mean() < 0.95
    for name, level in (("p10", .1), ("p50", .5), ("p90", .9)):
        def loss(q, level=level):
            return np.maximum((p.y - q) * level, (p.y - q) * (level - 1)).mean()
        assert loss(p[name]) < 0.7 * loss(models[name]["base"])
    assert models["none"]["trees"] == [] and models["none"]["base"] is None
    top = [r["feature"] for r in bo.importance(spark, models["direct"]).orderBy("rank").collect()]
    assert top[0] == "a" and len(top) == 4


def test_refresh_changes_nothing(spark, monkeypatch):
    _, df = signal(spark, 400)
    arm = [bo.Arm("m", "y", tuple("abcd"), rounds=6)]
    long = bo.fit_arms(df, arm)[0]
    monkeypatch.setattr(bo, "REFRESH", 2)
    short = bo.fit_arms(df, arm)[0]
    assert [t["feature"] for t in long["trees"]] == [t["feature"] for t in short["trees"]]
    assert np.allclose([t["value"] for t in long["trees"]], [t["value"] for t in short["trees"]])


def test_race_finds_the_trial_of_the_full_search(spark):
    _, df = signal(spark, 800)
    arms = [bo.Arm(f"t{k}", "y", tuple("abcd"), rounds=8, patience=99, **p) for k, p in enumerate(bo.draws({"depth": [1, 2, 3], "rate": [.02, .1, .4]}, 6))]
    models, stages = bo.race(df, arms, first=2)
    full = bo.Forest(df, arms)
    while full.round():
        pass
    losses = full.final_losses()
    survivors = {name for name, stage, _, _, kept in stages if kept and stage == max(s[1] for s in stages)}
    assert min(losses, key=losses.get) in survivors
    trees = {m["arm"]["name"]: len(m["trees"]) for m in models}
    assert sum(trees.values()) < 6 * 8 and max(trees.values()) >= 6


def test_without_training_rows_predictions_are_null(spark):
    _, df = signal(spark, 50)
    arm = bo.Arm("m", "y", tuple("abcd"))
    models = bo.fit_arms(df.where("role = 'test'"), [arm])
    p = bo.predict(df, {"m": models[0], "r": models[0]}, now={"r": "now"})
    assert p.count() == 50 and p.where("m IS NOT NULL OR r IS NOT NULL").count() == 0
    assert bo.first_histogram(df.where("false"), [arm]).count() == 0


# ordered target statistics

@pytest.mark.parametrize("delay", [0, 1800])
def test_target_mean_sees_the_past_only(spark, delay):
    rng = random.Random(delay)
    data = [(s, at(rng.randrange(0, 4000) * 5), rng.choice(["x", "y", None]), float(rng.randrange(9)) if rng.random() < .9 else None, k)
            for k in range(200) for s in (rng.choice(["a", "a", "b"]),)]
    data += [(None, at(3), "x", 1.0, 900), ("a", None, "x", 1.0, 901)]
    df = frame(spark, data, "site string, ts timestamp_ntz, cat string, v double, id int")
    got = {r["id"]: (r["n_before"], r["cat_mean"]) for r in ordered_target_mean(df, "cat", "v", delay_s=delay, prior=3.0, width_s=3600).collect()}
    assert len(got) == len(data) and got[900] == got[901] == (None, None)
    for s, t, c, _, k in data[:200]:
        limit = t - dt.timedelta(seconds=delay)
        seen = [(c2, v2) for s2, t2, c2, v2, _ in data[:200] if s2 == s and v2 is not None and (t2 <= limit if delay else t2 < t)]
        mine = [v for c2, v in seen if c2 == c]
        n, mean = got[k]
        assert n == len(mine)
        if seen:
            assert abs(mean - (sum(mine) + 3 * sum(v for _, v in seen) / len(seen)) / (len(mine) + 3)) < 1e-9
        else:
            assert mean is None


def test_rows_without_key_or_time_are_kept(spark):
    from skycadence.operators.anchors import split_by_fraction
    from skycadence.operators.chunks import carry_last, ordinal, row_windows, running_total
    from skycadence.operators.impute import fill_within
    from skycadence.operators.temporal import asof_join, nearest_join
    data = [("a", at(0), 1.0, 1), ("a", at(10), None, 2), (None, at(5), 7.0, 3), ("a", None, None, 4), (None, None, 2.0, 5), (None, None, 2.0, 5)]
    df = frame(spark, data, "site string, ts timestamp_ntz, x double, id int")
    null = {3: None, 4: None, 5: None}

    def by_id(d, col):
        out = d.select("id", col).collect()
        assert sorted(r["id"] for r in out) == [1, 2, 3, 4, 5, 5]
        return {r["id"]: r[col] for r in out}
    for limit in (None, 1, 1_000_000):
        assert by_id(ordinal(df, width_s=600, name="i", rows_per_chunk=limit), "i") == {1: 1, 2: 2, **null}
        assert by_id(running_total(df, {"s": F.col("x")}, width_s=600, rows_per_chunk=limit), "s") == {1: 1.0, 2: 1.0, **null}
        assert by_id(carry_last(df, {"y": F.col("x")}, width_s=600, rows_per_chunk=limit), "y") == {1: 1.0, 2: 1.0, **null}
    assert by_id(fill_within(df, "x", ["site"]), "x_filled") == {1: 1.0, 2: 1.0, 3: 7.0, 4: None, 5: 2.0}
    assert by_id(split_by_fraction(df, 0.5, 0.25), "split") == {1: "train", 2: "test", **null}
    assert by_id(row_windows(df, lambda d, w: d.withColumn("p", F.lag("id").over(w)), back=1).where("id < 5").unionByName(df.where("id = 5").withColumn("p", F.lit(None))), "p") == {1: None, 2: 1, **null}
    right = frame(spark, [("a", at(1), 9.0), (None, at(1), 8.0), ("a", None, 6.0)], "site string, ts timestamp_ntz, z double")
    assert by_id(asof_join(df, right, ["z"]), "z") == {1: None, 2: 9.0, **null}
    assert by_id(nearest_join(df, right, ["z"], tolerance_s=600), "z") == {1: 9.0, 2: 9.0, **null}


def test_a_stray_time_is_refused(spark):
    from skycadence.operators.chunks import series_bounds
    df = frame(spark, [("a", dt.datetime(1970, 1, 1), 1.0), ("a", at(0), 1.0), ("b", at(0), 1.0)], "site string, ts timestamp_ntz, x double")
    assert rows(series_bounds(df.where("ts > timestamp_ntz'2000-01-01'"), 600).select("site"), "site") == [("a",), ("b",)]
    with pytest.raises(Exception, match="stray time in series a"):
        series_bounds(df, 600).collect()
