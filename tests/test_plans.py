"""Plan properties that decide whether a query survives large data."""

import re

import pytest
from pyspark.sql import functions as F

from skycadence.functions.timeline import year_range
from skycadence.plans.catalog import CATALOG
from skycadence.plans.registry import Tables
from skycadence.sources.sinks import append_since

LAZY = [n for n in CATALOG if n.split("_")[0] in ("rsm", "grd", "win", "sol", "anc", "tgt", "jn", "qc", "feature", "recipe", "ddp", "seg", "smart")]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_and_no_whole_series_windows(spark, sf01, name):
    plan = physical(CATALOG[name](spark, sf01))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for argument, spec in re.findall(r"\(([^()]*)\) windowspecdefinition\(([^()]*)", plan):
        summary = "_bc#" in argument or "_m#" in argument  # totals over histogram or chunk-size rows
        assert "_chunk" in spec or "_b#" in spec or summary, (argument, spec)


def test_feature_table_shuffles_once_per_source_and_once_for_windows(spark, sf01):
    plan = physical(CATALOG["feature_table_wide"](spark, sf01))
    sources, bounds, slots, windows = 4, 1, 1, 1
    assert plan.count("Exchange hashpartitioning") <= sources + bounds + slots + windows
    assert plan.count("SortMergeJoin") == plan.count("BroadcastHashJoin") == 0


def test_year_range_reaches_the_scan(spark, sf01):
    df = Tables(spark, sf01).lineitem.where(year_range("l_shipdate", 1996, 1997)).select("l_quantity")
    plan = physical(df)
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>", plan)


def test_append_is_incremental_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select(F.timestamp_add("DAY", F.col("id"), F.expr("timestamp_ntz'2024-01-01'")).alias("ts"), "id")
    append_since(df.where("id < 4"), path)
    append_since(df, path)
    append_since(df, path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(10))


def test_every_query_has_operators_and_unique_text():
    assert all(q.ops for q in CATALOG.values())
    texts = [q.sql for q in CATALOG.values() if q.sql]
    assert len(texts) > 120


def test_append_keeps_lagging_series_and_rows_at_the_mark(spark, tmp_path):
    path = str(tmp_path / "marks")
    schema = "site string, ts timestamp_ntz, v int"
    from helpers import at
    first = [("a", at(0), 1), ("a", at(10), 2), ("b", at(0), 3)]
    append_since(spark.createDataFrame(first, schema), path, by=["site"])
    later = [*first, ("a", at(10), 4), ("a", at(20), 5), ("b", at(5), 6), ("c", at(1), 7), (None, at(1), 8)]
    for _ in range(2):
        append_since(spark.createDataFrame(later, schema), path, by=["site"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_append_never_replaces_a_table_without_the_time(spark, tmp_path):
    import pytest
    path = str(tmp_path / "no_time")
    spark.range(5).write.parquet(path)
    with pytest.raises(ValueError):
        append_since(spark.range(3).selectExpr("id", "timestamp_ntz '2024-01-01' AS ts"), path)
    assert spark.read.parquet(path).count() == 5


def test_stored_sources_join_without_a_shuffle(spark):
    from skycadence.sources.sinks import stored
    a = stored(spark.range(1000).selectExpr("concat('s', id % 7) AS site", "id AS ts", "id AS v"), ["site", "ts"], 4)
    b = stored(spark.range(0, 1000, 3).selectExpr("concat('s', id % 7) AS site", "id AS ts", "-id AS w"), ["site", "ts"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, ["site", "ts"])
        assert joined.count() == 334
        plan = physical(joined.groupBy("site", "ts").sum("v"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_patch_rewrites_the_partitions_it_touches_only(spark, tmp_path):
    import os
    import time
    from skycadence.sources.sinks import patch_partitions, write_parquet
    path = str(tmp_path / "t")
    data = [(k, None if k % 2 else float(k), f"n{k}", ["x", "y", None][k % 3]) for k in range(30)]
    write_parquet(spark.createDataFrame(data, "k int, v double, name string, part string"), path, ["part"])

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    time.sleep(0.05)
    patch = [(1, 10.0, "y"), (4, 44.0, "y"), (99, 9.0, "y"), (5, 50.0, None), (7, None, "y")]
    patch_df = spark.createDataFrame(patch, "k int, v double, part string")
    assert sorted(str(t["part"]) for t in patch_partitions(patch_df, path, ["part"], ["k"])) == ["None", "y"]
    after = files()
    untouched = [f for f in before if "part=x" in f]
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    assert not any(f in after for f in before if "part=x" not in f)
    got = {r["k"]: (r["v"], r["name"], r["part"]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 and got[1] == (10.0, "n1", "y") and got[4] == (4.0, "n4", "y") and got[99] == (9.0, None, "y") and got[5] == (50.0, "n5", None)
    assert got[7] == (None, "n7", "y") and got[3] == (None, "n3", "x")
    patch_partitions(patch_df, path, ["part"], ["k"], replace=True)
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}[4] == 44.0
    assert patch_partitions(patch_df.where("false"), path, ["part"], ["k"]) == []
