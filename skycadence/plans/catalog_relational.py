"""Queries over sources, sinks, projections, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skycadence.functions import exprs as ex
from skycadence.functions import timeline as tl
from skycadence.operators.ranks import exact_quantiles, refined_quantiles
from skycadence.plans.registry import Tables, query
from skycadence.plans.stations import (OBS, S10, S1H, W, cells, cells_sql, frame, observations, rc, rcol, rd, round_all, rsql, series)
from skycadence.session import scratch_path
from skycadence.sources import readers, sinks
from skycadence.spec import SiteSpec

C = F.col


# ---- sources and sinks ---------------------------------------------------------

@query("src_scan_year_range", "SRC-1 SRC-2", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty
FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1997 GROUP BY 1, 2""")
def _(t: Tables):
    li = t.lineitem.where(tl.year_range("l_shipdate", 1996, 1997))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("src_fallback_location", "SRC-3", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    df = readers.first_available(t.spark, [f"{t.folder}/no_such_table.parquet", t.path("orders")])
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("src_canonical_columns", "SRC-4 SRC-5", """SELECT 'north' AS site, o_orderdate + INTERVAL 7 HOUR AS ts, o_totalprice AS ghi, CAST(o_custkey AS DOUBLE) AS dni
FROM orders WHERE year(o_orderdate + INTERVAL 7 HOUR) BETWEEN 1997 AND 1998""")
def _(t: Tables):
    spec = SiteSpec("north", 0, 0, columns={"ghi": "o_totalprice", "dni": "o_custkey"}, utc_shift_hours=7, first_year=1997, last_year=1998)
    return readers.to_canonical(t.orders, spec, ts_source="o_orderdate")


@query("src_time_zone", "SRC-6", "SELECT event_id, ts + INTERVAL 7 HOUR AS local_ts FROM events")
def _(t: Tables):
    # The stored wall time is read as UTC, then expressed in the station's zone.
    return t.events.select("event_id", readers.zoned_to_local(F.to_utc_timestamp(C("ts").cast("timestamp"), F.current_timezone()), "Asia/Jakarta").alias("local_ts"))


@query("src_registered_view", "SRC-7 WIN-13", f"""SELECT event_id, event_type, value, {rd('avg(value) OVER w', 'recent')} FROM events
WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    t.events.createOrReplaceTempView("stage1")
    return t.spark.sql("""SELECT event_id, event_type, value, floor(avg(value) OVER w * 1000000.0D + 0.501D) / 1000000.0D AS recent FROM stage1
        WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")


def _site_metrics(t: Tables):
    e = C("ghi") - C("dni")
    return cells(t).groupBy("site").agg(F.count("*").alias("n"), rc(F.avg(F.abs(e)), "mae", 4), rc(F.sqrt(F.avg(e * e)), "rmse", 4))


_METRICS = f"SELECT site, count(*) AS n, {rd('avg(abs(ghi - dni))', 'mae', 4)}, {rd('sqrt(avg((ghi - dni) * (ghi - dni)))', 'rmse', 4)} FROM c10 GROUP BY 1"


@query("src_csv_metrics", "SRC-8 SNK-4 SET-1", f"WITH {OBS}, {cells_sql()} {_METRICS}")
def _(t: Tables):
    path = scratch_path(t.spark, "metrics")
    sinks.write_report(_site_metrics(t), path, "csv")
    return readers.read_metrics_csv(t.spark, path, "site string, n bigint, mae double, rmse double")


@query("snk_json_report", "SNK-4", f"WITH {OBS}, {cells_sql()} {_METRICS}")
def _(t: Tables):
    path = scratch_path(t.spark, "report")
    sinks.write_report(_site_metrics(t), path, "json")
    return t.spark.read.schema("site string, n bigint, mae double, rmse double").json(path)


@query("snk_staged_dataset", "SNK-1 SNK-2 SNK-6", """SELECT split, stage, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM (
SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'valid' ELSE 'test' END AS split,
unnest(['base', 'full']) AS stage FROM orders) GROUP BY 1, 2""")
def _(t: Tables):
    from skycadence.operators.anchors import split_by_dates
    path = scratch_path(t.spark, "stages")
    df = t.orders.withColumn("split", split_by_dates("o_orderdate", "1999-01-01", "2000-01-01"))
    stages = {"base": ["o_orderkey"], "full": ["o_orderkey", "o_orderdate", "o_totalprice"]}
    sinks.write_stages(df, path, stages)
    both = [t.spark.read.parquet(f"{path}/{s}").select("split", F.lit(s).alias("stage"), "o_orderkey") for s in stages]
    return both[0].unionByName(both[1]).groupBy("split", "stage").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


@query("snk_replace_table", "SNK-3", f"WITH {OBS}, {cells_sql()} {_METRICS}")
def _(t: Tables):
    path = scratch_path(t.spark, "table")
    name = "m_" + path.rsplit("-", 1)[1]
    sinks.create_or_replace(_site_metrics(t), name, path)
    return t.spark.table(name)


@query("snk_incremental_append", "SNK-5 SNK-6", """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders""")
def _(t: Tables):
    path = scratch_path(t.spark, "hwm")
    src = t.orders.select("o_orderkey", C("o_orderdate").alias("ts"))
    for cut in ("1997-01-01", "1999-06-01", "2100-01-01"):
        sinks.append_since(src.where(tl.before("ts", cut)), path)
    return sinks.verification(t.spark.read.parquet(path), "o_orderkey")


@query("snk_copy_counts", "QC-10 SNK-1", "SELECT count(*) AS n_a, count(*) AS n_b, true AS matches FROM lineitem")
def _(t: Tables):
    path = scratch_path(t.spark, "copy")
    sinks.write_sorted(t.lineitem, path, ["l_returnflag", "l_shipdate"])
    return sinks.counts_match(t.lineitem, t.spark.read.parquet(path))


@query("snk_backfill_column", "SNK-7", f"""WITH {S10}, {cells_sql('1 HOUR', 'c1h')} SELECT s.site, s.ts, coalesce(s.cot, h.cot) AS cot, h.temp AS hour_temp
FROM s10 s LEFT JOIN c1h h ON h.site = s.site AND h.ts = s.ts""")
def _(t: Tables):
    hours = cells(t, 3600).select("site", "ts", "cot", C("temp").alias("hour_temp"))
    return sinks.backfill(series(t).select("site", "ts", "cot"), hours, ["cot", "hour_temp"])


@query("snk_patch_partitions", "SNK-3 SNK-7", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) NOT IN (1996, 1998) THEN NULL ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT -o_orderkey, 1998, o_totalprice FROM orders WHERE year(o_orderdate) = 1998 AND o_orderkey % 5 = 0""")
def _(t: Tables):
    """Prices missing in every year, filled in two years only, with rows the table did not have."""
    path = scratch_path(t.spark, "patched")
    year = F.year("o_orderdate").alias("year")
    sinks.write_parquet(t.orders.select("o_orderkey", F.when(C("o_orderkey") % 3 != 0, C("o_totalprice")).alias("price"), year), path, ["year"])
    whole = t.orders.select("o_orderkey", C("o_totalprice").alias("price"), year).where(C("year").isin(1996, 1998))
    extra = whole.where((C("year") == 1998) & (C("o_orderkey") % 5 == 0)).withColumn("o_orderkey", -C("o_orderkey"))
    sinks.patch_partitions(whole.unionByName(extra), path, ["year"], ["o_orderkey"])
    return t.spark.read.parquet(path)


@query("jn_stored_layout", "JN-1 SNK-3 VIEW-1", f"WITH {OBS}, {cells_sql()} SELECT site, ts, ghi, temp FROM c10 WHERE temp IS NOT NULL")
def _(t: Tables):
    """Two sources stored by their join keys: joining them moves no row."""
    c = cells(t)
    a = sinks.stored(c.select("site", "ts", "ghi"), ["site", "ts"], 8)
    b = sinks.stored(c.where(C("temp").isNotNull()).select("site", "ts", "temp"), ["site", "ts"], 8)
    return a.join(b, ["site", "ts"])


_COLS = ["ghi", "cot", "temp", "oktas"]


@query("view_null_profile", "VIEW-2 QC-9", f"""WITH {S10}, u AS (UNPIVOT (SELECT site, count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in _COLS)} FROM s10 GROUP BY site)
ON {', '.join(_COLS)} INTO NAME "column" VALUE n_nonnull) SELECT site, "column", n_nonnull, {rd('100.0::DOUBLE * n_nonnull / n', 'pct_nonnull')} FROM u""")
def _(t: Tables):
    return round_all(sinks.null_profile(series(t).select("site", *_COLS), by=["site"]), ["pct_nonnull"])


@query("prf_coverage_by_month", "PRF-1 AGG-11", """SELECT l_returnflag AS site, date_trunc('month', l_shipdate) AS period, count(*) AS n_rows,
count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL) AS n_null, count(*) FILTER (WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_discount <> 0) AS n_in_range FROM lineitem GROUP BY 1, 2""")
def _(t: Tables):
    li = t.lineitem.select(C("l_returnflag").alias("site"), C("l_shipdate").alias("ts"), F.nullif(C("l_discount"), F.lit(0.0)).alias("x"))
    out = sinks.coverage_by_period(li, tl.month_start("ts"), "x", 0.02, 0.06, by=["site"])
    return out


@query("prf_counts_by_period_predicates", "PRF-2", """SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS n_train,
count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01') AS n_valid,
count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS n_test FROM orders""")
def _(t: Tables):
    d = "o_orderdate"
    return t.orders.agg(F.count_if(tl.before(d, "1999-01-01")).alias("n_train"),
                        F.count_if(tl.on_or_after(d, "1999-01-01") & tl.before(d, "2000-01-01")).alias("n_valid"),
                        F.count_if(tl.on_or_after(d, "2000-01-01")).alias("n_test"))


# ---- projections ---------------------------------------------------------

@query("prj_conditionals", "PRJ-1 PRJ-2 PRJ-3 PRJ-4 PRJ-5", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS prio,
nullif(o_orderstatus, 'F') AS not_f, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'none') AS two_level,
greatest(o_totalprice, 200000) AS g, least(o_totalprice, 200000) AS l, least(greatest(o_totalprice, 100000), 300000) AS clipped,
CASE WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 1 ELSE 0 END AS in_range, least(o_totalprice, o_custkey * 100.0::DOUBLE) AS row_capped FROM orders""")
def _(t: Tables):
    o, x = t.orders.drop("o_orderdate"), C("o_totalprice")
    return o.select("o_orderkey", ex.lookup("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}, 3).alias("prio"),
                    F.nullif("o_orderstatus", F.lit("F")).alias("not_f"),
                    F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("two_level"),
                    ex.floor_at(x, 200000.0).alias("g"), ex.cap_at(x, 200000.0).alias("l"), ex.clip(x, 100000.0, 300000.0).alias("clipped"),
                    ex.flag(ex.inside(x, 100000, 300000)).alias("in_range"), ex.cap_at(x, C("o_custkey") * 100.0).alias("row_capped"))


@query("prj_row_wise_statistics", "PRJ-7 PRJ-8", f"""WITH {S10} SELECT site, ts, greatest(cot, temp, oktas) AS hi, least(cot, temp, oktas) AS lo,
{rd('(coalesce(cot, 0) + coalesce(temp, 0) + coalesce(oktas, 0)) / nullif((cot IS NOT NULL)::INT + (temp IS NOT NULL)::INT + (oktas IS NOT NULL)::INT, 0)', 'avg_present')},
{rd('CASE WHEN cot BETWEEN 0 AND 30 AND temp BETWEEN 0 AND 30 AND oktas BETWEEN 0 AND 30 THEN (cot + temp + oktas) / 3 END', 'avg_strict')} FROM s10""")
def _(t: Tables):
    cols = ["cot", "temp", "oktas"]
    return series(t).select("site", "ts", ex.row_max(*cols).alias("hi"), ex.row_min(*cols).alias("lo"),
                            rc(ex.row_mean(*cols), "avg_present"), rc(ex.strict_mean(cols, 0, 30), "avg_strict"))


@query("prj_bins_and_maps", "PRJ-10 PRJ-11 PRJ-12 PRJ-6", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 AND l_quantity <= 5 THEN 'thin' WHEN l_quantity > 5 AND l_quantity <= 15 THEN 'mid'
WHEN l_quantity > 15 THEN 'thick' END AS bin, CASE WHEN nullif(l_discount, 0) IS NULL THEN 'no data' WHEN l_discount <= 0.05 THEN 'low' ELSE 'high' END AS disc_bin,
greatest(floor((l_quantity - 12) / 10) * 10, 0) AS bucket, CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS weight,
CASE WHEN l_linestatus IN ('F', 'X') THEN 1 ELSE 0 END AS member FROM lineitem""")
def _(t: Tables):
    inf = float("inf")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", ex.cut("l_quantity", [0, 5, 15, inf], ["thin", "mid", "thick"]).alias("bin"),
        ex.cut(F.nullif(C("l_discount"), F.lit(0.0)), [-inf, 0.05, inf], ["low", "high"], missing="no data").alias("disc_bin"),
        ex.floor_bucket(C("l_quantity") - 12, 10).alias("bucket"), ex.lookup("l_returnflag", {"R": 1.0, "A": 0.85}, 0.6).alias("weight"),
        ex.flag(C("l_linestatus").isin("F", "X")).alias("member"))


@query("prj_column_lists", "PRJ-1 PRJ-13 SET-3", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t: Tables):
    wanted = ex.ordered_union(["o_orderkey", "o_custkey"], ["o_custkey", "not_there", "o_totalprice"])
    names = ex.without(ex.available(wanted, t.orders.columns), ["o_comment"])
    return t.orders.select(*names)


@query("prj_dates_and_casts", "PRJ-3 SRC-6", """SELECT event_id, date_trunc('hour', ts) AS h, extract(doy FROM ts) AS doy, extract(minute FROM ts) AS mi, CAST(ts AS DATE) AS d,
date_sub('minute', TIMESTAMP '2024-01-01 00:00:00', ts) AS minutes_since, TRY_CAST(event_type AS DOUBLE) AS bad, TRY_CAST(substr(props, 7, 1) AS DOUBLE) AS digit,
date_trunc('month', ts) AS mon, event_type LIKE 'v%' AS is_view FROM events""")
def _(t: Tables):
    ts = C("ts")
    e = t.events.withColumn("digit_text", F.substring("props", 7, 1))
    return e.select("event_id", tl.floor_to(ts, 3600).alias("h"), F.dayofyear(ts).cast("long").alias("doy"), F.minute(ts).cast("long").alias("mi"),
                    F.to_date(ts).alias("d"), F.timestamp_diff("MINUTE", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), ts).alias("minutes_since"),
                    readers.to_number("event_type").alias("bad"), readers.to_number("digit_text").alias("digit"),
                    tl.month_start(ts).alias("mon"), C("event_type").like("v%").alias("is_view"))


# ---- aggregates ---------------------------------------------------------

@query("agg_basic_statistics", "AGG-1 AGG-2 AGG-16", f"""WITH {OBS}, {cells_sql('1 HOUR', 'c1h')} SELECT site, ts, n, {rd('ghi', 'ghi')}, sd, sdp FROM (SELECT c.site, c.ts, c.n, c.ghi FROM c1h c)
JOIN (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {rd('stddev_samp(value)', 'sd', 5)}, {rd('stddev_pop(value)', 'sdp', 5)} FROM obs GROUP BY 1, 2) USING (site, ts)""")
def _(t: Tables):
    o = observations(t)
    return o.groupBy("site", tl.floor_to("ts", 3600).alias("ts")).agg(
        F.count("*").alias("n"), rc(F.floor(F.avg(C("value") * 10.0) * 64.0 + 0.5) / 64.0, "ghi"), rc(F.stddev_samp("value"), "sd", 5), rc(F.stddev_pop("value"), "sdp", 5))


@query("agg_ordered_first_last", "AGG-3 AGG-4 AGG-5", f"""WITH {OBS} SELECT site, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS last_value, arg_min(value, (ts, event_id)) AS first_value,
arg_min(event_type, (ts, event_id)) AS first_type, bool_and(value < 150) AS all_small FROM obs GROUP BY 1, 2""")
def _(t: Tables):
    at = F.struct("ts", "event_id")
    return observations(t).groupBy("site", tl.floor_to("ts", 3600).alias("h")).agg(
        F.max_by("value", at).alias("last_value"), F.min_by("value", at).alias("first_value"), F.min_by("event_type", at).alias("first_type"),
        F.bool_and(C("value") < 150).alias("all_small")).withColumnRenamed("h", "ts")


_Q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query("agg_exact_quantiles", "AGG-8 AGG-9", "SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(
    rd(f"quantile_cont(l_extendedprice, {p})", n, 4) for n, p in _Q.items()) + " FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    q = refined_quantiles(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"], _Q, size="n")
    return round_all(q, _Q, 4)


@query("agg_global_quantiles", "AGG-8 AGG-9", "SELECT " + ", ".join(rd(f"quantile_cont(o_totalprice, {p})", n, 4) for n, p in _Q.items()) + " FROM orders")
def _(t: Tables):
    return round_all(refined_quantiles(t.orders, "o_totalprice", (), _Q), _Q, 4)


@query("agg_correlation", "AGG-10", f"WITH {OBS}, {cells_sql()} SELECT site, {rd('corr(ghi, cot)', 'r_cot', 6)}, {rd('corr(ghi, temp)', 'r_temp', 6)}, count(cot) AS n FROM c10 GROUP BY 1")
def _(t: Tables):
    return cells(t).groupBy("site").agg(rc(F.corr("ghi", "cot"), "r_cot"), rc(F.corr("ghi", "temp"), "r_temp"), F.count("cot").alias("n"))


@query("agg_value_counts", "AGG-11 SRT-2", "SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, o_orderpriority, year LIMIT 12")
def _(t: Tables):
    g = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "o_orderpriority", "year").limit(12)


@query("agg_describe", "AGG-12", f"""WITH {OBS}, {cells_sql()} SELECT site, count(ghi) AS n, {rd('avg(ghi)', 'avg', 5)}, {rd('stddev_samp(ghi)', 'std', 5)}, min(ghi) AS low, max(ghi) AS high,
{', '.join(rd(f'quantile_cont(ghi, {p})', q, 5) for q, p in (('p25', .25), ('p50', .5), ('p75', .75)))} FROM c10 GROUP BY 1""")
def _(t: Tables):
    from skycadence.operators.evaluate import describe
    return round_all(describe(cells(t), "ghi", ["site"]), ["avg", "std", "p25", "p50", "p75"], 5)


@query("agg_percent_crosstab", "AGG-13", """SELECT o_orderpriority, """ + ", ".join(rd(f"100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = '{s}') / count(*)", f"pct_{s}", 4) for s in "FOP") + """ FROM orders GROUP BY 1""")
def _(t: Tables):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    total = C("F") + C("O") + C("P")
    return p.select("o_orderpriority", *[rc(100.0 * C(s) / total, f"pct_{s}", 4) for s in "FOP"])


# ---- sorting and sets ---------------------------------------------------------

@query("srt_sorted_output", "SRT-1", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def _(t: Tables):
    keys = ["o_custkey", "o_orderdate", "o_orderkey"]
    return t.orders.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)


@query("srt_threshold_position", "SRT-3 SRT-4 SRT-5", """WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), c AS (SELECT p_brand, n, row_number() OVER w AS rk,
sum(n) OVER w / sum(n) OVER () AS cum FROM g WINDOW w AS (ORDER BY n DESC, p_brand))
SELECT x.thr, min(CASE WHEN cum >= x.thr THEN rk END) AS needed, arg_min(p_brand, CASE WHEN cum >= x.thr THEN rk END) AS brand FROM c, (SELECT unnest([0.25::DOUBLE, 0.5, 0.9]) AS thr) x GROUP BY 1""")
def _(t: Tables):
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "p_brand")  # one row per brand: a small aggregate
    c = g.select("p_brand", F.row_number().over(w).cast("long").alias("rk"), (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("cum"))
    c = c.withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.9)])))
    hit = F.when(C("cum") >= C("thr"), C("rk"))
    return c.groupBy("thr").agg(F.min(hit).alias("needed"), F.min_by("p_brand", hit).alias("brand"))


@query("set_union_tagged", "SET-1 SET-2", f"""SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS x, NULL::DOUBLE AS y FROM orders
UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier""")
def _(t: Tables):
    a = t.orders.select(F.lit("orders").alias("source"), C("o_orderkey").alias("id"), C("o_totalprice").alias("x"))
    b = t.supplier.select(F.lit("supplier").alias("source"), C("s_suppkey").alias("id"), C("s_acctbal").alias("y"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_consolidated_sources", "SET-2 DDP-1", f"""WITH {OBS}, u AS (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS ts, 'click' AS src, sum(value) AS x, NULL::DOUBLE AS y FROM obs WHERE event_type = 'click' GROUP BY 1, 2
UNION ALL SELECT site, time_bucket(INTERVAL 1 HOUR, ts), 'view', NULL, sum(value) FROM obs WHERE event_type = 'view' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site, ts ORDER BY CASE src WHEN 'view' THEN 1 ELSE 2 END) AS rn FROM u) SELECT site, ts, src, x, y FROM r WHERE rn = 1""")
def _(t: Tables):
    from skycadence.operators.grid import dedup_by_priority
    o = observations(t)
    def part(kind, name):
        return (o.where(C("event_type") == kind).groupBy("site", tl.floor_to("ts", 3600).alias("ts"))
                .agg(F.lit(kind).alias("src"), F.sum("value").alias(name)))
    u = part("click", "x").unionByName(part("view", "y"), allowMissingColumns=True)
    return dedup_by_priority(u, "src", {"view": 1, "click": 2}, tiebreak=["src"])
