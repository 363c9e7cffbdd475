"""Streaming queries: a bounded replay of ``events``, closed at its end, against the batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycadence.plans.registry import Tables, query
from skycadence.session import scratch_path
from skycadence.plans.stations import OBS, W, frame, observations, rc, rd, round_all
from skycadence.streaming import twins as tw

C = F.col


def live(t: Tables):
    """The station observations over a stream of the events table."""
    s = Tables(t.spark, t.folder)
    s.events = tw.closable(tw.table_stream(t.spark, t.folder, "events"))
    return observations(s), s.events


def _events(t: Tables) -> Tables:
    """The tables with ``events`` as a stream."""
    s = Tables(t.spark, t.folder)
    s.events = tw.table_stream(t.spark, t.folder, "events")
    return s


def _run(t: Tables, stream, closing=None):
    return t.spark.read.parquet(tw.replay(stream, closing=closing))


_B = f"b AS (SELECT site, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg(value) AS ghi, min(value) AS low, count(*) AS n FROM obs GROUP BY 1, 2)"


def bins(t: Tables):
    obs, closing = live(t)
    return tw.tumbling_bins(obs, {"ghi": F.avg("value"), "low": F.min("value"), "n": F.count(F.lit(1))}), closing


@query("str_deduplicated_load", "STR-1 SNK-5", "SELECT event_id, ts, value FROM events")
def _(t: Tables):
    s = tw.table_stream(t.spark, t.folder, "events").select("event_id", "ts", "value")
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _run(t, tw.without_repeats(twice, ["event_id"]))


@query("str_tumbling_bins", "STR-2 RSM-2", f"WITH {OBS}, {_B} SELECT site, ts, {rd('ghi', 'ghi')}, low, n FROM b")
def _(t: Tables):
    return round_all(_run(t, *bins(t)), ["ghi"])


@query("str_sliding_features", "STR-3 WIN-3", f"""WITH {OBS}, h AS (SELECT site, value, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 180 MINUTE, INTERVAL 10 MINUTE)) AS ts FROM obs)
SELECT site, ts, round(sum(value), 4) / count(*) AS mean3h, max(value) AS high, count(*) AS n FROM h GROUP BY site, ts""")
def _(t: Tables):
    obs, closing = live(t)
    s = tw.sliding_features(obs, {"s": F.sum("value"), "high": F.max("value"), "n": F.count(F.lit(1))})
    return _run(t, s, closing).select("site", "ts", (F.round("s", 4) / C("n")).alias("mean3h"), "high", "n")


@query("str_activity_segments", "STR-5 SEG-1", f"""WITH {OBS}, p AS (SELECT *, lag(ts) OVER (PARTITION BY site ORDER BY ts, event_id) AS q FROM obs), s AS (SELECT *, sum(CASE WHEN q IS NULL OR epoch_us(ts) - epoch_us(q) >= 720000000 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY ts, event_id) AS seg FROM p),
g AS (SELECT site, min(ts) AS seg_start, max(ts) + INTERVAL 12 MINUTE AS seg_end, count(*) AS n FROM s GROUP BY site, seg) SELECT site, seg_start, seg_end, n FROM g""")
def _(t: Tables):
    obs, closing = live(t)
    return _run(t, tw.activity_segments(obs, {"n": F.count(F.lit(1))}), closing)


@query("str_online_history", "STR-4 WIN-7 SEG-1", f"""WITH {OBS}, {_B}, x AS (SELECT site, ts, ghi, ts - lag(ts, 18) {W} AS span, avg(ghi) {frame(-18, -1)} AS mean_back, ghi - lag(ghi) {W} AS delta FROM b)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('mean_back', 'mean_back')}, {rd('delta', 'delta')} FROM x WHERE span = INTERVAL 180 MINUTE""")
def _(t: Tables):
    """The bins leave a file per task and batch, of a few rows each: micro-batches are cut by bytes, not by files."""
    binned, closing = bins(t)
    path = tw.replay(binned.select("site", "ts", "ghi"), closing=closing)
    return round_all(_run(t, tw.online_history(tw.folder_stream(t.spark, path, bytes_per_trigger=64_000_000))), ["ghi", "mean_back", "delta"])


@query("str_expiring_history", "STR-4 WIN-7 SEG-1", f"""WITH {OBS}, {_B}, x AS (SELECT site, ts, ghi, ts - lag(ts, 18) {W} AS span, avg(ghi) {frame(-18, -1)} AS mean_back, ghi - lag(ghi) {W} AS delta FROM b)
SELECT site, ts, {rd('ghi', 'ghi')}, {rd('mean_back', 'mean_back')}, {rd('delta', 'delta')} FROM x WHERE span = INTERVAL 180 MINUTE""")
def _(t: Tables):
    """The same history from keyed state whose slots expire; files that the bins left side by side are one batch."""
    binned, closing = bins(t)
    path = tw.replay(binned.select("site", "ts", "ghi"), closing=closing)
    out = _run(t, tw.expiring_history(tw.folder_stream(t.spark, path, 100_000))).drop("held")
    return round_all(out, ["ghi", "mean_back", "delta"])


@query("str_bins_with_report", "STR-6 JN-6", f"""WITH {OBS}, r AS (SELECT site, ts, k FROM obs WHERE event_type = 'signup'), v AS (SELECT * FROM obs WHERE event_type <> 'signup'), b AS (SELECT site, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg(value) AS value, count(*) AS n FROM v GROUP BY 1, 2),
j AS (SELECT b.site, b.ts, b.value, b.n, r.k AS report, row_number() OVER (PARTITION BY b.site, b.ts ORDER BY r.ts DESC) AS rn FROM b LEFT JOIN r ON r.site = b.site AND r.ts <= b.ts AND r.ts > b.ts - INTERVAL 65 MINUTE)
SELECT site, ts, {rd('value', 'value')}, n, report FROM j WHERE rn = 1""")
def _(t: Tables):
    joined = C("event_type") == "signup"
    obs, closing = live(t)
    s = tw.bins_with_latest_report(obs, F.when(~joined, C("value")), F.when(joined, C("k")))
    return round_all(_run(t, s, closing), ["value"])


@query("str_report_join", "STR-6 JN-6", f"""WITH {OBS}, r AS (SELECT site, ts, k FROM obs WHERE event_type = 'signup'), v AS (SELECT * FROM obs WHERE event_type <> 'signup'), b AS (SELECT site, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg(value) AS value, count(*) AS n FROM v GROUP BY 1, 2),
j AS (SELECT b.site, b.ts, b.value, b.n, r.k AS report, row_number() OVER (PARTITION BY b.site, b.ts ORDER BY r.ts DESC) AS rn FROM b LEFT JOIN r ON r.site = b.site AND r.ts <= b.ts AND r.ts > b.ts - INTERVAL 65 MINUTE)
SELECT site, ts, {rd('value', 'value')}, n, report FROM j WHERE rn = 1""")
def _(t: Tables):
    """The same join of two streams: bins of readings, and reports, of which a step's newest can be the newest at a bin."""
    report = C("event_type") == "signup"
    obs, closing = live(t)
    counted = tw.tumbling_bins(obs.where(~report | C("event_type").isNull()), {"value": F.avg("value"), "n": F.count("value")})
    path = tw.replay(counted, closing=closing)
    bins_ = tw.closable(tw.folder_stream(t.spark, path, 100_000).where("n > 0"))
    sent = tw.closable(observations(_events(t)).where(report).select("site", "ts", C("k").alias("report")))
    path = tw.replay(tw.newest_per_step(sent, ["report"]), closing=sent)
    reports_ = tw.closable(tw.folder_stream(t.spark, path, 100_000))
    both = tw.report_candidates(bins_, reports_, ["report"])
    out = tw.latest_reports(both, ["report"], scratch_path(t.spark, "reports"), [bins_, reports_])
    return round_all(out.drop("report_ts"), ["value"])
