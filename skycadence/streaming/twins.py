"""Structured Streaming forms of the batch operators.

Each takes and returns a streaming DataFrame with ``site, ts, ...``; ``replay``
runs one over the data at hand and hands back the written result. What lies behind
the last watermark waits for more data; a bounded replay whose input went through
``closable`` is closed at its end and equals the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skycadence.functions.timeline import US, as_instant, as_wall, floor_div, from_micros, micros
from skycadence.session import scratch_path
from skycadence.spec import HISTORY_STEPS, STEP_S

C = F.col


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of the folder as a stream, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(folder)


def folder_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; with ``bytes_per_trigger`` micro-batches grow in number with the data, not with its files."""
    schema = spark.read.parquet(folder).schema
    most = {"maxBytesPerTrigger": str(bytes_per_trigger)} if bytes_per_trigger else {"maxFilesPerTrigger": str(files_per_trigger)}
    return spark.readStream.schema(schema).options(**most).parquet(folder)


CLOSING_TIME = "9000-01-01 00:00:00"  # later than any reading


def closable(stream: DataFrame) -> DataFrame:
    """The stream with a second, still empty input that ``replay(close=True)`` ends it through."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "closing")
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))
    both._closing = (folder, stream.schema)
    return both


def _close(folder: str, schema, spark: SparkSession, ts: str = "ts") -> None:
    """One row far in the future, which moves the watermark past all others and is itself never emitted."""
    row = spark.range(1).select(*[(F.lit(CLOSING_TIME) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(folder)


def without_repeats(stream: DataFrame, keys: Sequence[str], lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Incremental load that lets each key through once while it can still be repeated."""
    once = _clocked(stream, ts, lateness).dropDuplicatesWithinWatermark(list(keys))
    return once.drop("_at")


def _clocked(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The stream with its event time as ``_at``, an instant under a watermark."""
    return stream.withColumn("_at", as_instant(ts)).withWatermark("_at", lateness)


def tumbling_bins(stream: DataFrame, aggs: dict[str, Column], *, step: str = "10 minutes", lateness: str = "10 minutes",
                  keys: Sequence[str] = ("site",), ts: str = "ts") -> DataFrame:
    """Bin aggregates, emitted once the watermark passes the bin's end."""
    return (_clocked(stream, ts, lateness).groupBy(*keys, F.window("_at", step).alias("_w")).agg(*[a.alias(n) for n, a in aggs.items()])
            .select(*keys, as_wall("_w.start").alias(ts), *aggs))


def sliding_features(stream: DataFrame, aggs: dict[str, Column], *, span: str = "3 hours", slide: str = "10 minutes",
                     lateness: str = "10 minutes", keys: Sequence[str] = ("site",), ts: str = "ts") -> DataFrame:
    """Trailing aggregates labelled by the window's end."""
    return (_clocked(stream, ts, lateness).groupBy(*keys, F.window("_at", span, slide).alias("_w")).agg(*[a.alias(n) for n, a in aggs.items()])
            .select(*keys, as_wall("_w.end").alias(ts), *aggs))


def activity_segments(stream: DataFrame, aggs: dict[str, Column], *, gap: str = "12 minutes", lateness: str = "10 minutes",
                      keys: Sequence[str] = ("site",), ts: str = "ts") -> DataFrame:
    return (_clocked(stream, ts, lateness).groupBy(*keys, F.session_window("_at", gap).alias("_w")).agg(*[a.alias(n) for n, a in aggs.items()])
            .select(*keys, as_wall("_w.start").alias("seg_start"), as_wall("_w.end").alias("seg_end"), *aggs))


def bins_with_latest_report(stream: DataFrame, value: Column, report: Column, *, tolerance_s: int = 65 * 60, step_s: int = STEP_S,
                            lateness: str = "3 hours", keys: Sequence[str] = ("site",), ts: str = "ts") -> DataFrame:
    """Each bin with the newest report no older than the tolerance at the bin's start.

    ``value`` is NULL on report rows and ``report`` NULL on value rows. A report is
    sent to the few bins it can serve, so one streaming aggregate replaces a
    stream-stream join and its buffered pairs.
    """
    step = F.lit(step_s * US).cast("long")
    us = micros(ts)
    first = us + F.pmod(-us, step)
    reach = F.sequence(first, us + F.lit(tolerance_s * US - 1), step)
    own = F.array(us - F.pmod(us, step))
    sent = stream.select(*keys, ts, value.alias("_v"), report.alias("_r"), F.explode(F.when(report.isNotNull(), reach).otherwise(own)).alias("_slot"))
    slotted = _clocked(sent.withColumn("slot", from_micros(C("_slot"))), "slot", lateness)
    return (slotted.groupBy(*keys, F.window("_at", f"{step_s} seconds").alias("_w"))
            .agg(F.avg("_v").alias("value"), F.count("_v").alias("n"), F.max_by("_r", F.when(C("_r").isNotNull(), C(ts))).alias("report"))
            .select(*keys, as_wall("_w.start").alias(ts), "value", "n", "report").where(C("n") > 0))


def newest_per_step(reports: DataFrame, cols: Sequence[str], *, step_s: int = STEP_S, lateness: str = "1 hour", key: str = "site", ts: str = "ts") -> DataFrame:
    """The newest report of each step, with its own time; a step ends at its slot and holds that instant.

    At a slot or later no other report of the step is the newest, so a join to bins of that step needs these alone."""
    clocked = reports.withColumn("_at", as_instant(ts) - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_at", lateness)
    newest = clocked.groupBy(key, F.window("_at", f"{step_s} seconds").alias("_w")).agg(F.max(ts).alias("_ts"), F.max_by(F.struct(*cols), ts).alias("_new"))
    return newest.select(key, C("_ts").alias(ts), *[C(f"_new.{c}").alias(c) for c in cols])


def report_candidates(bins: DataFrame, reports: DataFrame, cols: Sequence[str], *, tolerance_s: int = 65 * 60, lateness: str = "1 hour",
                      key: str = "site", ts: str = "ts") -> DataFrame:
    """Outer join of two watermarked streams: each bin with every report of the last ``tolerance_s`` before it, or with none.

    State holds a bin until no report can come for it and a report until no bin can, which the interval and both watermarks
    bound. A bin is emitted once per report; ``latest_reports`` keeps the newest. Bins without key or time are left out.
    Rows meet by key and span of ``tolerance_s``: a report waits in its own span and in the next, the only ones whose bins it
    can serve, so a bin is compared with the reports of two spans however many a batch or the state holds."""
    def span(t: str) -> Column:
        return floor_div(micros(t), tolerance_s * US)
    b = _clocked(bins.where(C(key).isNotNull() & C(ts).isNotNull() | (C(ts) >= F.lit(CLOSING_TIME).cast("timestamp_ntz"))), ts, lateness)
    # A filter on the key would go below the watermark and take the closing row with it: reports without key get one no bin has.
    r = reports.select(F.coalesce(C(key).cast("string"), F.lit("\x00")).alias("_rkey"), C(ts).alias("report_ts"), *cols, as_instant(ts).alias("_rat")).withWatermark("_rat", lateness)
    b = b.withColumn("_span", span(ts))
    r = r.withColumn("_rspan", F.explode(F.array(span("report_ts"), span("report_ts") + 1)))
    near = (C(key) == C("_rkey")) & (C("_span") == C("_rspan")) & (C("_rat") <= C("_at")) & (C("_rat") > C("_at") - F.expr(f"INTERVAL {tolerance_s} SECONDS"))
    return b.join(r, near, "leftOuter").select(*bins.columns, "report_ts", *cols)


def latest_reports(stream: DataFrame, cols: Sequence[str], base: str, closings: Sequence[DataFrame] = (), key: str = "site", ts: str = "ts") -> DataFrame:
    """Run ``report_candidates`` to the end of its input and give each bin with its newest report.

    Every micro-batch is written to a folder of its number, so a batch that runs again after a failure replaces what it
    wrote; ``base`` holds that and the progress, and a later call with the same ``base`` goes on from there."""
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c not in (key, ts, "report_ts", *cols)]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    def run() -> None:
        (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/_progress").trigger(availableNow=True).start()).awaitTermination()
    run()
    if closings:
        for closing in closings:
            _close(*closing._closing, spark, ts)
        run()
    found = spark.read.schema(stream.schema).parquet(f"{base}/data").where(C(key).isNotNull())
    newest = [F.max_by(c, "report_ts").alias(c) for c in cols]
    return found.groupBy(key, ts).agg(*[F.first(c).alias(c) for c in rest], F.max("report_ts").alias("report_ts"), *newest)


def online_history(bins: DataFrame, *, steps: int = HISTORY_STEPS, step_s: int = STEP_S, key: str = "site", ts: str = "ts", value: str = "ghi",
                   keep_s: int | None = None) -> DataFrame:
    """History features per incoming bin from the 18 slots before it; a gap leaves the bins after it without.

    Reads bins (one row per slot), not raw readings, so a busy station costs one row
    per step. Bins may come in any order and in any number of files: a bin is emitted
    once, when the last of its slots has come. State holds 16 bytes per slot of a
    station (0.8 MB a year), or the slots of the last ``keep_s`` seconds.
    """
    def advance(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, v = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        rows = pd.concat(list(frames), ignore_index=True).dropna().drop_duplicates("at")
        fresh = ~np.isin(rows["at"].to_numpy(), at)
        at = np.concatenate([at, rows["at"].to_numpy()[fresh]]).astype(np.int64)
        new = np.concatenate([np.zeros(len(v), np.int64), np.ones(fresh.sum(), np.int64)])
        v = np.concatenate([v, rows["v"].to_numpy()[fresh]]).astype(float)
        order = np.argsort(at, kind="stable")
        at, v, new = at[order], v[order], new[order]
        i = np.arange(steps, len(at))
        news = np.concatenate([[0], np.cumsum(new)])
        i = i[(at[i] - at[i - steps] == steps * step_s) & (news[i + 1] > news[i - steps])]
        mean = v[i[:, None] - np.arange(1, steps + 1)].mean(axis=1) if len(i) else np.zeros(0)
        out = pd.DataFrame({"site": k[0], "at": at[i], "v": v[i], "mean_back": mean, "delta": v[i] - v[i - 1]})
        held = at >= (at[-1] - keep_s if keep_s and len(at) else -(1 << 62))
        state.update((at[held].tolist(), v[held].tolist()))
        yield out

    seconds = F.call_function("div", micros(ts), F.lit(US).cast("long"))
    out = bins.select(C(key).alias("site"), seconds.alias("at"), C(value).alias("v")).groupBy("site").applyInPandasWithState(
        advance, "site string, at long, v double, mean_back double, delta double", "at array<long>, v array<double>", "append", "NoTimeout")
    return out.select("site", from_micros(C("at") * F.lit(US)).alias(ts), C("v").alias(value), "mean_back", "delta")


class _SlotHistory(StatefulProcessor):
    """Keeps the slots of one station that later bins still need, and emits a bin when the slots before it are there."""

    def __init__(self, steps: int, step_s: int):
        self.steps, self.step_s = steps, step_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "at long", "v double, sent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() // 1000 - (self.steps + 1) * self.step_s
        held = {k[0]: (v[0], v[1]) for k, v in self.slots.iterator()}
        fresh = set()
        for frame in rows:
            for at, v in frame[["at", "v"]].dropna().itertuples(index=False):
                if at not in held and at >= limit:
                    held[at] = (float(v), False)
                    fresh.add(int(at))
        out = []
        for at in sorted({a + k * self.step_s for a in fresh for k in range(self.steps + 1)}):
            before = [held.get(at - k * self.step_s) for k in range(1, self.steps + 1)]
            if at in held and not held[at][1] and all(b is not None for b in before):
                held[at] = (held[at][0], True)
                fresh.add(at)
                out.append((key[0], at, held[at][0], float(np.mean([b[0] for b in before])), held[at][0] - before[0][0], len(held)))
        for at in fresh:
            self.slots.updateValue((at,), held[at])
        for at in held:
            if at < limit:
                self.slots.removeKey((at,))  # no later bin reaches back to it
        if held:  # what a station that falls silent leaves behind
            self.handle.registerTimer((max(held) + (self.steps + 1) * self.step_s) * 1000)
        yield pd.DataFrame(out, columns=["site", "at", "v", "mean_back", "delta", "held"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = expiredTimerInfo.getExpiryTimeInMs() // 1000 - (self.steps + 1) * self.step_s
        for at in [k[0] for k in self.slots.keys() if k[0] <= done]:
            self.slots.removeKey((at,))
        yield pd.DataFrame({"site": pd.Series(dtype=str), "at": pd.Series(dtype="int64"), "v": pd.Series(dtype=float), "mean_back": pd.Series(dtype=float),
                            "delta": pd.Series(dtype=float), "held": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def expiring_history(bins: DataFrame, *, steps: int = HISTORY_STEPS, step_s: int = STEP_S, lateness: str = "1 hour", key: str = "site", ts: str = "ts",
                     value: str = "ghi") -> DataFrame:
    """``online_history`` with a state that ends: keyed map state and event-time timers, in RocksDB.

    A slot is forgotten when the watermark is ``steps`` slots past it, so a station holds ``steps`` slots and those of the
    lateness, however long the stream runs (column ``held``: slots in state when the bin was emitted). Bins that come late or
    out of order within the lateness give the same rows; what comes later than any bin could need is ignored. A bin is
    emitted once; rows without key, time or value take no part.
    """
    bins.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seconds = F.call_function("div", micros(ts), F.lit(US).cast("long"))
    rows = _clocked(bins, ts, lateness).select(C(key).cast("string").alias("site"), "_at", seconds.alias("at"), C(value).cast("double").alias("v"))
    out = rows.where(C("site").isNotNull() & C("at").isNotNull()).groupBy("site").transformWithStateInPandas(
        _SlotHistory(steps, step_s), "site string, at long, v double, mean_back double, delta double, held long", "Append", "EventTime")
    return out.select("site", from_micros(C("at") * F.lit(US)).alias(ts), C("v").alias(value), "mean_back", "delta", "held")


def replay(stream: DataFrame, stem: str = "stream", out: str | None = None, closing: DataFrame | None = None, ts: str = "ts") -> str:
    """Run to the end of the available data into Parquet; the checkpoint and the
    result live in the shared folder, so a restarted query resumes where it was.

    With ``closing``, the input that ``closable`` made, the query is then resumed once
    to emit what the last watermark held back."""
    spark = stream.sparkSession
    base = out or scratch_path(spark, stem)

    def run() -> None:
        q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/_progress")
             .option("path", f"{base}/data").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    if closing is not None:
        _close(*closing._closing, spark, ts)
        run()
    return f"{base}/data"


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], stem: str = "batches") -> None:
    base = scratch_path(stream.sparkSession, stem)
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", base).trigger(availableNow=True).start()
    q.awaitTermination()
