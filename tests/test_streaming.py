"""Several micro-batches give what one batch gives."""

import os
import re

from pyspark.sql import functions as F

from helpers import at, frame, rows
from skycadence.operators.grid import resample
from skycadence.streaming import twins as tw


def sliced(spark, tmp_path, data, schema, parts=4):
    """The rows in time order as several files, written one after the other."""
    path = str(tmp_path / "in")
    size = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


SCHEMA = "site string, ts timestamp_ntz, id long, x double"


def points():
    out, m = [], 0.0
    for i in range(400):
        m += [1.0, 3.0, 0.5, 14.0 if i % 60 == 0 else 2.0][i % 4]
        out.append(("hot" if i % 3 else "b", at(m), i, float(i % 17)))
    return out


def test_bins_over_batches_equal_batch(spark, tmp_path):
    data = points()
    path = sliced(spark, tmp_path, data, SCHEMA)
    s = tw.tumbling_bins(tw.folder_stream(spark, path), {"s": F.sum("x"), "n": F.count(F.lit(1))}, lateness="5 minutes")
    got = rows(spark.read.parquet(tw.replay(s)), "site", "ts", "s", "n")
    batch = resample(frame(spark, data, SCHEMA), 600, [F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")])
    close = data[-1][1]
    want = [r for r in rows(batch, "site", "ts", "s", "n") if (close - r[1]).total_seconds() >= 900]
    assert got and got == want


def test_repeats_over_batches_are_dropped(spark, tmp_path):
    data = points()[:200]
    repeated = [r for r in data for _ in (0, 1)]  # neighbours, so repeats also straddle files
    path = sliced(spark, tmp_path, repeated, SCHEMA, parts=5)
    s = tw.without_repeats(tw.folder_stream(spark, path), ["id"], lateness="1 hour")
    assert rows(spark.read.parquet(tw.replay(s)), "id") == rows(frame(spark, data, SCHEMA), "id")


def test_history_buffer_survives_batches_and_resets_at_gaps(spark, tmp_path):
    slots = [*range(0, 400, 10), *range(420, 700, 10)]
    data = [("a", at(m), i, float(m)) for i, m in enumerate(slots)]
    path = sliced(spark, tmp_path, data, SCHEMA, parts=3)
    s = tw.online_history(tw.folder_stream(spark, path), value="x")
    got = rows(spark.read.parquet(tw.replay(s)), "ts", "mean_back", "delta", order=["ts"])
    want = [m for m in slots if all(m - 10 * k in slots for k in range(1, 19))]
    assert [r[0] for r in got] == [at(m) for m in want]
    assert all(r[1] == float(m) - 95.0 and r[2] == 10.0 for r, m in zip(got, want))


def test_history_does_not_depend_on_files_or_their_order(spark, tmp_path):
    slots = [*range(0, 400, 10), *range(420, 700, 10)]
    data = [("a", at(m), i, float(m)) for i, m in enumerate(slots)]
    mixed = data[1::3] + data[0::3] + data[2::3]
    found = []
    for parts, per_batch in ((1, 1), (7, 1), (7, 5), (7, 10_001)):
        path = sliced(spark, tmp_path / f"{parts}-{per_batch}", mixed, SCHEMA, parts=parts)
        s = tw.online_history(tw.folder_stream(spark, path, per_batch), value="x")
        found.append(rows(spark.read.parquet(tw.replay(s)), "ts", "mean_back", "delta", order=["ts"]))
    assert len(found[0]) == sum(all(m - 10 * k in slots for k in range(1, 19)) for m in slots)
    assert all(f == found[0] for f in found)


def test_micro_batches_go_by_bytes_not_by_files(spark, tmp_path):
    slots = [*range(0, 400, 10), *range(420, 700, 10)]
    data = [("a", at(m), i, float(m)) for i, m in enumerate(slots)]
    path = sliced(spark, tmp_path, data, SCHEMA, parts=20)
    one = tw.replay(tw.online_history(tw.folder_stream(spark, path, bytes_per_trigger=64_000_000), value="x"), out=str(tmp_path / "one"))
    size = max(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    few = tw.replay(tw.online_history(tw.folder_stream(spark, path, bytes_per_trigger=5 * size), value="x"), out=str(tmp_path / "few"))
    found = [rows(spark.read.parquet(p), "ts", "mean_back", "delta", order=["ts"]) for p in (one, few)]
    assert len(found[0]) == sum(all(m - 10 * k in slots for k in range(1, 19)) for m in slots) and found[0] == found[1]
    batches = [len([f for f in (tmp_path / name / "_progress" / "commits").iterdir() if f.name.isdigit()]) for name in ("one", "few")]
    assert batches[0] == 1 and 1 < batches[1] < 10


def test_online_history_query_runs_few_batches(spark, tmp_path, monkeypatch):
    """The bins leave more files than the query runs micro-batches."""
    import __spark_entry__
    data = [(i, at(3.5 * i), i % 7, "view", float(i % 31), '{"k": 3}') for i in range(2000)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "events.parquet")
    paths, replay = [], tw.replay
    monkeypatch.setattr(tw, "replay", lambda *a, **k: paths.append(replay(*a, **k)) or paths[-1])
    assert __spark_entry__.queries()["str_online_history"](spark, str(tmp_path)).count() > 0
    bins_, history = (p.removesuffix("/data").removeprefix("file:") for p in paths)
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{bins_}/data")) > 5
    assert sum(f.isdigit() for f in os.listdir(f"{history}/_progress/commits")) <= 2


def test_expiring_history_is_bounded_and_takes_late_and_reordered_bins(spark, tmp_path):
    import random
    rng = random.Random(8)
    slots = [m for m in range(0, 12_000, 10) if m % 1500 != 700]
    data = [("a", at(m), i, float(m)) for i, m in enumerate(slots)] + [(None, at(5), 0, 1.0), ("a", at(12_000), 0, None)]
    late = sorted(data[:-2], key=lambda r: slots[r[2]] + rng.randrange(0, 50)) + data[-2:]  # at most 50 minutes behind
    want = [m for m in slots if all(m - 10 * k in set(slots) for k in range(1, 19))]
    for name, order in (("in order", data), ("late", late)):
        path = sliced(spark, tmp_path / name, order, SCHEMA, parts=12)
        got = rows(spark.read.parquet(tw.replay(tw.expiring_history(tw.folder_stream(spark, path), value="x"))), "ts", "mean_back", "delta", "held", order=["ts"])
        assert [r[0] for r in got] == [at(m) for m in want]
        assert all(r[1] == float(m) - 95.0 and r[2] == 10.0 for r, m in zip(got, want))
        # 18 slots, an hour of lateness, and what two batches of 100 slots bring before the watermark moves
        assert max(r[3] for r in got) <= 18 + 1 + 6 + 2 * 100 + 5


def test_report_join_takes_late_rows_and_resumes(spark, tmp_path):
    import random
    rng = random.Random(4)
    bins = [("c", at(590), 900, 1.0)] + [("a", at(10 * k), k, float(k)) for k in range(60) if k % 7] + [("b", at(10 * k), 100 + k, float(k)) for k in range(40)]
    reports = [(rng.choice("ab"), at(rng.randrange(0, 600) + 0.5), 1000 + k, float(k)) for k in range(30)]
    parts = []
    for name, data in (("bins", bins), ("reports", reports)):
        late = sorted(data, key=lambda r: (r[1] - at(0)).total_seconds() / 60 + rng.randrange(0, 40))  # at most 40 minutes behind
        sliced(spark, tmp_path / name, late[:len(late) // 2], SCHEMA, parts=4)
        parts.append((str(tmp_path / name / "in"), late[len(late) // 2:]))
    base = str(tmp_path / "out")
    streams = [tw.closable(tw.folder_stream(spark, path)) for path, _ in parts]
    found = None
    for turn in range(2):  # stopped after half of the files, then taken up again and closed
        both = tw.report_candidates(streams[0], streams[1].withColumnRenamed("x", "report"), ["report"], tolerance_s=65 * 60)
        found = tw.latest_reports(both, ["report"], base, streams if turn else ())
        for (path, rest), name in zip(parts, ("bins", "reports")):
            if not turn:
                spark.createDataFrame(rest, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = {r["id"]: r["report"] for r in found.collect()}
    assert set(got) == {r[2] for r in bins}
    for site, t, i, _ in bins:
        near = [r for r in reports if r[0] == site and 0 <= (t - r[1]).total_seconds() < 65 * 60]
        assert got[i] == (max(near, key=lambda r: r[1])[3] if near else None)


def test_report_join_compares_a_bin_with_the_reports_of_its_span(spark, tmp_path):
    """A long stream in one batch; no row is compared with all others of its station."""
    bins = [("a", at(10 * k), k, float(k)) for k in range(1500)]
    reports = [("a", at(5 * k + 0.5 * (k % 3)), k, float(k)) for k in range(3000)] + [("a", at(60), -1, -1.0), (None, at(70), -2, -2.0), ("a", None, -3, -3.0)]
    streams = [tw.closable(tw.folder_stream(spark, sliced(spark, tmp_path / n, d, SCHEMA, parts=1))) for n, d in (("bins", bins), ("reports", reports))]
    both = tw.report_candidates(streams[0], streams[1].select("site", "ts", F.col("x").alias("report")), ["report"])
    join = next(x for x in both._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in x)
    assert len(re.findall(r"\(\w+#\d+L? = \w+#\d+L?\)", join)) == 2  # the station and the span
    found = tw.latest_reports(both, ["report"], str(tmp_path / "out"), streams)
    got = {r["id"]: r["report"] for r in found.collect()}
    for _, t, i, _ in bins:
        near = [r for r in reports if r[0] == "a" and r[1] is not None and 0 <= (t - r[1]).total_seconds() < 65 * 60]
        latest = max(r[1] for r in near)
        assert got[i] in {r[3] for r in near if r[1] == latest}


def test_newest_report_of_each_step(spark, tmp_path):
    """A report at a slot closes the step that ends there."""
    minutes = [0, 0.5, 3, 9.9, 10, 10.1, 25, 30, 30.5, 61]
    data = [("a", at(m), i, float(i)) for i, m in enumerate(minutes)] + [("b", at(4), 90, None), ("b", at(2), 91, 5.0), ("b", None, 92, 6.0)]
    stream = tw.closable(tw.folder_stream(spark, sliced(spark, tmp_path, data, SCHEMA, parts=2)))
    got = rows(spark.read.parquet(tw.replay(tw.newest_per_step(stream, ["id", "x"]), closing=stream)), "site", "ts", "id", "x")
    want = [("a", at(minutes[i]), i, float(i)) for i in (0, 4, 5, 7, 8, 9)] + [("b", at(4), 90, None)]
    assert got == sorted(want, key=lambda r: tuple(str(v) for v in r))


def test_closed_replay_equals_the_batch_operator(spark, tmp_path):
    data = points()
    stream = tw.closable(tw.folder_stream(spark, sliced(spark, tmp_path, data, SCHEMA)))
    s = tw.tumbling_bins(stream, {"s": F.sum("x"), "n": F.count(F.lit(1))}, lateness="5 minutes")
    got = rows(spark.read.parquet(tw.replay(s, closing=stream)), "site", "ts", "s", "n")
    batch = resample(frame(spark, data, SCHEMA), 600, [F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")])
    assert got == rows(batch, "site", "ts", "s", "n")


def test_for_each_batch_sees_every_row(spark, tmp_path):
    path = sliced(spark, tmp_path, points(), SCHEMA)
    seen = []
    tw.each_batch(tw.folder_stream(spark, path), lambda df, i: seen.append(df.count()))
    assert sum(seen) == 400 and len(seen) == 4
